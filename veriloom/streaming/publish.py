"""Exactly-once publication of a stream's micro-batches as versions of a table.

A micro-batch is written to a folder of its own and then committed by one log file that is created only if it isn't there: the
batch number of the stream is the version, so a batch that is run again after a crash overwrites what it left half done, and one that
was committed is passed over.  Readers start at the log and see whole versions only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..sources.merkle import table_digest
from ..sources.store import ArtifactError

LOG = "version bigint, rows bigint, digest string"


class PublishedTable:
    """Versions 0, 1, 2, … of an append-only table below one folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, version: int) -> str:
        return f"log/{version:012d}.json"

    def committed(self, version: int) -> bool:
        return self._fs().exists(self._path(self._entry(version)))

    def publish(self, rows: DataFrame, version: int) -> bool:
        """Write and commit one version; False if it is there already.  Versions follow one another without a gap."""
        if self.committed(version):
            return False
        if version and not self.committed(version - 1):
            raise ArtifactError(f"version {version - 1} isn't published")
        folder = f"{self.root}/data/version={version}"
        rows.write.mode("overwrite").parquet(folder)  # over what an attempt that failed has left
        stated = table_digest(self.spark.read.schema(self.schema).parquet(folder)).first()
        entry = json.dumps({"version": version, "rows": stated["rows"], "digest": stated["digest"]})
        try:
            out = self._fs().create(self._path(self._entry(version)), False)  # of two writers one succeeds
        except Exception as error:
            if self.committed(version):
                return False
            raise ArtifactError(f"version {version} can't be committed") from error
        out.write(bytearray(entry, "utf-8"))
        out.close()
        return True

    def log(self) -> DataFrame:
        if not self._fs().exists(self._path("log")):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.root}/log")

    def latest(self) -> int:
        """The last version, -1 before the first."""
        found = self.log().agg(F.max("version").alias("version")).first()["version"]
        return -1 if found is None else found

    def read(self, version: int | None = None) -> DataFrame:
        """All rows up to a version (the last one by default), with the ``version`` that brought them."""
        until = self.latest() if version is None else version
        if until > self.latest():
            raise ArtifactError(f"version {until} isn't published")
        if until < 0:
            return self.spark.createDataFrame([], self.schema).withColumn("version", F.lit(None).cast("bigint"))
        found = self.spark.read.parquet(f"{self.root}/data").withColumn("version", F.col("version").cast("bigint"))
        return found.filter(F.col("version") <= until)  # prunes folders; what is not committed is later

    def verify(self) -> DataFrame:
        """``version, passed``: whether each committed version still has its rows."""
        rows = self.read()
        found = table_digest(rows, "version").withColumnsRenamed({"rows": "found_rows", "digest": "found"})
        passed = F.col("rows").eqNullSafe(F.coalesce("found_rows", F.lit(0))) & (F.col("found").eqNullSafe(F.col("digest")) | (F.col("rows") == 0))
        return self.log().join(found, "version", "left").select("version", passed.alias("passed"))

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A stream's writer whose batch numbers are the versions; ``checkpoint`` belongs to this table."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: self.publish(rows, number) and None)
