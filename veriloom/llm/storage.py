"""Tables that a job writes in order to cut lineage or to keep state.

Everything goes below ``spark.checkpoint.dir``, which driver and executors share.  The folder is read from the session; where it
is unset, a fresh temporary one is made for a local master, and any other master is refused.  ``discard`` deletes what jobs left.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

#: ASCII white space, as the operators' contracts define it.
SPACES = r"[\x20\x09-\x0D]+"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back.

    The result's lineage starts at files that every executor sees, so losing an executor costs only the tasks it ran.  An empty
    frame comes back empty with the same columns.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that Spark hands to a Python worker at once.  By default only rows are counted, and a batch of long texts has no bound.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to ``BATCH_BYTES``; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB") or -1)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


class StoreMeta:
    """What a persistent store was made with: its number of buckets, and bytes of the store's own.

    It is a table of one row beside the store, ``<path>-meta``.  A store that exists opens with its own number; asking for another
    is an error.  The default for a new one is the session's shuffle partitions, so that rows aggregated by the bucket key are
    already laid out as the buckets are.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None):
        self.spark, self.path, self.extra = spark, f"{path}-meta", None
        try:
            found = spark.read.schema("buckets int, extra binary").parquet(self.path).first()
        except AnalysisException:
            found = None
        if found is None:
            self.buckets = buckets or shuffle_partitions(spark)
            self._write(None)
            return
        if buckets not in (None, found["buckets"]):
            raise ValueError(f"{path} has {found['buckets']} buckets, not {buckets}")
        self.buckets, self.extra = found["buckets"], None if found["extra"] is None else bytes(found["extra"])

    def _write(self, extra: bytes | None) -> None:
        row = self.spark.createDataFrame([(self.buckets, extra)], "buckets int, extra binary")
        row.coalesce(1).write.mode("overwrite").parquet(self.path)

    def save(self, extra: bytes) -> None:
        self.extra = extra
        self._write(extra)


class BucketedTable:
    """A Parquet folder bucketed and sorted by one column, under a name of its own in the catalog."""

    def __init__(self, spark: SparkSession, path: str, by: str, columns: str, buckets: int):
        self.spark, self.path, self.by, self.buckets = spark, path, by, buckets
        self.name = f"bucketed_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows that are already partitioned by the bucket column."""
        rows.write.mode("append").format("parquet").option("compression", "none").bucketBy(self.buckets, self.by).sortBy(self.by).option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Drop the name; the table is external, so its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
