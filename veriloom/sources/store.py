"""Immutable artifact tables: build, write, verify, read.

An artifact is a folder of Parquet tables and a manifest.  Each table's digest is the root of its Merkle tree (``merkle``); it doesn't
depend on order or partitioning, and no task gathers a table.  The manifest is written last and is what makes an artifact complete; a folder without one is never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.canonical import sha256_text
from .merkle import table_digest

MANIFEST = "table string, rows bigint, digest string"


class ArtifactError(RuntimeError):
    pass


#: Lines that an exact-bytes digest takes: a bound of the export's contract, beyond which it is refused.
EXPORT_LINES = 1_000_000


def ordered_digest(rows: DataFrame, key: str, line: Column, by: str | None = None) -> DataFrame:
    """Digest of a small export's exact bytes: its lines in order of key, each with a line feed.

    Bytes in order are sequential by nature, so an export of more than ``EXPORT_LINES`` lines is refused; ``table_digest`` has no bound.
    """
    keys = [by] if by else []
    if rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EXPORT_LINES).limit(1).collect():
        raise ArtifactError(f"more than {EXPORT_LINES} lines: use table_digest")
    one = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    text = F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n"))
    return rows.groupBy(*keys).agg(one.alias("all")).select(*keys, F.size("all").alias("n"), sha256_text(text).alias("digest"))


class ArtifactStore:
    """Artifacts below one folder, by id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, artifact: str, name: str) -> str:
        return f"{self.root}/{artifact}/{name}"

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.parquet(path)
        except AnalysisException:
            return False
        return True

    def write(self, artifact: str, tables: dict[str, DataFrame], partition: str | None = None) -> DataFrame:
        """Write an artifact that isn't there yet, verify what was written, then publish its manifest."""
        if self._exists(self._path(artifact, "manifest")):
            raise ArtifactError(f"{artifact} exists and is immutable")
        for name, rows in tables.items():
            out = rows.write.mode("error")
            if partition and partition in rows.columns:
                out = out.partitionBy(partition)
            out.parquet(self._path(artifact, name))
        manifest = self._manifest(artifact, sorted(tables))
        stated = reduce(DataFrame.unionByName, [table_digest(tables[n]).select(F.lit(n).alias("table"), "rows", "digest") for n in sorted(tables)])
        if manifest.exceptAll(stated).limit(1).collect():
            raise ArtifactError(f"{artifact} was not written as it was given")
        manifest.coalesce(1).write.mode("error").parquet(self._path(artifact, "manifest"))
        return self.spark.read.schema(MANIFEST).parquet(self._path(artifact, "manifest"))

    def _manifest(self, artifact: str, names: list[str]) -> DataFrame:
        parts = []
        for n in names:
            rows = self.spark.read.parquet(self._path(artifact, n))
            parts.append(table_digest(rows.select(sorted(rows.columns))).select(F.lit(n).alias("table"), "rows", "digest"))
        return reduce(DataFrame.unionByName, parts)

    def verify(self, artifact: str) -> DataFrame:
        """``rule, passed, detail``: tampering is reported, not raised."""
        path = self._path(artifact, "manifest")
        if not self._exists(path):
            return self.spark.createDataFrame([("manifest_present", False, artifact)], "rule string, passed boolean, detail string")
        stated = self.spark.read.schema(MANIFEST).parquet(path)
        names = sorted(r["table"] for r in stated.select("table").collect())  # one row per table of the artifact
        there = [n for n in names if self._exists(self._path(artifact, n))]
        found = self._manifest(artifact, there).withColumnsRenamed({"rows": "found_rows", "digest": "found_digest"})
        rows = stated.join(found, "table", "left")
        rules = F.array(
            F.struct(F.lit("table_present").alias("rule"), F.col("found_rows").isNotNull().alias("passed")), F.struct(F.lit("row_count").alias("rule"), F.col("rows").eqNullSafe(F.col("found_rows")).alias("passed")),
            F.struct(F.lit("digest").alias("rule"), F.col("digest").eqNullSafe(F.col("found_digest")).alias("passed")),
        )
        return rows.select(F.explode(rules).alias("r"), F.col("table").alias("detail")).select("r.rule", "r.passed", "detail")

    def listing(self, artifacts: DataFrame, order: list[str]) -> DataFrame:
        """The rows of ``artifacts(artifact, …)`` that verify, in order; others are passed over in silence."""
        names = [r["artifact"] for r in artifacts.select("artifact").distinct().collect()]  # one row per artifact of a registry
        good = [n for n in names if not self.verify(n).filter("not passed").limit(1).collect()]
        return artifacts.filter(F.col("artifact").isin(good)).orderBy(*order)

    def read(self, artifact: str) -> dict[str, DataFrame]:
        """The tables of an artifact that verifies; otherwise an error."""
        bad = self.verify(artifact).filter("not passed").collect()
        if bad:
            raise ArtifactError("; ".join(f"{r['rule']}: {r['detail']}" for r in bad))
        names = [r["table"] for r in self.spark.read.parquet(self._path(artifact, "manifest")).collect()]
        return {n: self.spark.read.parquet(self._path(artifact, n)) for n in names}


def file_findings(index: DataFrame, files: DataFrame) -> DataFrame:
    """``path, rule`` of an index ``(path, sha256)`` against files ``(path, content)``: missing, not listed, changed."""
    there = files.select("path", F.sha2("content", 256).alias("found"))
    both = index.select("path", "sha256").join(there, "path", "full_outer")
    rule = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not_listed").when(F.col("sha256") != F.col("found"), "changed")
    return both.select("path", rule.alias("rule")).filter("rule is not null")


def append_to_index(index: DataFrame, rows: DataFrame, key: str = "run_id") -> DataFrame:
    """The index with new rows; a known key, or one that comes twice, is refused."""
    known = rows.join(index.select(key), key, "left_semi").select(key)
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    bad = known.unionByName(twice).limit(5).collect()
    if bad:
        raise ArtifactError(f"already indexed or repeated: {sorted(r[key] for r in bad)}")
    return index.unionByName(rows)


def exactly_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    found = rows.filter(F.col(key) == value)
    if len(found.limit(2).collect()) != 1:
        raise ArtifactError(f"{key} {value} isn't there exactly once")
    return found
