"""Many artifacts of a few kinds, written, verified and listed by one plan for each table of a kind, however many artifacts there are.

A kind has tables, each one Parquet folder partitioned by artifact, and a manifest with a row for each artifact and table: rows, digest
(the root of the table's Merkle tree), and the artifacts that it was made from are rows of a table of its own.  Writing replaces what an
attempt that failed left of the same artifacts, and the manifest comes last; an artifact without one is never listed.  Besides digests, a
kind's rules recompute what its tables must agree on, for all artifacts at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .merkle import table_digest
from .store import ArtifactError

MANIFEST = "artifact string, table string, rows bigint, digest string"
FINDING = "artifact string, rule string, passed boolean, detail string"
#: A rule gets a kind's tables, each with its ``artifact``, and gives ``artifact, detail`` of those that break it.
Rule = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Kind:
    tables: dict[str, str]
    rules: dict[str, Rule] = field(default_factory=dict)


#: Table of a kind that says what its artifacts were made from.
SOURCES = "sources"
SOURCES_SCHEMA = "kind string, source string, digest string"


class Shelf:
    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, Kind]):
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _rows(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def manifest(self, kind: str) -> DataFrame:
        return self._rows(f"{self.root}/{kind}/manifest", MANIFEST)

    def table(self, kind: str, name: str) -> DataFrame:
        return self._rows(f"{self.root}/{kind}/{name}", f"{self.kinds[kind].tables[name]}, artifact string")

    def _digests(self, kind: str, artifacts: DataFrame | None = None) -> DataFrame:
        parts = []
        for name in sorted(self.kinds[kind].tables):
            parts.append(table_digest(self.table(kind, name), "artifact", artifacts).select("artifact", F.lit(name).alias("table"), "rows", "digest"))
        return reduce(DataFrame.unionByName, parts)

    def write(self, kind: str, tables: dict[str, DataFrame]) -> None:
        """Add the artifacts of ``tables``, each a frame with an ``artifact`` column; one that is published already is refused."""
        if set(tables) != set(self.kinds[kind].tables):
            raise ArtifactError(f"{kind} has the tables {sorted(self.kinds[kind].tables)}")
        names = reduce(DataFrame.unionByName, (rows.select("artifact") for rows in tables.values())).distinct()
        known = names.join(self.manifest(kind), "artifact", "left_semi").limit(5).collect()
        if known:
            raise ArtifactError(f"published and immutable: {sorted(r['artifact'] for r in known)}")
        for name, rows in tables.items():
            wanted = [c.split()[0] for c in self.kinds[kind].tables[name].split(", ")]
            out = rows.select(*wanted, "artifact").repartition("artifact", F.pmod(F.xxhash64(*wanted), F.lit(16)))  # a large artifact goes over several tasks
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact").parquet(f"{self.root}/{kind}/{name}")
        every = names.select("artifact", F.explode(F.array(*map(F.lit, sorted(tables)))).alias("table"))
        empty = table_digest(self.spark.createDataFrame([], "a int")).first()["digest"]
        found = every.join(self._digests(kind, names), ["artifact", "table"], "left").select("artifact", "table", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("digest", F.lit(empty)).alias("digest"))
        found.repartition("artifact").write.mode("append").parquet(f"{self.root}/{kind}/manifest")

    def verify(self, kind: str) -> DataFrame:
        """``artifact, rule, passed, detail`` of every artifact of a kind: a row for each table and each rule."""
        empty = table_digest(self.spark.createDataFrame([], "a int")).first()["digest"]
        stated = self.manifest(kind)
        found = self._digests(kind).withColumnsRenamed({"rows": "found_rows", "digest": "found"})
        both = stated.join(found, ["artifact", "table"], "full_outer")
        rows, digest = F.coalesce("found_rows", F.lit(0)), F.coalesce("found", F.lit(empty))
        checks = F.array(
            F.struct(F.lit("published").alias("rule"), F.col("rows").isNotNull().alias("passed")), F.struct(F.lit("row_count").alias("rule"), F.coalesce(F.col("rows") == rows, F.lit(False)).alias("passed")),
            F.struct(F.lit("digest").alias("rule"), F.coalesce(F.col("digest") == digest, F.lit(False)).alias("passed")),
        )
        parts = [both.select("artifact", F.explode(checks).alias("c"), "table").select("artifact", "c.rule", "c.passed", F.col("table").alias("detail"))]
        tables = {name: self.table(kind, name) for name in self.kinds[kind].tables}
        names = stated.select("artifact").distinct()
        rules = dict(self.kinds[kind].rules)
        if SOURCES in tables:
            rules["lineage"] = self._lineage
        for rule, broken in rules.items():
            bad = broken(tables).groupBy("artifact").agg(F.min("detail").alias("detail"))  # the first detail stands for all
            parts.append(names.join(bad, "artifact", "left").select("artifact", F.lit(rule).alias("rule"), F.col("detail").isNull().alias("passed"), F.coalesce("detail", F.lit("")).alias("detail")))
        return reduce(DataFrame.unionByName, parts)

    def _lineage(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Sources that aren't published, or not with the digest that was bound."""
        bound = tables[SOURCES]
        every = reduce(DataFrame.unionByName, (self.bindings(k) for k in sorted(self.kinds)))
        known = every.select(F.col("kind").alias("__kind"), F.col("source").alias("__source"), F.col("digest").alias("__digest"))
        met = bound.join(known, (bound["kind"] == known["__kind"]) & (bound["source"] == known["__source"]), "left")
        bad = met.filter(~F.coalesce(F.col("digest") == F.col("__digest"), F.lit(False)))
        return bad.select("artifact", F.concat(F.when(F.col("__digest").isNull(), "unknown ").otherwise("changed "), F.coalesce("source", F.lit("null"))).alias("detail"))

    def bindings(self, kind: str) -> DataFrame:
        """``kind, source, digest`` of every published artifact of a kind: what others bind."""
        one = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "table", "digest"))), ",").cast("binary"), 256)  # as many as a kind has tables
        return self.manifest(kind).groupBy("artifact").agg(one.alias("digest")).select(F.lit(kind).alias("kind"), F.col("artifact").alias("source"), "digest")

    def listing(self, kind: str) -> DataFrame:
        """``artifact`` of those for which every check passes; others are passed over in silence."""
        return self.verify(kind).groupBy("artifact").agg(F.bool_and("passed").alias("passed")).filter("passed").select("artifact")

    def read(self, kind: str, artifact: str) -> dict[str, DataFrame]:
        """The tables of one artifact that verifies; otherwise an error."""
        bad = self.verify(kind).filter(F.col("artifact") == artifact).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.when(~F.col("passed"), F.concat_ws(": ", "rule", "detail")))).alias("bad")).first()
        if not bad["n"] or bad["bad"]:
            raise ArtifactError("; ".join(bad["bad"]) if bad["n"] else f"{artifact} isn't published")
        return {name: self.table(kind, name).filter(F.col("artifact") == artifact).drop("artifact") for name in self.kinds[kind].tables}


def differing(a: DataFrame, b: DataFrame, detail: Column) -> DataFrame:
    """``artifact, detail`` of rows that only one of two frames has."""
    only = a.exceptAll(b).unionByName(b.exceptAll(a))
    return only.select("artifact", detail.alias("detail"))
