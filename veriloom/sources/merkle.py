"""Merkle trees of tables: as deep as the table is large, compared by going down into unequal nodes only.

A row is a leaf, at a place of the digest space: its own digest, or the digest of its key.  Nodes are prefixes of places; a parent
has sixteen children at most.  The depth follows the number of rows, so that a lowest node has some hundred leaves at any size.  A
tree doesn't depend on the order or partitioning of its rows, and equal rows are one leaf with a count.

``Version`` keeps a table by ranges of places with its tree beside it.  Two versions are compared from their roots: children of equal
nodes are never looked at, and rows are read from the ranges that hold an unequal lowest node, no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, record, sha256_text

#: Rows for each lowest node, on average at most; places are uniform, so the largest node has not many more.
NODE_ROWS = 512
#: Levels that a tree may have: 16 ** 12 nodes.
MOST_LEVELS = 12
#: Tasks over which the rows of one value are dealt where they meet its depth.
PARTS = 16
#: Hex digits of a place that name a range of a stored version.
RANGE_DIGITS = 2


class TreeError(RuntimeError):
    pass


def leaf(rows: DataFrame) -> Column:
    return sha256_text(canonical_json(record(**{c: F.col(c) for c in rows.columns})))


def depth_of(n: Column) -> Column:
    """Hex digits of a lowest node's prefix in a tree of ``n`` rows."""
    return reduce(Column.__add__, (F.when(n > NODE_ROWS * 16**k, 1).otherwise(0) for k in range(MOST_LEVELS)))


def lowest_nodes(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """``prefix, n, digest`` of ``leaves(place, leaf, n, depth)``; each node's leaves are in order of place."""
    one = sha256_text(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "leaf", "n"))), ","))
    return leaves.groupBy(*keys, F.substr("place", F.lit(1), F.col("depth")).alias("prefix")).agg(F.sum("n").alias("n"), one.alias("digest"))


def parents(nodes: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Nodes of ``level`` digits from those of more; what is no deeper stays as it is."""
    joined = sha256_text(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest"))), ","))
    digest = F.when(F.max(F.length("prefix")) <= level, F.min("digest")).otherwise(joined)
    return nodes.groupBy(*keys, F.substr("prefix", F.lit(1), F.lit(level)).alias("prefix")).agg(F.sum("n").alias("n"), digest.alias("digest"))


def table_digest(rows: DataFrame, by: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row ``rows, digest``, the root of the rows' tree (for each value of ``by``, of its own rows; ``only`` holds the values that are wanted)."""
    keys = [by] if by else []
    own = [c for c in rows.columns if c not in keys]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).withColumn("depth", depth_of(F.col("size")))
    if only is not None:
        sizes = sizes.join(only, by, "left_semi")
    deepest = sizes.agg(F.max("depth").alias("depth")).first()["depth"] or 0
    if by:  # one value may have most rows
        parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("__part")
        sizes = sizes.select(F.col(by).alias("__by"), F.col("depth").alias("__depth"), parts)
        dealt = rows.withColumn("__dealt", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
        rows = dealt.join(sizes, dealt[by].eqNullSafe(sizes["__by"]) & (dealt["__dealt"] == sizes["__part"]))
    leaves = rows.select(*keys, F.col("__depth").alias("depth") if by else F.lit(deepest).alias("depth"), leaf(rows.select(*own)).alias("leaf"))
    leaves = leaves.groupBy(*keys, "depth", "leaf").agg(F.count(F.lit(1)).alias("n"))
    nodes = lowest_nodes(leaves.withColumn("place", F.col("leaf")), keys)
    for level in range(deepest - 1, 0, -1):
        nodes = parents(nodes, keys, level)
    top = sha256_text(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest"))), ","))
    return nodes.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), top.alias("digest"))


def tree(leaves: DataFrame, depth: int) -> DataFrame:
    """``level, prefix, n, digest`` of all nodes over ``leaves(place, leaf, n)``, from the lowest level to the root."""
    nodes = lowest_nodes(leaves.withColumn("depth", F.lit(depth)), [])
    levels = [nodes]
    for level in range(depth - 1, -1, -1):
        levels.append(parents(levels[-1], [], level))
    return reduce(DataFrame.unionByName, (x.select(F.lit(depth - k).alias("level"), "prefix", "n", "digest") for k, x in enumerate(levels)))


def unequal_nodes(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """``prefix`` of the lowest nodes in which two trees of one depth differ.  A node is looked at if its parent differs."""
    open_: DataFrame | None = None
    for level in range(depth + 1):
        a, b = (t.filter(F.col("level") == level).select("prefix", F.col("digest").alias(name)) for t, name in ((old, "a"), (new, "b")))
        if open_ is not None:
            parent = open_.withColumnRenamed("prefix", "parent")
            a, b = (x.join(parent, F.substr(x["prefix"], F.lit(1), F.lit(level - 1)) == parent["parent"], "left_semi") for x in (a, b))
        open_ = a.join(b, "prefix", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
    return open_


class Version:
    """One version of a table with a unique key: ``rows`` by range, ``nodes``, below one folder.  The nodes are written last."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @property
    def rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema  # an empty table has no range
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    @property
    def depth(self) -> int:
        return self.nodes.agg(F.max("level").alias("level")).first()["level"] or 0

    def write(self, rows: DataFrame, depth: int | None = None) -> Version:
        """Store a version; ``depth`` is that of another version to compare with, else it follows the number of rows."""
        place = sha256_text(canonical_json(record(key=F.col(self.key))))
        kept = rows.select(*rows.columns, leaf(rows).alias("__leaf"), place.alias("__place"))
        kept = kept.withColumn("__range", F.concat(F.lit("r"), F.substr("__place", F.lit(1), F.lit(RANGE_DIGITS))))  # never read as a number
        kept.limit(0).write.parquet(f"{self.path}/schema")
        # a range's rows stay in order of place, so that files have narrow statistics
        kept.repartition("__range").sortWithinPartitions("__range", "__place").write.partitionBy("__range").parquet(f"{self.path}/rows")
        counted = self.rows.count()
        twice = self.rows.groupBy("__place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise TreeError(f"{self.key} is not unique")
        if depth is None:
            depth = sum(counted > NODE_ROWS * 16**k for k in range(MOST_LEVELS))
        leaves = self.rows.select(F.col("__place").alias("place"), F.col("__leaf").alias("leaf"), F.lit(1).cast("bigint").alias("n"))
        tree(leaves, depth).coalesce(1).write.parquet(f"{self.path}/nodes")
        return self

    def at_depth(self, depth: int) -> DataFrame:
        """The nodes of this version in a tree of ``depth``: stored ones, or anew from the leaves."""
        if depth == self.depth:
            return self.nodes
        return tree(self.rows.select(F.col("__place").alias("place"), F.col("__leaf").alias("leaf"), F.lit(1).cast("bigint").alias("n")), depth)

    def ranges(self, names: list[str], prefixes: DataFrame, depth: int) -> DataFrame:
        """Key, leaf and place of the rows below some lowest nodes; ``names`` are the ranges that hold them."""
        rows = self.rows.filter(F.col("__range").isin([f"r{n}" for n in names])).select(self.key, "__leaf", "__place")
        return rows.join(prefixes, F.substr("__place", F.lit(1), F.lit(depth)) == prefixes["prefix"], "left_semi")


def difference(old: Version, new: Version) -> DataFrame:
    """``key, change`` (added, removed, modified) between two versions, from the ranges that differ."""
    depth = max(old.depth, new.depth)
    changed = unequal_nodes(old.at_depth(depth), new.at_depth(depth), depth)
    # at most 16 ** RANGE_DIGITS names; a node above the ranges stands for all of its own
    names = [r["name"] for r in changed.select(F.substr("prefix", F.lit(1), F.lit(RANGE_DIGITS)).alias("name")).distinct().collect()]
    whole = [f"{k:0{RANGE_DIGITS}x}" for k in range(16**RANGE_DIGITS)]
    names = sorted({w for n in names for w in whole if w.startswith(n)})
    a, b = (v.ranges(names, changed, depth).select(F.col(v.key).alias("key"), "__place", F.col("__leaf").alias(x)) for v, x in ((old, "a"), (new, "b")))
    both = a.join(b.withColumnRenamed("key", "key_b"), "__place", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select(F.coalesce("key", "key_b").alias("key"), change.alias("change")).filter("change is not null")


def append_only(old: Version, new: Version) -> DataFrame:
    """Checks ``rule, passed, detail`` that ``new`` only adds to ``old``."""
    counts = difference(old, new).groupBy().pivot("change", ["added", "removed", "modified"]).count().na.fill(0)
    rules = F.array(*(F.struct(F.lit(f"nothing_{c}").alias("rule"), (F.col(c) == 0).alias("passed"), F.col(c).cast("string").alias("detail")) for c in ("modified", "removed")))
    return counts.select(F.explode(rules).alias("r")).select("r.*")
