import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from veriloom.sources import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root_of(rows, per_node):
    """The root by loops: nodes of as many digits as the rows ask for, then their parents."""
    leaves = {}
    for row in rows:
        x = sha(json.dumps(row, separators=(",", ":")))
        leaves[x] = leaves.get(x, 0) + 1
    depth = sum(len(rows) > per_node * 16**k for k in range(12))
    nodes = {}
    for x, n in leaves.items():
        nodes.setdefault(x[:depth], []).append(f"{x}:{n}")
    digests = {p: sha(",".join(sorted(v))) for p, v in nodes.items()}
    for level in range(depth - 1, -1, -1):
        above = {}
        for p, x in digests.items():
            above.setdefault(p[:level], []).append(f"{p}:{x}")
        digests = {p: sha(",".join(sorted(v))) for p, v in above.items()}
    if depth == 0:
        digests = {"": sha(f":{digests['']}")}
    return len(rows), digests[""]


@pytest.mark.parametrize("n", [1, 3, 20, 200, 1500])
def test_depth_follows_the_rows(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "NODE_ROWS", 4)
    rows = [{"a": i % max(1, n - 2), "b": "x"} for i in range(n)]
    df = spark.createDataFrame([(r["a"], r["b"]) for r in rows], "a int, b string")
    assert tuple(merkle.table_digest(df.repartition(3)).first()) == root_of(rows, 4)
    split = df.withColumn("g", F.when(F.col("a") % 5 == 0, None).otherwise(F.col("a") % 2))
    for r in merkle.table_digest(split, "g").collect():
        own = [x for x in rows if (None if x["a"] % 5 == 0 else x["a"] % 2) == r["g"]]
        assert (r["rows"], r["digest"]) == root_of(own, 4)


def test_lowest_nodes_stay_small(spark, monkeypatch):
    monkeypatch.setattr(merkle, "NODE_ROWS", 16)
    rows = spark.range(20_000).select("id", F.lit("same").alias("text"))
    leaves = rows.select(merkle.leaf(rows).alias("place"), merkle.leaf(rows).alias("leaf"), F.lit(1).cast("bigint").alias("n"))
    nodes = merkle.tree(leaves, 3).cache()
    sizes = {r["level"]: (r["n"], r["most"], r["all"]) for r in nodes.groupBy("level").agg(F.count("*").alias("n"), F.max("n").alias("most"), F.sum("n").alias("all")).collect()}
    assert set(sizes) == {0, 1, 2, 3} and sizes[3][1] <= 16 and sizes[0] == (1, 20_000, 20_000) and all(s[2] == 20_000 for s in sizes.values())


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, w int")


@pytest.fixture()
def versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "NODE_ROWS", 4)
    monkeypatch.setattr(merkle, "RANGE_DIGITS", 1)
    made = []

    def make(rows, depth=None):
        made.append(1)
        return merkle.Version(spark, str(tmp_path / f"v{len(made)}"), "k").write(table(spark, rows), depth)

    return make


def test_difference_against_loops(versions):
    random.seed(5)
    old = {f"k{i}": (random.choice("abc"), i) for i in range(300)}
    for change in (0, 1, 60):
        new = dict(old)
        for i in random.sample(range(400), change):
            k = f"k{i}"
            if k in new and random.random() < 0.4:
                del new[k]
            else:
                new[k] = (random.choice("abcd"), i)
        want = sorted([(k, "added") for k in new.keys() - old.keys()] + [(k, "removed") for k in old.keys() - new.keys()] + [(k, "modified") for k in old.keys() & new.keys() if old[k] != new[k]])
        a, b = (versions([(k, *v) for k, v in x.items()]) for x in (old, new))
        assert sorted(tuple(r) for r in merkle.difference(a, b).collect()) == want
        rules = {r["rule"]: (r["passed"], r["detail"]) for r in merkle.append_only(a, b).collect()}
        for c in ("modified", "removed"):
            n = sum(x == c for _, x in want)
            assert rules[f"nothing_{c}"] == (n == 0, str(n))


def test_trees_of_unlike_depth(versions):
    a, b = versions([("x", "1", 1), ("y", "2", 2)]), versions([(f"k{i}", "v", i) for i in range(300)] + [("x", "1", 1)])
    assert a.depth == 0 < b.depth
    got = [tuple(r) for r in merkle.difference(a, b).collect()]
    assert len(got) == 301 and ("y", "removed") in got and not any(k == "x" for k, _ in got)


def test_only_changed_ranges_are_read(spark, versions):
    rows = [(f"k{i}", "v", i) for i in range(3000)]
    a = versions(rows)
    b = versions([*rows[:-1], ("k2999", "other", 1)], a.depth)
    changed = merkle.unequal_nodes(a.nodes, b.nodes, a.depth)
    assert changed.count() == 1
    frame = b.ranges([changed.first()["prefix"][: merkle.RANGE_DIGITS]], changed, b.depth)
    plan = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    assert "__range" in plan.toString().split("PartitionFilters")[1].split("]")[0]
    assert len({r["__place"][:1] for r in frame.collect()}) == 1
    assert [tuple(r) for r in merkle.difference(a, b).collect()] == [("k2999", "modified")]


def test_keys_must_be_unique_and_empty_tables(versions):
    with pytest.raises(merkle.TreeError):
        versions([("a", "1", 1), ("a", "2", 2)])
    a, b = versions([]), versions([("a", "1", 1), (None, "1", 1)])
    assert sorted(map(tuple, merkle.difference(a, b).collect()), key=str) == [("a", "added"), (None, "added")]
    assert merkle.difference(a, a).collect() == []
