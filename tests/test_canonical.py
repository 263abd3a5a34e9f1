import hashlib
import json
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.functions import canonical as C
from veriloom.operators import dataset as D

TEXT = st.text(st.characters(min_codepoint=32, exclude_categories=("Cs",), exclude_characters="\x7f"), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.none() | TEXT, st.integers(-(2**40), 2**40), st.none() | st.booleans()), min_size=1, max_size=30))
def test_ids_equal_python(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<t: string, n: bigint, b: boolean>")
    value = C.record(z=F.col("r.t"), a=F.col("r.n"), m=C.record(y=F.col("r.b"), x=F.lit("ü")))
    for r in df.select("i", C.content_id("x", value, 24).alias("id")).collect():
        t, n, b = rows[r["i"]]
        text = json.dumps({"z": t, "a": n, "m": {"y": b, "x": "ü"}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r["id"] == "x-" + hashlib.sha256(text.encode()).hexdigest()[:24]


def test_bucket_and_ratio(spark):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), i % 37, i % 41) for i in range(400)]
    df = spark.createDataFrame(rows, "h string, n bigint, d bigint")
    for r in df.select("*", C.digest_bucket(F.col("h")).alias("b"), C.ratio(F.col("n"), F.col("d")).alias("q")).collect():
        assert r["b"] == int(r["h"], 16) % 10_000
        want = str((Decimal(r["n"]) / Decimal(r["d"])).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)) if r["d"] else None
        assert r["q"] == want


def test_texts(spark):
    rows = [("  A b\t",), ("é" * 5,), ("日本",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(C.normalised_label(F.col("t")).alias("n"), C.truncated_bytes(F.col("t"), 5).alias("c")).collect()
    assert [r["n"] for r in got] == ["a b", "é" * 5, "日本", "", None]
    assert [r["c"] for r in got] == ["  A b", "éé", "日", "", None]
    names = ["a/b", "../x", "/x", "a\\b", "", "a..b"]
    safe = spark.createDataFrame([(n,) for n in names], "p string").select(C.safe_path(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in safe] == [True, False, False, False, False, True]
    decimals = ["1.500", "-0.10", "7", "1e5", "x", "10.0", "100"]
    out = spark.createDataFrame([(n,) for n in decimals], "p string").select(C.canonical_decimal(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in out] == ["1.5", "-0.1", "7", None, None, "10", "100"]


def test_split_is_total_and_independent_of_order(spark):
    policy = D.SplitPolicy("salt")
    df = spark.range(2000).select(F.concat(F.lit("grp-"), "id").alias("group_id"), F.lit("accepted_fault").alias("kind"))
    a = {r[0]: r[2] for r in D.assigned(df, policy).collect()}
    b = {r[0]: r[2] for r in D.assigned(df.orderBy(F.rand(1)).repartition(5), policy).collect()}
    assert a == b and set(a.values()) == {"train", "validation", "test"}
    assert 1500 < sum(p == "train" for p in a.values()) < 1700
    with pytest.raises(ValueError):
        D.SplitPolicy("x", 10_000, 0)
