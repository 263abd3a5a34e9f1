import itertools

import pytest
from pyspark.sql import functions as F

from veriloom.functions import versions

# in ascending order by the published rules; those of one line are equal
ORDER = [
    ["1.dev0"], ["1.0.dev456"], ["1.0a1", "1.0.alpha1", "v1.0-A.1"], ["1.0a2.dev456"], ["1.0a12.dev456"], ["1.0a12"], ["1.0b1.dev456"], ["1.0b2"], ["1.0b2.post345.dev456"], ["1.0b2.post345"], ["1.0rc1.dev456"], ["1.0rc1", "1.0c1", "1.0-pre1"],
    ["1.0", "1", "1.0.0", " 1.0 "], ["1.0+abc.5"], ["1.0+abc.7"], ["1.0+5"], ["1.0.post456.dev34"], ["1.0.post456", "1.0-456", "1.0.r456"], ["1.0.15"], ["1.1.dev1"], ["2"], ["10.2"], ["1!0.5"],
]


def test_order_of_versions(spark):
    rows = [(k, v) for k, many in enumerate(ORDER) for v in many]
    keys = spark.createDataFrame(rows, "k int, v string").repartition(4).withColumn("key", versions.version_key(F.col("v")))
    got = keys.orderBy("key").collect()
    assert [r["k"] for r in got] == sorted(k for k, _ in rows)
    assert keys.select("k", "key").distinct().count() == len(ORDER)


@pytest.mark.parametrize("text", ["", "abc", "1.0x", "1..0", "1.0+", "-1", None])
def test_other_texts_are_null(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(versions.version_key(F.col("v"))).first()[0] is None
    assert df.select(versions.satisfies(F.col("v"), F.lit(">=1"))).first()[0] is None


SPECS = [">=1.0", ">1.0", "<1.0", "<=1.0", "==1.0", "==1.0.*", "!=1.0.*", "!=1.0", "~=1.0", "~=1.0.0", "==1.0+abc.5", ">=1.0a1", "<1.0rc1", ">=1.0,<2", ">=1,!=1.0.post456", "==1.*", "", "~=1.0rc1", ">1.0.post1", "===1.0", ">=1!0"]


def test_specifier_sets_against_the_published_implementation(spark):
    packaging = pytest.importorskip("packaging.specifiers")
    from packaging.version import Version

    all_ = [v.strip() for many in ORDER for v in many]
    pairs = list(itertools.product(all_, SPECS))
    df = spark.createDataFrame(pairs, "v string, s string").repartition(4)
    got = {(r["v"], r["s"]): r["x"] for r in df.withColumn("x", versions.satisfies(F.col("v"), F.col("s"), True)).collect()}
    for v, s in pairs:
        if not s.startswith("===") or v == str(Version(v)):
            assert got[v, s] == packaging.SpecifierSet(s).contains(v, prereleases=True), (v, s)


@pytest.mark.parametrize("version, spec, held", [("1.0a1", ">=0.9", False), ("1.0a1", ">=1.0a1", True), ("1.0a2", "", False), ("1.0", "", True), ("1.0.dev1", "<=1.0", False), ("1.1.dev1", ">=1.0.dev1", True)])
def test_prereleases_are_in_sets_that_name_one(spark, version, spec, held):
    assert spark.range(1).select(versions.satisfies(F.lit(version), F.lit(spec))).first()[0] is held


@pytest.mark.parametrize("spec", ["1.0", "=>1", "~=1", ">=1.*", ">=x"])
def test_unreadable_sets_are_null(spark, spec):
    assert spark.range(1).select(versions.satisfies(F.lit("1.0"), F.lit(spec))).first()[0] is None


def test_each_distinct_pair_is_judged_once(spark):
    rows = [(k, v, s) for k, (v, s) in enumerate([("1.0", ">=1"), ("1.0", ">=1"), ("1.0", "<1"), (None, ">=1"), ("1.0", None), ("x", ">=1"), ("1.0\x01", ""), ("\x01" * 10, "")])]
    df = spark.createDataFrame(rows, "k int, v string, s string").repartition(3)
    out = versions.fitted(df, "v", "s", "x")
    assert out.columns == ["k", "v", "s", "x"]
    assert [r["x"] for r in out.orderBy("k").collect()] == [True, True, False, None, None, None, None, None]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all("Aggregate" in line for line in lines if "regexp_replace" in line)  # judged after the distinct pairs are found
