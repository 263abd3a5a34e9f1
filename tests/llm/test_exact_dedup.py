import hashlib
import random
import re

import pytest

from veriloom.llm import exact_dedup as E


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = [None, "", " ", "a  b", "a\tb", "a b ", "a\xa0b", "É", "é", "x" * 100_000] + ["hot copy"] * 30
    out = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(out)
    return out


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "doc_id bigint, text string, digest string, keep_id int").repartition(4)
    got = {r["doc_id"]: r for r in E.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), i == min(same))
        assert r["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()


def test_index_persists_and_only_new_digests_are_appended(spark, rows):
    from pyspark.sql import functions as F

    first = E.DigestIndex(spark, buckets=4)
    digests = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", E.digest(F.col("text")).alias("digest"))
    first.append_new(digests.filter("doc_id < 20"), 0)
    n = first.rows().count()
    first.close()
    again = E.DigestIndex(spark, path=first.path)  # another session, with 8 shuffle partitions, would open it this way
    assert again.buckets == 4
    with pytest.raises(ValueError):
        E.DigestIndex(spark, path=first.path, buckets=8)
    again.append_new(digests, 1)
    again.append_new(digests, 2)  # run again after a crash
    distinct = len({norm(t) for _, t in rows})
    assert again.rows().count() == distinct and again.rows().filter("batch = 0").count() == n
    plan = again.rows().join(again.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan.split("Physical Plan")[-1]


def test_stage(spark):
    docs = spark.createDataFrame([(5, "a b", "x"), (3, "a  b", "y"), (3, "a  b", "y"), (None, "q", "z"), (7, "q", "w")], "doc_id bigint, text string, source string")
    kept = sorted((tuple(r) for r in E.keep_first_copies(docs).collect()), key=str)
    assert kept == [(3, "a  b", "y"), (7, "q", "w")]
    assert E.exact_dedup(docs.limit(0)).count() == 0 and E.keep_first_copies(docs.limit(0)).count() == 0


def test_all_ids_null(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    rows = E.exact_dedup(docs).collect()
    assert len(rows) == 3 and all(r["kept"] and r["keep_id"] is None for r in rows)
    assert sorted(r["text"] for r in E.keep_first_copies(docs).collect()) == ["a", "b"]


def test_ids_null_or_repeated_keep_each_text(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (5, "A"), (5, "C"), (3, "C")], "doc_id bigint, text string")
    kept = sorted((tuple(r) for r in E.keep_first_copies(docs).collect()), key=str)
    assert kept == sorted([(None, "a"), (None, "b"), (5, "A"), (3, "C")], key=str)


def test_stage_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(5, "a", "i", "d", "c"), (3, "a", "j", "e", "c")], "doc_id bigint, text string, id string, digest string, _copy string")
    assert [tuple(r) for r in E.keep_first_copies(docs).collect()] == [(3, "a", "j", "e", "c")]


@pytest.mark.parametrize("kind,ids", [("int", (2**31 - 2, 2**31 - 1)), ("int", (-(2**31), -(2**31) + 1)), ("bigint", (2**63 - 3, 2**63 - 2)), ("bigint", (-(2**63), -(2**63) + 1)), ("bigint", (-(2**63), 2**63 - 2))])
def test_ids_at_the_ends_of_their_type(spark, kind, ids):
    low, high = ids
    docs = spark.createDataFrame([(low, "a"), (high, "a"), (high, "b"), (None, "c")], f"doc_id {kind}, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in E.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(low, low, True), (high, low, False), (high, high, True), (None, None, True)], key=str)
    assert sorted((tuple(r) for r in E.keep_first_copies(docs).collect()), key=str) == sorted([(low, "a"), (high, "b"), (None, "c")], key=str)
