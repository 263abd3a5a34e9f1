import random
import time

import numpy as np
import pytest

from veriloom.operators import matcher


def brute_force(texts, tokens):
    return sorted({(repr(i), t) for i, text in texts for t in tokens if t and text and t in text})


def found(spark, texts, tokens, kind="int"):
    rows = spark.createDataFrame(texts, f"id {kind}, body string").repartition(3)
    held = spark.createDataFrame([(t,) for t in tokens], "tok string")
    out = matcher.tokens_inside(rows, "id", "body", held, "tok")
    assert out.columns == ["id", "tok"]
    return sorted((repr(r["id"]), r["tok"]) for r in out.collect())


TOKENS = ["a", "ab", "aba", "abab", "é", "日本語", "x" * 31, "x" * 32, "x" * 33, "run-1", "run-12", "run-123456789", "1234567", "\x00z", "end", "needle " * 40, "", None, "ab", "zz" * 700]


@pytest.mark.parametrize("block, few, most", [(1 << 20, 200_000, 1 << 28), (64, 0, 1 << 15), (7, 200_000, 1 << 15)])
def test_against_brute_force(spark, monkeypatch, block, few, most):
    monkeypatch.setattr(matcher, "BLOCK", block)
    monkeypatch.setattr(matcher, "FEW_TOKENS", few)
    monkeypatch.setattr(matcher, "MOST_BITS", most)
    random.seed(block)
    texts = [(1, None), (2, ""), (3, "abab"), (3, "abab"), (None, "é日本語"), (4, "x" * 100), (5, "run-123456789run-12"), (6, "q\x00z"), (7, "needle " * 41), (8, "need"), (9, "z" * 1400), (10, "z" * 1399)]
    texts += [(100 + k, "".join(random.choice("ab1x日 ") for _ in range(random.randrange(200)))) for k in range(40)]
    tokens = [*TOKENS, *("".join(random.choice("ab1x日 ") for _ in range(random.randrange(1, 9))) for _ in range(60))]
    assert found(spark, texts, tokens) == brute_force(texts, tokens)


def test_tokens_do_not_reach_over_two_texts(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "def"), (3, "xxabcdefxx")], "id int, body string").coalesce(1)
    held = spark.createDataFrame([("cd",), ("abcdef",), ("fx",)], "tok string")
    assert sorted(tuple(r) for r in matcher.tokens_inside(rows, "id", "body", held, "tok").collect()) == [(3, "abcdef"), (3, "cd"), (3, "fx")]


def test_no_tokens_no_texts_and_text_ids(spark):
    assert found(spark, [(1, "a")], [None, ""]) == []
    assert found(spark, [("k", "it's here"), (None, "here")], ["here"], "string") == [("'k'", "here"), ("None", "here")]
    empty = spark.createDataFrame([], "id int, body string")
    assert matcher.tokens_inside(empty, "id", "body", spark.createDataFrame([("a",)], "tok string"), "tok").collect() == []


def test_only_hits_are_shuffled(spark):
    rows = spark.createDataFrame([(i, "some words and run-77 " * 50) for i in range(50)], "id int, body string")
    held = spark.createDataFrame([(f"run-{i}",) for i in range(60, 90)] + [("not there",)], "tok string")
    hits = matcher.tokens_inside(rows, "id", "body", held, "tok")
    assert hits.count() == 50
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_time_follows_the_text():
    random.seed(1)
    classes, bitmap = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], np.zeros(1 << 13, np.uint8)
    bitmap[5] = 1

    def seconds(n):
        data = np.frombuffer(random.randbytes(n), np.uint8)
        began = time.perf_counter()
        sum(1 for _ in matcher.block_hits(data, np.array([0, n]), classes, bitmap))
        return time.perf_counter() - began

    seconds(1 << 16)
    assert seconds(8 << 20) < 8 * 3 * max(seconds(1 << 20), 0.05)
