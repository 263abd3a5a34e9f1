import itertools
import math
import random
import zlib

import numpy as np
import pytest

from veriloom.llm import language_id as L


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    return max(sum(scores[t, p[t]] for t in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(k), repeat=n))  # noqa: B905


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    for _ in range(200):
        scores = r.normal(0, 3, (r.integers(1, 7), 3)).round(2)
        penalty = float(r.choice([0.5, 2, 8]))
        path = L.viterbi(scores, penalty).tolist()
        value = sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B905
        assert abs(value - brute_viterbi(scores, penalty)) < 1e-9


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    kinds = {"xx": "abcd", "yy": "efgh", "ru": "абвг"}
    rows = []
    for i in range(300):
        lang = r.choice(list(kinds))
        words = ["".join(r.choice(kinds[lang]) for _ in range(r.randrange(2, 8))) for _ in range(30)]
        rows.append((i, " ".join(words), lang if r.random() < 0.9 else None, "z"))
    rows += [(1000, None, "xx", "z"), (1001, "", "yy", "z"), (1002, "12 -- 34!", "xx", "z"), (None, "abc abcd dcba", None, "z")]
    rows += [(1003, " ".join(["abcd dcab"] * 20 + ["гваб вгба"] * 40), None, "z"), (1004, "αβγ δεζ " * 5 + "abba cdcd abba dada", None, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, spans string").repartition(3)


def test_predictions(docs):
    model = L.fit(docs)
    assert model.languages == ["ru", "xx", "yy"]
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    for r in docs.collect():
        g = got[r["doc_id"]]
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            text = r["text"]
            assert g["lang_pred"] == ("ru" if text[0] in "абвг" else "xx" if text[0] in "abcd" else "yy") and g["score"] == 1
            assert [tuple(s) for s in g["spans"]] == [(0, len(text), g["lang_pred"])]
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (1000, 1001, 1002))
    assert got[None]["lang_pred"] == "xx" and got[None]["held_out"] and got[1004]["lang_pred"] == "xx"
    mixed = got[1003]
    assert [(s["start"], s["lang"]) for s in mixed["spans"]] == [(0, "xx"), (200, "ru")] and mixed["lang_pred"] == "ru"
    assert abs(mixed["score"] - 2 / 3) < 0.01


def test_labels_of_other_rows_do_not_matter(docs):
    from pyspark.sql import functions as F

    rows = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(str, L.language_report(rows).collect())) == sorted(map(str, L.language_report(docs).collect()))


def test_stage_and_empty(docs):
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert L.language_report(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.language_report(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.language_report(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 150 and right / len(rows) >= 0.97


def test_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(L, "STEP", 10)
    text = "ab cdefghijklmnop qİ rs " * 5
    starts = [s + at for at, s, *_ in L.word_features(text)]
    ends = [e + at for at, _, e, *_ in L.word_features(text)]
    assert [text[a:b] for a, b in zip(np.concatenate(starts), np.concatenate(ends), strict=True)] == text.split()


def brute_words(text):
    """(start, end, script, buckets) of the words, letter by letter."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isalpha():
            end += 1
        if end > at:
            buckets = []
            for i in range(at, end):
                a, b, c = (ord(low[k]) if at <= k < end else 0 for k in (i - 1, i, i + 1))
                h = a * 0x9E3779B1 % (1 << 32) ^ b * 0x85EBCA77 % (1 << 32) ^ c * 0xC2B2AE3D % (1 << 32)
                buckets.append((h ^ h >> 15) * 0x2C1B3C6D % (1 << 32) >> 16)
            script = [name for first, name in L.SCRIPT_STARTS if first <= ord(low[at])][-1]
            out.append((at, end, script, buckets))
        at = max(end, at + 1)
    return out


def brute_query(rows):
    """Fit, word scores, script narrowing, Viterbi and spans by plain loops."""
    counts, scripts = {}, {}
    for i, text, lang, *_ in rows:
        if lang is not None and text is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            table, seen = counts.setdefault(lang, {}), scripts.setdefault(lang, {})
            for a, b, script, buckets in brute_words(text):
                seen[script] = seen.get(script, 0) + b - a
                for k in buckets:
                    table[k] = table.get(k, 0) + 1
    names = sorted(counts)
    logs = {n: lambda k, n=n, total=sum(counts[n].values()) + L.SMOOTHING * L.BUCKETS: math.log((counts[n].get(k, 0) + L.SMOOTHING) / total) for n in names}
    out = {}
    for i, text, *_ in rows:
        words = brute_words(text or "")
        if not words or not names:
            out[i] = ("und", 0.0, [])
            continue
        best = None
        for a, b, script, buckets in words:
            may = {n for n in names if scripts[n].get(script, 0) >= L.SCRIPT_SHARE * sum(scripts[n].values())}
            score = {n: sum(map(logs[n], buckets)) + (L.EXCLUDED if n not in may else 0) if may else 0.0 for n in names}
            if best is None:
                best = {n: (score[n], [n]) for n in names}
            else:
                best = {n: max(((v - (L.PENALTY if p[-1] != n else 0) + score[n], [*p, n]) for v, p in best.values()), key=lambda x: (round(x[0], 6), x[1][-2] == n)) for n in names}
        path = max(best.values(), key=lambda x: x[0])[1]
        weight, spans = {n: 0 for n in names}, []
        for (a, b, *_), n in zip(words, path, strict=True):
            weight[n] += b - a
            if spans and spans[-1][2] == n:
                spans[-1] = (spans[-1][0], b, n)
            else:
                spans.append((a, b, n))
        top = max(names, key=lambda n: weight[n])
        out[i] = (top, weight[top] / sum(weight.values()), spans)
    return out


def test_whole_query_against_brute_force(spark):
    r = random.Random(9)
    vocabulary = {n: ["".join(r.choice(chars) for _ in range(r.randrange(1, 8))) for _ in range(25)] for n, chars in {"xx": "abcdeİ", "yy": "cdefgß", "ru": "абвг", "sr": "абвгabc"}.items()}
    rows = []
    for i in range(140):
        lang, words = r.choice(list(vocabulary)), []
        for n in [lang] if r.random() < 0.6 else r.choices(list(vocabulary), k=3):
            words += r.choices(vocabulary[n], k=r.randrange(1, 12))
        text = "".join(w + r.choice([" ", ", ", "\n", "-1 "]) for w in words)
        rows.append((i, r.choice([text, text.upper()]), lang if r.random() < 0.9 else None, "s"))
    rows += [(200, None, "xx", "s"), (201, "", None, "s"), (202, "12 3", "yy", "s"), (203, "αβγ δε", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)
    got = {x["doc_id"]: x for x in L.language_report(docs).collect()}
    want = brute_query(rows)
    assert len({x[0] for x in want.values()}) == 5 and sum(len(x[2]) > 1 for x in want.values()) > 20
    for i, (lang, score, spans) in want.items():
        assert (got[i]["lang_pred"], [tuple(s) for s in got[i]["spans"]]) == (lang, spans), (i, rows[i] if i < 140 else i)
        assert abs(got[i]["score"] - score) < 1e-9
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
