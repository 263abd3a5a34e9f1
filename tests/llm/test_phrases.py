import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veriloom.llm import phrases

COLUMNS = "doc_id bigint, text string, lang string, n bigint, suffix string"


def brute_force(rows, max_words=5, least=100, top=2000, held_percent=100):
    found = {}
    for text, lang in rows:
        own = found.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words)):
                for k in range(1, min(max_words, len(words) - i) + 1):
                    own[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in found.items():
        n = sum(v for k, v in own.items() if len(k) == 1)
        often = {k: v for k, v in own.items() if v >= least and len(k) > 1}
        scored = []
        for k, a in often.items():
            if any(len(x) > len(k) and 100 * f >= held_percent * a and any(x[i : i + len(k)] == k for i in range(len(x))) for x, f in often.items()):
                continue
            score, cut = min((1000 * a * n // (own[k[:i]] * own[k[i:]]), i) for i in range(1, len(k)))
            scored.append((-score, -a, " ".join(k).encode(), a, own[k[:cut]], own[k[cut:]], n, score))
        out += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(spark, rows, partitions=4, **options):
    docs = spark.createDataFrame([(i, *row, 0, "x") for i, row in enumerate(rows)], COLUMNS).repartition(partitions)
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


TEXTS = [
    ("The cat sat. The CAT sat, on the\tmat\n the cat  sat", "en"), (None, "en"), ("", None), ("  \t ", None), ("the cat the cat the cat the cat", None),
    ("na na na na na na na na na na", "en"), ("ÄÖ äö ÄÖ äö ÄÖ", "de"), ("a\x00b a\x01c a\x00b a\x01c a\x00b a\x01c", "zz"), ("x\x1cy \x0b x\x1cy q\x0cx\x1cy q", "zz"),
    ("the cat the cat the cat the cat", "und"), ("日本 語 日本 語 日本 語", ""), ("w" * 5000 + " tail " + "w" * 5000 + " tail", "en"),
]


@pytest.mark.parametrize("options", [{"least": 2}, {"least": 1, "max_words": 3}, {"least": 2, "top": 2}, {"least": 2, "held_percent": 60}, {"least": 3, "max_words": 6}])
def test_whole_operator_against_brute_force(spark, options):
    assert made(spark, TEXTS * 2, **options) == brute_force(TEXTS * 2, **options)


def test_crowded_prefixes_are_split_and_summed(spark, monkeypatch):
    random = np.random.default_rng(3)
    words = ["hot"] * 12 + ["warm"] * 4 + list("abcdefghij")
    rows = [(" ".join(random.choice(words, 60)), "en" if i % 3 else "fr") for i in range(120)]
    docs = spark.createDataFrame([(i, *row, 0, "x") for i, row in enumerate(rows)], COLUMNS).repartition(4)
    crowded = phrases.crowded_prefixes(docs.select(docs.lang.cast("binary"), docs.text.cast("binary")), 5, 8)
    assert {b"en\0hot", b"en\0hot\0hot"} <= crowded and b"en\0a" not in crowded
    parts = phrases.dealt_suffixes(docs.select(docs.lang.cast("binary"), docs.text.cast("binary")), 5, 8)
    dealt = {}
    for row in parts.collect():
        dealt.setdefault(bytes(row["suffix"]).split(b"\0")[1], set()).add(row["deal"])
    assert len(dealt[b"hot"]) > 20 and len(dealt[b"a"]) == 2  # one for each language
    assert made(spark, rows, least=20) == brute_force(rows, least=20)


def test_small_flushes_change_nothing(spark, monkeypatch):
    counts = lambda: sorted((k, lang, n) for some in phrases.suffix_counts(iter([batch]), 3) for lang, own in some.items() for k, n in own.items())
    batch = pa.RecordBatch.from_arrays([pa.array([b"en", b"fr", b"en"]), pa.array([b"a b c a b c", None, b"a b. c" * 50])], names=["lang", "text"])
    whole = counts()
    monkeypatch.setattr(phrases, "HELD_SUFFIXES", 2)
    summed = Counter()
    for k, lang, n in counts():
        summed[k, lang] += n
    assert sorted((*k, n) for k, n in summed.items()) == whole


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_stack_over_batches_of_any_size(size):
    random = np.random.default_rng(size)
    found = Counter(b"\0".join([b"en", *(random.choice([b"a", b"ab", b"b", b"a" * 300, b"a" * 300 + b"x", b"a" * 700]) for _ in range(random.integers(1, 5)))]) for _ in range(600))
    rows = [(k, int(n)) for k, n in sorted(found.items(), reverse=True) for n in ([n] if random.random() < 0.5 else [1] * n)]
    want = Counter()
    for k, n in found.items():
        words = k.split(b"\0")
        for i in range(1, len(words) + 1):
            want[b"\0".join(words[:i])] += n
    for least in (1, 5):
        stack, got = phrases.PrefixStack(5, least), []
        for low in range(0, len(rows), size):
            some = rows[low : low + size]
            got += stack.push(pa.array([k for k, _ in some]), np.array([n for _, n in some]), np.zeros(len(some), int))
        got += stack.end()
        assert sorted(got) == sorted((k, n) for k, n in want.items() if n >= least)


def test_escapes_keep_words_apart_and_in_order():
    words = [b"", b"a", b"a\0", b"a\1", b"a\1\1", b"a\1\2", b"\0\1\2", b"\1\1\0"]
    assert [phrases.restored(phrases.escaped(w)) for w in words] == words
    assert sorted(map(phrases.escaped, words)) == [phrases.escaped(w) for w in sorted(words)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark, monkeypatch):
    n = 10**13
    counts = spark.createDataFrame([("en", "", n), ("en", "a", n - 1), ("en", "b", n - 2), ("en", "a b", n - 3)], "lang string, phrase string, n bigint")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: counts)
    row = phrases.collocations(counts).first()
    assert row["score"] == 1000 * (n - 3) * n // ((n - 1) * (n - 2))


def test_giant_words(spark):
    rows = [("x" * 300_000 + " y " + "x" * 300_000 + " y", "en")] * 3
    got = made(spark, rows, least=3)
    assert got == brute_force(rows, least=3)
