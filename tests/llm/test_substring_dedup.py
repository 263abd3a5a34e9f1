import hashlib
import random

import pytest

from veriloom.llm import substring_dedup


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - window + 1) if least[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [2, 40, 5000])
def test_against_brute_force(spark, vocabulary):
    r = random.Random(vocabulary)

    def fresh(n):
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    passages = [fresh(n) for n in (49, 50, 51, 75, 140)]
    texts = [None, "", " ", "same word " * 200, "same word " * 130, "same " * 300, " ".join(passages[1]), " ".join(passages[4]), " ".join(passages[4])]
    for _ in range(50):
        words = fresh(r.randrange(1, 40))
        for _ in range(r.randrange(4)):
            p = list(r.choice(passages))
            a, b = sorted((r.randrange(len(p)), r.randrange(len(p) + 1)))
            if r.random() < 0.5:
                p = p[a:b]
            if p and r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            words += p + fresh(r.randrange(12))
        texts.append("\n".join([" ".join(words[:20]), "\t".join(words[20:])]))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, spans int").repartition(3)
    got = sorted(map(tuple, substring_dedup.substring_report(docs).collect()))
    assert got == brute(rows, 50)


def brute_factors(rows, window, gram):
    """The parse word by word: which (reference, distance) each word may be copied by, then greedily the longest copy."""
    words = {i: (t or "").split() for i, t in rows}
    blocks, first_block, first_window = {}, {}, {}
    for i in sorted(words):
        w = words[i]
        spots = substring_dedup.Words(" ".join(w)).anchors(window, gram).tolist() if len(w) >= window else []
        blocks[i] = []
        for at in sorted(set(spots)):
            a, b = max(0, at + gram - window), min(len(w), at + window)
            key = (tuple(w[at : at + gram]), tuple(w[a:b]), at - a)
            first_block.setdefault(key, (i, a))
            blocks[i].append((at, a, b, key))
        for p, at in enumerate(spots):
            first_window.setdefault(tuple(w[p : p + window]), (i, p))
            blocks[i].append((None, p, p + window, at))
    out = {}
    for i, w in words.items():
        copies = {}
        whole = {at for at, a, b, key in blocks[i] if at is not None and first_block[key][0] < i}
        for at, a, b, key in blocks[i]:
            ref = first_block[key] if at is not None else first_window[tuple(w[a:b])]
            if ref[0] < i and (at is not None or key not in whole):
                copies.setdefault((ref[0], ref[1] - a), set()).update(range(a, b))
        found, at = [], 0
        while at + window <= len(w):
            best = None
            for (ref, shift), inside in copies.items():
                end = at
                while end in inside:
                    end += 1
                if end - at >= window and (best is None or (-end, ref, shift) < best):
                    best = (-end, ref, shift)
            if best:
                found.append((at, -best[0] - at, best[1], at + best[2]))
                at = -best[0]
            else:
                at += 1
        out[i] = found
    return words, out


@pytest.mark.parametrize("vocabulary", [3, 60])
def test_factors_against_a_greedy_parse(spark, vocabulary):
    r = random.Random(vocabulary)
    fresh = lambda n: [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    passages = [fresh(n) for n in (12, 20, 33, 60)]
    rows = []
    for i in range(60):
        words = fresh(r.randrange(12))
        for _ in range(r.randrange(4)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            words += p + fresh(r.randrange(4))
        rows.append((i, " ".join(words)))
    words, want = brute_factors(rows, 10, 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x["doc_id"]: [tuple(f) for f in x["factors"]] for x in substring_dedup.substring_dedup(docs, 10, 3, with_factors=True).collect()}
    assert got == want and sum(map(len, got.values())) > 40
    for i, factors in got.items():
        for start, n, ref, ref_start in factors:
            assert ref < i and n >= 10 and words[i][start : start + n] == words[ref][ref_start : ref_start + n]


def test_rows_without_id_or_with_one_id_keep_their_own_words(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    for rows in ([(1, a), (None, a), (None, b)], [(1, a), (3, a), (3, b)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted((str(r["doc_id"]), r["kept"]) for r in substring_dedup.substring_dedup(docs).collect())
        assert got == sorted([(str(rows[0][0]), a), (str(rows[1][0]), ""), (str(rows[2][0]), b)])


def test_null_id_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id bigint, text string")
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_report(docs).collect()), key=str)
    assert rows == [(3, 0), (3, 0), (None, 60)]
    assert substring_dedup.substring_report(docs.limit(0)).count() == 0


def covered(spans):
    return {q for a, b in spans for q in range(a, b)}


def test_the_parse_decides_the_spans():
    import numpy as np

    r = random.Random(11)
    window, broken = 5, {"none": 0, "last": 0, "short": 0}
    for _ in range(3000):
        rows = [(s, r.randrange(5, 14), r.randrange(3), r.randrange(4) + s) for s in (r.randrange(30) for _ in range(r.randrange(1, 9)))]
        rows = [(s, max(n, window), ref, at) for s, n, ref, at in rows]
        want = covered((s, s + n) for s, n, *_ in rows)  # all windows of all matches
        factors, spans = substring_dedup.factorise(np.array(rows), window)
        assert covered(spans.tolist()) == want
        assert all(a + n <= b for (a, n, *_), (b, *_) in zip(factors.tolist(), factors[1:].tolist()))  # noqa: B905
        joined = substring_dedup.joined_matches(np.array(rows))
        shorter = [(a, window, ref, at) for a, n, ref, at in factors.tolist()]  # a parse that isn't greedy
        for name, other in (("none", []), ("last", factors.tolist()[:-1]), ("short", shorter)):
            broken[name] += covered(substring_dedup.duplicate_spans(other, joined, window)) != want
    assert broken["none"] == 3000 and broken["last"] > 2000 and broken["short"] > 300
