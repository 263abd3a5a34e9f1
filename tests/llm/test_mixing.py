import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from veriloom.llm import mixing


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), h)
    return h


def signed(h):
    return h - (h >> 63 << 64)


def permuted(i, n, key):
    for r in range(mixing.ROUNDS):
        other = (signed(chained(key, r)) % n - i) % n
        if chained(key, r, max(i, other)) & 1:
            i = other
    return i


def brute_targets(sizes):
    names = sorted((x for x in sizes if x is not None), key=str) + [None] * (None in sizes)
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}
    left, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [x for x in names if x not in full]
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] > 2 * sizes[x]]
        if not over:
            return names, share | {x: Fraction(2 * sizes[x]) for x in full}
        full |= set(over)
        left -= sum(2 * sizes[x] for x in over)


def brute_mix(rows, block, shard):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    names, target = brute_targets(totals)
    quota, taken, spans, low = {}, Counter(), [], 0
    for k, name in enumerate(names):
        w = totals[name]
        if not w:
            continue
        n, words = -(-w // block), int(float(target[name]) + 0.5)
        order = [[permuted(i, n, signed(chained(mixing.SEED, k, e))) for i in range(n)] for e in range(3)]
        assert all(sorted(o) == list(range(n)) for o in order)
        slots, left = [], words
        for e in range(3):
            for b in order[e]:
                if left > 0:
                    here = min(left, block if b < n - 1 else w - block * (n - 1))
                    slots.append((b, here))
                    left -= here
        quota[k] = slots
        spans.append((low, low + len(slots), k))
        low += len(slots)
    counts = defaultdict(Counter)
    for i in range(low):
        u = signed(chained(mixing.SEED + 1, i)) % low
        counts[next(k for a, b, k in spans if a <= u < b)][i // shard] += 1
    streams = defaultdict(list)
    for i, t, s in rows:
        streams[s].append((chained(mixing.SEED + 2, i), i, size(t)))
    for k, name in enumerate(names):
        uses = defaultdict(list)
        for b, here in quota.get(k, ()):
            uses[b].append(here)
        at = 0
        for _, i, n in sorted(streams[name]):
            for w in range(at, at + n):
                taken[i] += sum(w % block < here for here in uses[w // block])
            at += n
    return totals, target, taken, {k: len(v) for k, v in quota.items()}, counts


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for i in range(160):
        source = r.choice(["hot"] * 6 + ["a", "b", "É", "z", None, "", "tiny"])
        n = r.choice([0, 1, 7, 40, 300])
        out.append((i, " ".join("w" * r.randrange(1, 4) for _ in range(n)) if n else r.choice([None, "", " "]), source))
    return out


@pytest.mark.parametrize("block, shard", [(16, 64), (64, 8), (7, 10_000)])
def test_against_brute_force(spark, rows, block, shard):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, size string").repartition(5)
    mix = mixing.Mix(docs, block, shard)
    totals, target, taken, quota, counts = brute_mix(rows, block, shard)
    got = {r["doc_id"]: r for r in mix.taken().collect()}
    assert len(got) == len(rows)
    for i, _, source in rows:
        assert got[i]["source_size"] == totals[source] and abs(got[i]["target"] - target[source]) < 1e-6
        assert got[i]["taken"] == taken[i] <= 2 * got[i]["size"]
    for source in totals:
        assert abs(sum(taken[i] for i, _, s in rows if s == source) - target[source]) <= 0.5
    slots = mix.slots.groupBy("s").agg(F.count("*").alias("n")).collect()
    assert {r["s"]: r["n"] for r in slots} == quota
    shards = {(r["shard"], r["s"]): r["n"] for r in mix.slots.groupBy("shard", "s").agg(F.count("*").alias("n")).collect()}
    for k, by_shard in counts.items():  # the draws stand but for slots beyond a source's quota
        before = 0
        for n, c in sorted(by_shard.items()):
            assert shards.get((n, k), 0) >= min(c, max(0, quota[k] - before))
            before += c


def test_mixed_documents(spark, rows):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, n_chars bigint")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    out = mixing.mixed_documents(docs).collect()
    words, texts = Counter(), dict((i, t) for i, t, _ in rows)
    for r in out:
        n = len(r["text"].split())
        words[r["doc_id"]] += n
        assert n and r["n_chars"] == len(r["text"])
        if n == len(texts[r["doc_id"]].split()):
            assert r["text"] == texts[r["doc_id"]]
    assert words == {i: n for i, n in taken.items() if n}


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (1, "x", "t"), (2, None, None)], "doc_id bigint, text string, source string")
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 5 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == sum(len(r["text"].split()) for r in mixing.mixed_documents(docs).collect())
    assert mixing.mix_report(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_report(docs.filter("text is null")).collect()} == {0}


def test_slots_are_spread_where_one_source_has_nearly_all(spark):
    sizes = [(0, 25_600_000), (1, 1_400_000), (2, 1_400_000)]
    sources = spark.createDataFrame([(s, n, 1.4 * n) for s, n in sizes], "s bigint, source_size bigint, target double")
    slots = mixing.draw(mixing.quotas(sources))
    kept = slots.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    tasks, total = 8, sum(r["n"] for r in kept)
    assert total == sum(r["slots"] for r in mixing.quotas(sources).collect())
    assert max(r["n"] for r in kept) <= 2 * total / tasks
    assert slots.select("s", "j").distinct().count() == total


def test_ids_null_or_repeated_and_clashing_names(spark):
    names = "doc_id bigint, text string, source string, id string, `_id` string, hash string, copy int, uses int, `__id` string, epoch int, s int"
    rows = [(i, t, s, "i", "j", "h", 4, 5, "k", 6, k) for k, (i, t, s) in enumerate([(None, "a b c d", "s"), (None, "e f g", "s"), (None, "e f g", None), (3, "p q r", "s"), (3, "x y", "s"), (3, "x y", ""), (3, "x y", "s")])]
    docs = spark.createDataFrame(rows, names)
    out = mixing.mixed_documents(docs).collect()
    assert all((r["id"], r["_id"], r["hash"], r["copy"], r["uses"], r["__id"], r["epoch"]) == ("i", "j", "h", 4, 5, "k", 6) for r in out)
    words = Counter()
    for r in out:
        whole = rows[r["s"]]
        assert (r["doc_id"], r["source"]) == (whole[0], whole[2]) and set(r["text"].split()) <= set(whole[1].split())
        words[r["doc_id"], r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in mixing.Mix(docs).rows.join(mixing.targets(mixing.sized(docs)).select("s", "source"), ["s"]).collect():
        taken[r["doc_id"]] += r["size"]
    reported = Counter()
    for r in mixing.mix_report(docs).collect():
        assert r["taken"] <= 2 * r["size"]
        reported[r["doc_id"]] += r["taken"]
    got = Counter()
    for (i, _), n in words.items():
        got[i] += n
    assert got == reported
