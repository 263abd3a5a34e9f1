import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veriloom.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") * r.randrange(1, 5) for _ in range(60)) for _ in range(12)]
    out = [None, "", " \t", "one", "One two", "ONE TWO", "É\xa0É é", "x " * 3000]
    for text in base:
        out.append(text)
        for _ in range(6):
            words = text.split()
            words[r.randrange(60)] = "changed"
            out.append(" ".join(words))
    return dict(enumerate(out + out[:5]))


@pytest.mark.parametrize("unit_rows", [simhash.UNIT_ROWS, 3])
def test_against_brute_force(spark, texts, unit_rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, fp int").repartition(4)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs, unit_rows).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: r["fp"] % (1 << 64) for i, r in rows.items()} == prints
    assert {i: r["component_id"] for i, r in rows.items()} == brute_components(prints)


@pytest.mark.parametrize("unit_rows", [100_000, 40])
def test_planted_neighbours(spark, unit_rows):
    r = random.Random(9)
    prints = {}
    centre = r.getrandbits(64)
    for i in range(300):
        if i % 3:
            centre = r.getrandbits(64) if i % 50 == 1 else centre
            value = centre
            for k in r.sample(range(64), r.randrange(5)):
                value ^= 1 << k
        else:
            value = r.getrandbits(64)
        prints[i] = value
    prints = {i: v for i, v in prints.items() if list(prints.values()).index(v) == i}
    nodes = spark.createDataFrame([(v - (v >> 63 << 64), i) for i, v in prints.items()], "fp bigint, node bigint")
    found = {r["node"]: r["component"] for r in simhash.components(spark, simhash.links(nodes, unit_rows)).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u bigint, v bigint")
    found = {r["node"]: r["component"] for r in simhash.components(spark, edges).collect()}
    assert found == {i: 0 for i in range(1, 301)}


def classes(n, edges):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in edges:
        a, b = sorted((root(int(i)), root(int(j))))
        parent[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("tile", [16, 64, 4096])
def test_tiles_connect_what_all_pairs_connect(tile):
    r = np.random.default_rng(2)
    fp = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    fp[1::2] = fp[::2] ^ (np.uint64(1) << r.integers(0, 63, 250, dtype=np.uint64))
    fp[100:200] = fp[99] ^ (np.uint64(1) << r.integers(0, 63, 100, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 100, dtype=np.uint64))
    tally = Counter()
    edges = simhash.forest(fp, np.arange(500), tile=tile, tally=tally)
    want = [(i, j) for i in range(500) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    assert {tuple(sorted(e)) for e in edges.T.tolist()} <= {tuple(sorted(e)) for e in want} and len(edges.T) < 500
    assert classes(500, edges.T) == classes(500, want)
    tiles = -(-500 // tile)
    assert tally["compared"] + tally["skipped"] == tiles * (tiles + 1) // 2
    if tile == 16:
        assert tally["skipped"] > tally["compared"] / 4


def test_small_groups_share_tiles():
    import pyarrow as pa

    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 62, 6000, dtype=np.int64)
    fp[::3] = fp[1::3] ^ 5
    key = np.repeat(np.arange(2000), 3).astype(np.int32)
    zero = np.zeros(6000, np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, zero, zero, zero, fp, np.arange(6000))], names=["key", "a", "b", "side", "fp", "node"])
    tally = Counter()
    found = [r for part in simhash.unit_links(iter([batch.slice(0, 1001), batch.slice(1001)]), tally) for r in part.to_pylist()]
    assert {(r["u"], r["v"]) for r in found} >= {(3 * k + 1, 3 * k) for k in range(2000)}
    assert tally["compared"] > 50 and tally["skipped"] > 20


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q w e r t y u i o p")], "doc_id bigint, text string")
    rows = sorted(simhash.simhash_report(docs).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in rows if r["component_id"] == 4] == [(4, 4), (4, 4), (None, 4)]
    assert simhash.simhash_report(docs.limit(0)).count() == 0
    assert simhash.keep_one_of_each(docs.filter("doc_id = 4")).count() == 2


def test_null_ids_join_nothing(spark):
    far = ["a b c d e f", "q w e r t y", "z x v n m k", "one two three four five six"]
    near = [" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(402))]
    assert 0 < (brute_print(near[0]) ^ brute_print(near[1])).bit_count() <= 3
    docs = spark.createDataFrame([(None, far[0]), (None, far[1]), (None, near[0]), (7, near[1]), (8, far[2]), (9, far[3])], "doc_id bigint, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect()) == [
        ("7", "7"), ("8", "8"), ("9", "9"), ("None", "7"), ("None", "None"), ("None", "None"),
    ]


def five(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("share", [simhash.HOT_SHARE, 1 << 40])
def test_stage_links_all_of_four_fifths(spark, monkeypatch, share):
    monkeypatch.setattr(simhash, "HOT_SHARE", share)  # a few shingles are hot, or all that two texts have
    r = random.Random(11)
    texts = ["", "one two", "ONE  two", "one two three"]
    for size in (5, 6, 9, 30, 120, 700):
        for _ in range(4):
            base = [f"w{r.randrange(500)}" for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, size // 50, size // 45, size // 40, size // 35):
                words = list(base)
                for _ in range(edits):
                    words[r.randrange(size)] = "changed"
                texts.append(" ".join(words))
            texts.append(" ".join([*base, *(f"v{r.randrange(500)}" for _ in range(size // 5))]))
    texts = list(dict.fromkeys(texts))
    r.shuffle(texts)
    sets, parent = [five(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                wide += (brute_print(texts[i]) ^ brute_print(texts[j])).bit_count() > 3
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert wide > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()} == {root(i) for i in range(len(texts))}


def test_rows_of_shared_shingles_in_any_batches():
    import pyarrow as pa

    r = random.Random(4)
    size_of = [r.choice([5, 6, 9, 40, 41, 50]) for _ in range(30)]
    rows = sorted(((r.randrange(60), size_of[k], r.randrange(3), k) for k in range(30) for _ in range(10)), key=lambda x: (x[0], x[1], x[3]))
    rows += [(100, 7, 0, k) for k in range(50)] + [(101, 7, 0, 3), (102, 7, 0, 3), (102, 7, 0, 3), (103, 7, 0, 3)]
    rows = [(*x, int(x[0] == 101)) for x in rows]
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], names=["h", "n", "place", "node", "hot"]) for k in range(0, len(rows), size)]  # noqa: B905
        got = [tuple(x.values()) for b in simhash.shared_rows(iter(batches)) for x in b.to_pylist()]
        want, last = [], None
        for h, n, place, node, hot in rows:
            if last and (last[0], last[3]) == (h, node):
                continue
            mine = [x for x in rows if x[0] == h]
            if hot or len({x[3] for x in mine}) > 1:
                alike = [x[3] for x in mine if math.floor(math.log(x[1]) / math.log(1.25)) == math.floor(math.log(n) / math.log(1.25))]
                want.append((h, n, place, node, hot, last[3] if last and last[0] == h else node, alike[0]))
            last = (h, n, place, node)
        assert got == want


def test_sketches_never_say_more_than_the_sets():
    r = random.Random(8)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 40, 511, 512, 513, 900, 3000)]
    sets += [np.unique(np.concatenate([s[len(s) // 10 :], np.array([r.getrandbits(64)], np.uint64)])) for s in sets]

    def sketch(some):
        size = max(simhash.SKETCH, 1 << (len(some) - 1).bit_length())
        bits = np.bincount((some >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size) & 1
        return np.packbits(bits.astype(np.uint8)).tobytes()

    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    apart = simhash.sketches_apart([sketch(sets[i]) for i, _ in pairs], [sketch(sets[j]) for _, j in pairs])
    for (i, j), n in zip(pairs, apart.tolist(), strict=True):
        assert n <= len(np.setxor1d(sets[i], sets[j])) and (i != j or n == 0)
    far = [n for (i, j), n in zip(pairs, apart.tolist(), strict=True) if {i, j} == {4, 5}]
    assert min(far) > 200
    assert len(simhash.sketches_apart([], [])) == 0


def test_a_cluster_costs_its_size(spark):
    """Near copies of one text: all become one class, and no join makes pairs of them all."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(400):
        words = list(base)
        words[r.randrange(300)] = f"v{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    common, hot, salts = simhash.common_shingles(docs)
    assert len(hot) > 100 and salts == 16
    marks = simhash.written(simhash.prefixes(docs, common), "marks")
    shared = simhash.shared_shingles(marks, hot, salts)
    sizes = []
    original = simhash.confirmed

    def counting(pairs, nodes, docs):
        sizes.append(pairs.count())
        return original(pairs, nodes, docs)

    simhash.confirmed = counting
    try:
        found = {x["node"]: x["class"] for x in simhash.near_classes(docs, marks, shared, salts).collect()}
    finally:
        simhash.confirmed = original
    assert len(set(found.values())) == 1 and len(found) >= 399
    assert sum(sizes) < 20 * 400


def test_unlike_texts_that_share_a_passage_do_not_meet(spark, monkeypatch):
    """A passage that the sample doesn't know stands in many prefixes; it is put last, and no texts are compared for it."""
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join([*(f"w{i}x{k}" for k in range(60)), passage, *(f"v{i}x{k}" for k in range(r.randrange(20)))]) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(simhash, "SAMPLE", 1)  # some one document or none is sampled
    monkeypatch.setattr(simhash, "CROWD", 50)
    common, hot, _ = simhash.common_shingles(docs)
    before = simhash.shared_shingles(simhash.written(simhash.prefixes(docs, common), "marks"), hot, 16)
    marks, shared, salts = simhash.marked_prefixes(docs)
    assert before.count() > 3000 and shared.count() * 8 < before.count()
    assert (shared.groupBy("h").count().agg({"count": "max"}).first()[0] or 0) <= 50
    pairs = []
    original = simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda p, nodes, docs: (pairs.append(p.count()), original(p, nodes, docs))[1])
    assert simhash.near_classes(docs, marks, shared, salts).count() == 0 and sum(pairs) < 3000
    assert simhash.keep_one_of_each(docs).count() == 600


def test_stage_keeps_texts_without_id(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(None, "a b c d e f"), (None, "q w e r t y"), (None, long), (7, long + " more"), (5, "A one"), (5, "C one"), (3, "c ONE")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(None, "a b c d e f"), (None, "q w e r t y"), (7, long + " more"), (5, "A one"), (3, "c ONE")]
    assert sorted((tuple(r) for r in simhash.keep_one_of_each(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_stage_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(5, "a b", "i", "d"), (3, "A  b", "j", "e")], "doc_id bigint, text string, id string, body string")
    assert [tuple(r) for r in simhash.keep_one_of_each(docs).collect()] == [(3, "A  b", "j", "e")]


def test_largest_id_is_an_id(spark):
    docs = spark.createDataFrame([(2**63 - 1, "one two three four"), (None, "one two three four"), (None, "other words of another text")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_report(docs).collect()), key=str)
    assert got == sorted([(2**63 - 1, 2**63 - 1), (None, 2**63 - 1), (None, None)], key=str)
