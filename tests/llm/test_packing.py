import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import packing, token_store
from veriloom.llm.tokens import TextEncoder, default_tokenizer

TEXTS = ["", None, " ", "  two  spaces ", "a" * 9000, "word " * 5000, "Zürich 日本 ''s don't\n\n end.", "x\ty\r\nz", "same", "same", "<|endoftext|>"]


@pytest.fixture(scope="module")
def truth():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 7, x, "extra") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, part string").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def exact_bins(sizes, capacity):
    best = len(sizes)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best or best == -(-sum(sizes) // capacity):
            return
        if not rest:
            best = len(bins)
            return
        s, *more = rest
        for k in {b: i for i, b in enumerate(bins) if b + s <= capacity}.values():
            go(more, [*bins[:k], bins[k] + s, *bins[k + 1 :]])
        go(more, [*bins, s])

    go(sorted(sizes, reverse=True), [])
    return best


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    encode = TextEncoder(default_tokenizer()).encode
    marks = [" ", "  ", "\n", "ab", "é", ".", "'", "s", " the", "1", "²", "日", "ſ", "_"]
    for n in (1, 2, 3):
        for parts in itertools.product(marks, repeat=n):
            text = "".join(parts)
            assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_completion_is_optimal_on_small_histograms():
    random = np.random.default_rng(7)
    for _ in range(60):
        sizes = random.integers(1, 30, random.integers(1, 11)).tolist()
        plan = packing.complete_bins(np.bincount(sizes, minlength=31), 30)
        assert all(sum(p) <= 30 for p, _ in plan.patterns)
        packed = sorted(s for p, n in plan.patterns for s in p * n)
        assert packed == sorted(sizes)
        assert plan.sequences == exact_bins(sizes, 30)


def test_completion_is_optimal_on_random_instances():
    random = np.random.default_rng(5)
    assert packing.complete_bins(np.bincount([51, 46, 47, 27, 38, 37, 31, 37, 32, 17, 31, 42, 48], minlength=101), 100).sequences == 5
    harder = 0
    for _ in range(1000):
        capacity = int(random.choice([30, 60, 100]))
        sizes = random.integers(int(random.choice([1, capacity // 6])), capacity * 6 // 10, random.integers(9, 14)).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.complete_bins(counts, capacity)
        assert sorted(s for p, n in plan.patterns for s in p * n) == sorted(sizes) and all(sum(p) <= capacity for p, _ in plan.patterns)
        assert plan.proven and plan.bound <= plan.sequences == exact_bins(sizes, capacity)
        harder += packing.best_fit(counts, capacity).sequences > plan.sequences
    assert harder > 20


def test_fillings_and_dominance_against_all_subsets():
    random = np.random.default_rng(8)
    for _ in range(60):
        items, room = random.integers(1, 12, 7).tolist(), int(random.integers(1, 25))
        left = np.bincount(items, minlength=40)
        want = {tuple(sorted(c)) for n in range(8) for c in itertools.combinations(items, n) if sum(c) <= room}
        got = {tuple(sorted(x for s, n in f for x in [s] * n)): (f, waste) for f, waste in packing.fillings(room, left, room)}
        assert set(got) == want and all(w == room - sum(k) for k, (_, w) in got.items())
        for key, (filling, waste) in got.items():
            rest = list(items)
            for x in key:
                rest.remove(x)
            parts = {(sum(c), len(c)) for n in range(len(key) + 1) for c in itertools.combinations(key, n)}
            bad = any(t < x <= t + waste or t == x and n > 1 for x in rest for t, n in parts)
            assert packing.dominated(filling, waste, sum(1 << x for x in set(rest))) == bad


def test_completion_beats_or_meets_best_fit_and_its_size_does_not_follow_the_counts():
    random = np.random.default_rng(3)
    counts = np.bincount(random.integers(1, 2049, 3000), minlength=2049)
    for factor in (1, 1000):
        plan = packing.complete_bins(counts * factor, 2048)
        assert packing.lower_bound(counts * factor, 2048) <= plan.sequences <= packing.best_fit(counts * factor, 2048).sequences
        assert len(plan.patterns) < 4 * 2048 and (plan.proven or plan.nodes > 0)


def test_packing_round_trip(docs, truth):
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == crc(ids)
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, want in enumerate(truth):
        pieces = sorted(by_doc.pop(i * 7))
        assert [p for p, *_ in pieces] == list(range(len(pieces)))
        assert list(itertools.chain.from_iterable(ids for *_, ids in pieces)) == want
        assert [at for _, at, _ in pieces] == list(itertools.accumulate((len(p[2]) for p in pieces[:-1]), initial=0))
        assert all(len(ids) == 2048 for *_, ids in pieces[1:])
    assert not by_doc
    for parts in by_sequence.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048


def test_packing_of_nothing(docs):
    assert packing.packing_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_store_round_trip(spark, docs, truth, bits):
    path = token_store.fresh_path(spark, "test")
    token_store.write_tokens(docs, path, bits=bits, partitions=3, block_ids=100, chunk_ids=1000)
    rows = {r["doc_id"]: r for r in token_store.read_tokens(spark, path).collect()}
    start = 0
    for i, want in enumerate(truth):
        r = rows[i * 7]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(want), crc(want), want)
        start += len(want)
    index = spark.read.parquet(path).select("part", "chunk", "n_ids", F.size("plane_len").alias("planes")).collect()
    assert all(r["planes"] == -(-r["n_ids"] // 100) * (16 if bits else 2) for r in index)


def test_token_store_of_nothing(docs):
    assert token_store.token_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(bits, width):
    ids = np.random.default_rng(1).integers(0, 1 << 8 * width, 1237, dtype=np.uint64).astype("<u4")
    assert (token_store.unshuffle_block(token_store.shuffle_block(ids, width, bits), len(ids), width, bits) == ids).all()
