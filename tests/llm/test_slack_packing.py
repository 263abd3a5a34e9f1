import itertools
import zlib

import numpy as np
import pytest

from veriloom.llm import slack_packing
from veriloom.llm.slack_packing import SlackPlan, word_tokenizer
from veriloom.llm.tokens import WordEncoder, encoder

TEXTS = ["", None, " ", "It's  DON'T 123abc\n\tfoo_bar!!", "word " * 9000, "a" * 3000, "Zürich ÀÉ 日本 é́ ΑΣ x\x1cy\x00z", "<|endoftext|> <|startoftext|>", "same text", "same text", "'S 's ''s"]
SCHEMA = "doc_id bigint, text string, length string, part string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    assert isinstance(encoder(word_tokenizer()), WordEncoder)
    encoder_ = WordEncoder(word_tokenizer())
    assert encoder_.direct
    encode = encoder_.encode
    for c in map(chr, (*range(0x400), *range(0x1E00, 0x2100), *range(0xA640, 0xA660))):
        for text in (c, f"a{c}b", f"É{c}", f"{c}{c}1", f"'{c}s"):
            assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)
    marks = [" ", "\n", "\t", "\r", "\x0b", "\x85", " ", "́", "\x1c", "Ab", "É", "'", "S", "1", "²", "Σ", "İ", "日", "_", "<|endoftext|>"]
    for n in (1, 2, 3):
        for parts in itertools.product(marks, repeat=n):
            text = "".join(parts)
            assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)


def test_encoder_forgets_without_changing_ids(library, monkeypatch):
    from veriloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 6)
    monkeypatch.setattr(tokens, "SLICE", 20)
    encode = WordEncoder(word_tokenizer()).encode
    for text in ["a b c d e f g h i j", "a z a b y", "j i h " * 30, "日本 a b Σ c\nd " * 9, "no-space" * 20]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text)


def checked(counts, capacity):
    """The plan, after holding all parts of all pieces against the rules."""
    plan = SlackPlan(np.array(counts), capacity)
    sizes = np.repeat(np.arange(len(counts)), counts)
    if not len(sizes):
        assert not plan.sequences
        return plan
    row, start, length, sequence, offset = plan.find(sizes, np.concatenate([np.arange(n) for n in counts]))
    spans, windows = {}, {}
    for r, a, n, q, at in zip(*(x.tolist() for x in (row, start, length, sequence, offset)), strict=True):
        spans.setdefault(r, []).append((a, n))
        windows.setdefault(q, []).append((at, n))
    for held, whole in ((spans, sizes.tolist()), (windows, None)):
        for key, parts in held.items():
            parts.sort()
            assert [a for a, _ in parts] == list(itertools.accumulate([n for _, n in parts][:-1], initial=0))
            total = sum(n for _, n in parts)
            assert total == whole[key] if whole else total == capacity or not total & total - 1 and total < capacity
    assert len(spans) == len(sizes) and sorted(windows) == list(range(plan.sequences))
    assert plan.cuts == len(row) - len(sizes)
    return plan


def test_plans_hold_every_token_once_without_padding():
    random = np.random.default_rng(1)
    for _ in range(400):
        capacity = int(random.choice([16, 32, 64]))
        n = int(random.integers(0, 30))
        sizes = random.integers(1, capacity + 1, n) if random.random() < 0.5 else random.choice(random.integers(1, capacity + 1, 2), n)
        checked(np.bincount(sizes.astype(int), minlength=capacity + 1).tolist(), capacity)


def test_fillings_are_the_closest():
    random = np.random.default_rng(2)
    for _ in range(200):
        sizes = random.integers(1, 30, random.integers(1, 9)).tolist()
        plan = SlackPlan(np.zeros(65, int), 64)
        plan.left, plan.sizes = np.bincount(sizes, minlength=65).tolist(), sorted(set(sizes))
        need, slack = plan.filling()
        longest = max(sizes)
        sizes.remove(longest)
        best = max(s for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if (s := longest + sum(c)) <= 64)
        assert sum(s * n for s, n in need.items()) == best == 64 - slack
        assert all(n <= plan.left[s] for s, n in need.items()) and need[longest]


def test_few_cuts_and_a_plan_as_large_as_the_capacity():
    random = np.random.default_rng(4)
    counts = np.bincount(np.clip(random.lognormal(5, 1, 5000).astype(int), 1, 1024), minlength=1025)
    assert checked(counts.tolist(), 1024).cuts <= 12
    huge = SlackPlan(counts * 10**9, 1024)
    assert huge.fillings < 3000 and sum(len(k.low) for k in huge.kinds) < 50_000
    assert SlackPlan(np.bincount([600] * 10**5, minlength=1025), 1024).fillings < 100  # no two fit: cuts repeat too


def test_whole_operator(spark, library):
    rows = [(i * 5, x, "x", "y") for i, x in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (None, "no id", "x", "y"), (0, "", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    capacity = 256
    found, plan = slack_packing.pack(docs, capacity=capacity)
    got = found.collect()
    texts = {}
    for i, x, *_ in rows:
        texts.setdefault(i, []).append([*library(x), 2])
    assert sum(r["length"] for r in got) == sum(len(ids) for own in texts.values() for ids in own)
    windows = {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        assert any(len(own) == r["doc_tokens"] and own[r["start"] : r["start"] + len(ids)] == ids for own in texts[r["doc_id"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [a for a, _ in parts] == list(itertools.accumulate([n for _, n in parts][:-1], initial=0))
        assert total == capacity or total < capacity and not total & total - 1
    for i, own in texts.items():
        if len(own) == 1:
            spans = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
            assert [a for a, _ in spans] == list(itertools.accumulate([n for _, n in spans][:-1], initial=0)) and sum(n for _, n in spans) == len(own[0])
    assert len(windows) == plan.sequences


def test_empty_table(spark):
    report = slack_packing.packing_report(spark.createDataFrame([], SCHEMA))
    assert report.collect() == [] and report.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
