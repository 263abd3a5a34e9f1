import hashlib
import random
import zlib

import numpy as np
import pytest

from veriloom.llm import media


def brute_cuts(payload, least, bits, most):
    ends, start = [], 0
    while start < len(payload):
        h, end = 0, len(payload)
        for i in range(len(payload)):
            h = (2 * h + int(media.GEAR[payload[i]])) % (1 << 32)
            if i + 1 - start >= least and i + 1 > start and (h >> 32 - bits == 0 or i + 1 - start == most) and len(payload) - start > least:
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends


def test_cuts_against_a_rolling_loop():
    r = random.Random(4)
    for n in (1, 49, 50, 51, 400, 1500):
        payload = bytes(r.randrange(256) for _ in range(n))
        assert media.cuts(payload, 50, 6, 200) == brute_cuts(payload, 50, 6, 200)
    assert media.cuts(b"\0" * 1000, 50, 32, 200) == [200, 400, 600, 800, 1000]


def test_cuts_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    a = {data[x:y] for x, y in zip([0, *media.cuts(data, 100, 8, 4000)], media.cuts(data, 100, 8, 4000))}  # noqa: B905
    moved = b"new bytes" + data
    b = {moved[x:y] for x, y in zip([0, *media.cuts(moved, 100, 8, 4000)], media.cuts(moved, 100, 8, 4000))}  # noqa: B905
    assert len(a & b) > len(a) - 5


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh é日") for _ in range(300_000))
    return [None, "", "x", "y" * 192, "z" * 193, long, "prefix " + long, long, "same", "same", "é" * 100]


def test_round_trip(spark, texts):
    docs = spark.createDataFrame([(i, t, b"c") for i, t in enumerate(texts)], "doc_id bigint, text string, data binary").repartition(3)
    store = media.ChunkStore(spark)
    rows = {r["doc_id"]: r for r in media.media_report(docs, store).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * ((192 - len(data) % 192) % 192 or (0 if data else 192))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert [x for x in r[1:]] == [x for x in rows[texts.index(t)][1:]]
    assert int(rows[5]["feature"].split(";")[0][7:]) > 3
    digests = [bytes(r["digest"]) for r in store.index.rows().collect()]
    stored = [bytes(d) for r in store.data.rows().collect() for d in r["digests"]]
    chunks = {media.key_of(c) for t in texts for c in media.chunks_of(media.payload_of(t)[1])}
    assert sorted(digests) == sorted(stored) == sorted(chunks)


def test_store_survives_a_session(spark, texts):
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    store = media.ChunkStore(spark, buckets=3)
    store.add(docs.filter("length(text) < 100000"))
    few = store.index.rows().count()
    store.close()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = media.ChunkStore(spark, store.path)
        assert again.buckets == 3 and again.meta.extra == store.meta.extra
        with pytest.raises(ValueError):
            media.ChunkStore(spark, store.path, buckets=4)
        for _ in range(2):
            rows = media.media_report(docs, again).collect()
            digests = [bytes(r["digest"]) for r in again.index.rows().collect()]
            stored = [bytes(d) for r in again.data.rows().collect() for d in r["digests"]]
            assert len(rows) == len(texts) and len(set(digests)) == len(digests) > few and sorted(digests) == sorted(stored)
        # data without its index entries, as an append cut short leaves it, is no harm
        cut = media.ChunkStore(spark)
        fresh = again.data.rows().repartition(cut.buckets, "home")
        cut.meta.save(again.meta.extra)
        cut.data.append(fresh)
        assert media.media_report(docs, cut).count() == len(texts)
        digests = [bytes(r["digest"]) for r in cut.index.rows().collect()]
        assert len(set(digests)) == len(digests)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_typical_payloads_are_cut_and_passages_shared(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    passage = " ".join(word() for _ in range(4000))
    texts = [" ".join(word() for _ in range(1600)) for _ in range(40)] + [word() + " " + passage + " " + " ".join(word() for _ in range(50)) for _ in range(8)]
    store = media.ChunkStore(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in media.media_report(docs, store).collect()}
    counts = [int(rows[i]["feature"].split(";")[0][7:]) for i in range(40)]
    assert min(len(t) for t in texts) > 8192 and sum(n > 1 for n in counts) > 36
    assert store.meta.extra  # a dictionary was learned
    shared = [len(media.cuts(media.payload_of(t)[1])) for t in texts[40:]]
    assert store.index.rows().count() < sum(counts) + max(shared) + 8 * 4
    for i, t in enumerate(texts):
        assert rows[i]["payload_sha256"] == hashlib.sha256(media.payload_of(t)[1]).hexdigest()


def test_damage_is_seen():
    import zstandard

    good = media.chunks_of(b"a" * 192)[0]
    key = media.key_of(good)
    with pytest.raises(ValueError):
        media.describe(key, [(key, zstandard.ZstdCompressor().compress(b"b" * 192))], zstandard.ZstdDecompressor())


def test_empty(spark):
    assert media.media_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_an_add_cut_short_then_another_batch(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    common = " ".join(word() for _ in range(4000))
    texts = [word() + " " + common + " " + " ".join(word() for _ in range(900)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for lost in ("index", "data"):  # the append that doesn't happen
        store = media.ChunkStore(spark)
        with monkeypatch.context() as m:
            def fail(rows):
                raise RuntimeError("aborted")

            m.setattr(getattr(store, lost), "append", fail)
            with pytest.raises(RuntimeError):
                store.add(docs)
        for ids in ([3], [0], [1, 3], [0, 1, 2, 3]):
            rows = {x["doc_id"]: x for x in media.media_report(docs.filter(docs.doc_id.isin(ids)), store).collect()}
            assert sorted(rows) == ids
            assert all(rows[i]["payload_sha256"] == hashlib.sha256(media.payload_of(texts[i])[1]).hexdigest() for i in ids)
        digests = [bytes(x["digest"]) for x in store.index.rows().collect()]
        assert len(set(digests)) == len(digests)
