"""Media columns: payloads in content-defined chunks, stored once each.

A payload (8-bit samples) is cut where a rolling gear hash of its last 32 bytes hits a mask, between a least and a largest chunk
size, so equal passages give equal chunks wherever they lie.  Its media form is the ordered list of its chunk digests.  Chunks are
deduplicated on digests alone: Spark reduces the lists to one row per digest, an anti-join leaves those that the store's index
lacks, and each goes to one home, the smallest payload that has it.  Only then do bytes move, once: a payload's new chunks become
its row of the store, which is bucketed by payload.  Reading joins each payload's list to its own row in place and to the chunks
that it borrows from other homes, lays the chunks end to end, and verifies every chunk and the payload by their digests.  Payloads
with the same bytes are stored and rebuilt once.

Chunks are compressed with zstandard and a dictionary that the store learns from at most ``SAMPLE_CHUNKS`` chunks of its first
documents (a bound on a compression aid: which bytes come back doesn't depend on it).  Dictionary and bucket count are kept beside
the store, and a store opens with what it was made with.  Adding is safe to repeat, with the same documents or others: data is
written before the index that names it, the index decides what is known, and what a cut-short add left without an index entry is
never read as if it were whole.

Defined results: null and empty text give 192 spaces; rows that repeat, or have equal texts, get equal values whatever their ids
(null too); a very long text is cut like any other and rebuilt in one task's memory; other columns, whatever their names, are not
looked at; an empty table gives no rows and an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import BucketedTable, StoreMeta, bound_batches, fresh_path, written

UNIT = 192
LEAST, MEAN_BITS, MOST = 1024, 11, 16_384
LEVEL = 9
MAGIC = b"CDC2"
#: Bytes of a key: digests of chunks and payloads are the first 128 bits of their SHA-256.
KEY = 16
DICTIONARY, SAMPLE_DOCS, SAMPLE_CHUNKS = 65_536, 2000, 4000

#: Gear values of the 256 bytes: the first 32 bits of their SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the padded payload."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**32, which holds the last 32 bytes, by sums of doubling spans."""
    h = GEAR[data]
    with np.errstate(over="ignore"):
        for shift in (1, 2, 4, 8, 16):
            h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def cuts(payload: bytes, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks."""
    n = len(payload)
    if n <= least:
        return [n]
    h = gear_hash(np.frombuffer(payload, np.uint8))
    hits = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, start = [], 0
    while n - start > least:
        at = np.searchsorted(hits, start + least)
        end = int(hits[at]) if at < len(hits) and hits[at] <= start + most else start + most
        ends.append(min(end, n))
        start = ends[-1]
    if start < n:
        ends.append(n)
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def key_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:KEY]


def recipes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, key, chunks``: every payload's digest, and its chunk digests in order, end to end."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, lists = [], [], []
            for text in batch.column(1):
                n, payload = payload_of(text.as_py())
                sizes.append(n)
                keys.append(key_of(payload))
                lists.append(b"".join(map(key_of, chunks_of(payload))))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "key", "chunks"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, key binary, chunks binary")


def digests(payloads: DataFrame) -> DataFrame:
    """``key, digest`` of ``payloads(key, chunks)``, each once."""
    each = F.transform(F.sequence(F.lit(0), F.expr(f"length(chunks) div {KEY} - 1")), lambda i: F.substr("chunks", i * KEY + 1, F.lit(KEY)))
    return payloads.select("key", F.explode(F.array_distinct(each)).alias("digest"))


def learn_dictionary(docs: DataFrame) -> bytes:
    """A zstandard dictionary from chunks of some distinct texts, drawn by a hash of the text; empty for too few chunks."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                chunks = chunks_of(payload_of(text.as_py())[1])
                yield pa.RecordBatch.from_arrays([pa.array(list(map(key_of, chunks)), pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "data"])

    rows = some.mapInArrow(run, "digest binary, data binary").orderBy("digest").limit(SAMPLE_CHUNKS)
    samples = [bytes(r["data"]) for r in rows.select("data").collect()]  # at most SAMPLE_CHUNKS x MOST bytes
    if len(samples) < 100:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # chunks too much alike to learn from
        return b""


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class ChunkStore:
    """Chunks (zstandard) by the payload that brought them: ``home, digests, data``, in buckets by home; and an index
    ``digest, home``, in buckets by digest, each digest once."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "chunk-store")
        self.meta = StoreMeta(spark, self.path, buckets)
        self.buckets = self.meta.buckets
        self.data = BucketedTable(spark, f"{self.path}/data", "home", "home BINARY, digests ARRAY<BINARY>, data ARRAY<BINARY>", self.buckets)
        self.index = BucketedTable(spark, f"{self.path}/index", "digest", "digest BINARY, home BINARY", self.buckets)

    def close(self) -> None:
        """Forget the tables' names; the store's files stay."""
        self.data.close()
        self.index.close()

    def add(self, docs: DataFrame) -> DataFrame:
        """Store the chunks of ``docs`` that are new; the ``recipes`` of all."""
        bound_batches(self.spark)
        if self.meta.extra is None:
            self.meta.save(learn_dictionary(docs))
        lists = written(recipes(docs), "media-recipes")
        homes = digests(lists).groupBy("digest").agg(F.min("key").alias("home"))
        fresh = written(homes.join(self.index.rows().select("digest").hint("merge"), "digest", "left_anti"), "media-fresh")
        owners = fresh.groupBy(F.col("home").alias("key")).agg(F.collect_set("digest").alias("fresh"))  # as many as a payload has
        # a payload that has a row already, of an add that was cut short, lends its new chunks from a home of their own
        held = self.data.rows().select(F.col("home").alias("key"), F.lit(True).alias("held")).hint("merge")
        other = F.substr(F.unhex(F.sha2(F.concat("key", F.lit(uuid.uuid4().bytes)), 256)), F.lit(1), F.lit(KEY))
        owners = written(owners.join(held, "key", "left").select("key", "fresh", F.when(F.col("held"), other).otherwise(F.col("key")).alias("home")), "media-owners")
        dictionary = self.meta.extra

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, seen = _codec(dictionary), set()
            if book:
                book.precompute_compress(level=LEVEL)
            squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=book)
            for batch in batches:
                keys, names, data = [], [], []
                for text in batch.column(0):
                    payload = payload_of(text.as_py())[1]
                    key = key_of(payload)
                    if key in seen:  # within the task; Spark does the rest
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    chunks = dict((key_of(c), c) for c in chunks_of(payload))
                    keys.append(key)
                    names.append(list(chunks))
                    data.append([squeeze.compress(c) for c in chunks.values()])
                many = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(names, many), pa.array(data, many)], names=["key", "digests", "data"])

        bodies = docs.select("text").mapInArrow(run, "key binary, digests array<binary>, data array<binary>")
        bodies = bodies.repartition(self.buckets, "key").dropDuplicates(["key"]).join(owners.hint("merge"), "key")
        mine = F.filter(F.arrays_zip("digests", "data"), lambda c: F.array_contains("fresh", c["digests"]))
        rows = bodies.select("home", mine.alias("c")).select("home", F.col("c.digests").alias("digests"), F.col("c.data").alias("data"))
        self.data.append(rows)
        self.index.append(owners.select(F.explode("fresh").alias("digest"), "home").repartition(self.buckets, "digest"))
        return lists


_RESULT = "key binary, payload_sha256 binary, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string"


def describe(key: bytes, parts: list[tuple[bytes, bytes]], open_: zstandard.ZstdDecompressor) -> tuple:
    """Read a stored payload back from its (digest, data) parts, verify it and compute its features."""
    whole, media = [], hashlib.sha256(MAGIC + struct.pack("<I", len(parts)))
    size = len(MAGIC) + 4
    for digest, data in parts:
        media.update(digest + struct.pack("<I", len(data)))
        size += len(digest) + 4 + len(data)
    for digest, data in parts:
        chunk = open_.decompress(data)
        if key_of(chunk) != digest:
            raise ValueError(f"stored chunk {digest.hex()} is damaged")
        media.update(data)
        whole.append(chunk)
    payload = b"".join(whole)
    found = hashlib.sha256(payload).digest()
    if found[:KEY] != key:
        raise ValueError(f"payload {key.hex()} can't be rebuilt")
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    feature = f"chunks={len(parts)};mean={samples.mean():.6f};deviation={samples.std():.6f};entropy={-(share * np.log2(share)).sum():.6f};distinct={len(share)}"
    return key, found, len(payload), zlib.crc32(payload[-16:]), size, media.digest(), feature


def read_media(lists: DataFrame, store: ChunkStore) -> DataFrame:
    """Rebuild, verify and describe the payloads of ``lists(key, chunks)``, each once."""
    payloads = written(lists.select("key", "chunks").dropDuplicates(["key"]), "media-lists")
    # chunks that a payload borrows: several payloads have them, or their only one isn't their home
    used = digests(payloads).groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    lent = used.join(store.index.rows().hint("merge"), "digest").filter("n > 1 or home <> least").select("digest", "home")
    wanted = lent.groupBy("home").agg(F.collect_set("digest").alias("wanted"))  # as many as a payload has
    held = store.data.rows().join(wanted.hint("merge"), "home")
    held = held.select("home", F.explode(F.filter(F.arrays_zip("digests", "data"), lambda c: F.array_contains("wanted", c["digests"]))).alias("c"))
    shared = written(held.select("home", F.col("c.digests").alias("digest"), F.col("c.data").alias("data")), "media-shared", codec="none")
    # one row per shared chunk meets its payloads; adaptive skew handling splits a chunk that very many have
    borrowed = digests(payloads).join(shared, "digest").filter("key <> home").groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("lent"))
    own = store.data.rows().withColumnRenamed("home", "key").hint("merge")
    rows = payloads.join(own, "key", "left").join(borrowed.hint("merge"), "key", "left").select("key", "chunks", "digests", "data", "lent")
    dictionary, names = store.meta.extra, [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            out = []
            for key, chunks, names_, data, lent in zip(*batch.columns, strict=True):
                known = dict(zip(names_.as_py() or (), data.as_py() or (), strict=True)) | {x["digest"]: x["data"] for x in lent.as_py() or ()}
                order = chunks.as_py()
                parts = [order[k : k + KEY] for k in range(0, len(order), KEY)]
                lost = [d for d in parts if d not in known]
                if lost:
                    raise ValueError(f"chunk {lost[0].hex()} isn't in the store")
                out.append(describe(key.as_py(), [(d, known[d]) for d in parts], open_))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _RESULT)


def media_report(docs: DataFrame, store: ChunkStore | None = None) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` of every document."""
    store = store or ChunkStore(docs.sparkSession)
    lists = store.add(docs)
    # one row per payload meets its documents; the hot side is split by adaptive skew handling
    joined = lists.select("doc_id", "n_bytes", "key").join(read_media(lists, store), "key")
    return joined.select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_sha256")).alias("payload_sha256"), "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature"
    )
