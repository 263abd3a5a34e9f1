"""Which of many tokens stand anywhere in which texts, in one pass over the texts.

A token of ``n`` bytes belongs to the class of the largest power of two ``g <= n``, and its last ``g`` bytes are its anchor.  Hashes of all
runs of ``g`` bytes of a text come from those of ``g / 2`` bytes, so all classes together cost a few vector operations for each byte,
however many lengths tokens have.  Anchors are kept as bits of a bitmap of fixed size, built by an aggregation and broadcast; a run
whose bit is set is handed on with the bytes before it that a token of its class can have.  Only these few rows meet the tokens, by
class and hash, and the bytes decide.  A bitmap that is too full for its tokens lets more rows through and misses none.

Texts are read in blocks, so memory doesn't follow the longest text.  Bytes are compared, which is the same as characters in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap for one token, and its largest size (32 MiB).
BITS_PER_TOKEN, MOST_BITS = 64, 1 << 28
#: Tokens up to this number, with so many bytes, are broadcast to the rows they meet; more are joined.
FEW_TOKENS, FEW_BYTES = 200_000, 32 << 20
#: Bytes of text hashed at once.
BLOCK = 1 << 20

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=_U)))


def run_hashes(data: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each class (powers of two, ascending) the hashes of all runs of so many bytes, by their first byte."""
    h, g = _BYTES[data], 1
    for size in classes:
        while g < size and len(h) > g:
            h = _mixed(h[:-g] * _U(0xC2B2AE3D27D4EB4F) + h[g:])
            g *= 2
        if g < size:
            return
        yield size, h


def anchors(tokens: DataFrame) -> DataFrame:
    """``token, g, h``: class and anchor's hash of ``tokens(token)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for token in batch.column(0):
                raw = token.as_py().encode()
                g = 1 << len(raw).bit_length() - 1
                *_, (_, h) = run_hashes(np.frombuffer(raw[-g:], np.uint8), [g])
                sizes.append(g)
                hashes.append(int(h.view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64())], names=["token", "g", "h"])

    return tokens.select("token").mapInArrow(run, "token string, g bigint, h bigint")


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits.bit_length() + 1)).astype(np.int64)


def anchor_bitmap(anchored: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the anchors' hashes, as bytes: ``bits / 8`` of them, however many anchors there are."""
    place = F.shiftrightunsigned("h", 64 - bits.bit_length() + 1) + 1  # buckets and bits count from 1
    rows = anchored.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:  # at most bits / 32768
        some = np.frombuffer(bytes(row["bitmap"]), np.uint8)
        at = (row["bucket"] - 1) * len(some)
        out[at : at + len(some)] = some[: len(out) - at]
    return out


def block_hits(data: np.ndarray, offsets: np.ndarray, classes: list[int], bitmap: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``row, g, h, slice`` of every run of a class whose bit is set: the slice ends with the run and has ``2 g - 1`` bytes at most,
    of one text."""
    bits, most, n = 8 * len(bitmap), classes[-1], int(offsets[-1])
    for low in range(int(offsets[0]), n, BLOCK):
        begin, end = max(int(offsets[0]), low - most + 1), min(n, low + BLOCK)
        for g, h in run_hashes(data[begin:end], classes):
            at = _positions(h, bits)
            first = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            last = first + begin + g - 1  # the run's last byte
            new = last >= low  # else the block before had it
            first, last = first[new], last[new]
            row = np.searchsorted(offsets, last, side="right") - 1
            inside = first + begin >= offsets[row]
            for r, e, i in zip(row[inside].tolist(), (last[inside] + 1).tolist(), first[inside].tolist(), strict=True):
                yield r, g, int(h[i].view(np.int64)), data[max(int(offsets[r]), e - 2 * g + 1) : e]


def tokens_inside(texts: DataFrame, id_: str, text: str, tokens: DataFrame, token: str) -> DataFrame:
    """``id, token``, each once: tokens that stand anywhere in a text.  Null and empty tokens stand in none, and a null text has none."""
    known = anchors(tokens.filter(F.length(token) > 0).select(F.col(token).cast("string").alias("token")).distinct())
    classes, sizes = [], known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("size")).collect()  # a row for each power of two
    kind = texts.schema[id_].dataType
    if not sizes:
        return texts.select(id_, F.lit(None).cast("string").alias(token)).limit(0)
    classes, count = sorted(r["g"] for r in sizes), sum(r["n"] for r in sizes)
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_PER_TOKEN * count).bit_length()))
    bitmap = texts.sparkSession.sparkContext.broadcast(anchor_bitmap(known, bits))
    names = ["id", "g", "h", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(1)
            if not len(body) or not body.buffers()[2]:
                continue
            offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            data = np.frombuffer(body.buffers()[2], np.uint8)
            found: set[tuple[int, int, int, bytes]] = set()
            for r, g, h, some in block_hits(data, offsets, classes, bitmap.value):
                found.add((r, g, h, some.tobytes()))
                if len(found) >= 20_000:
                    yield _hits(batch, found)
                    found = set()
            if found:
                yield _hits(batch, found)

    def _hits(batch: pa.RecordBatch, found: set[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        row, g, h, some = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array(some, pa.binary())], names=names)

    rows = texts.filter(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).cast("binary").alias("text"))
    hits = rows.mapInArrow(run, f"id {kind.simpleString()}, g bigint, h bigint, slice binary")
    few = count <= FEW_TOKENS and sum(r["size"] for r in sizes) <= FEW_BYTES
    met = hits.join(F.broadcast(known) if few else known, ["g", "h"])
    raw = F.col("token").cast("binary")
    return met.filter(F.endswith("slice", raw)).select(F.col("id").alias(id_), F.col("token").alias(token)).distinct()
