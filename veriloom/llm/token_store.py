"""Token ids as bit-plane shuffled, zstandard-compressed blocks with a chunk index.

File format: a Parquet folder, one row per chunk.  A chunk holds whole documents of one range partition, in ascending doc_id
order; its ids are cut into blocks of ``BLOCK_IDS`` (the last one is shorter), each block is transposed into byte planes or bit
planes, and every plane is compressed on its own.  High planes are nearly constant and shrink to almost nothing.  The row is its
own index: documents and their lengths, plane lengths, and the place of the chunk among the ids of its part; a reader that wants
one document prunes to these columns and then reads one row.

Documents are range partitioned by doc_id, so part after part is the whole corpus in order, and each part is written as a
stream: memory holds one chunk.  Only one number per part (its id count) is summed up across parts.

Defined results: null and empty text give one id, the end id; rows that repeat a doc_id are stored one after the other, by a hash of
the text, so a rerun gives each the same place, and rows without a doc_id, which come first, are dealt over several parts; a very
long text is one chunk, in one task's memory; other columns, whatever their names, are not looked at; an empty table gives an empty
folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, fresh_path, shuffle_partitions
from .tokens import END_ID, default_tokenizer, encoder

BLOCK_IDS = 16_384
#: A chunk is closed when it holds so many ids; one longer document is a chunk alone.
CHUNK_IDS = 262_144

CHUNK_SCHEMA = (
    "part int, chunk int, start_in_part bigint, n_ids bigint, width int, bits boolean, block_ids int,"
    " doc_ids array<bigint>, doc_ids_len array<bigint>, plane_len array<int>, planes binary"
)


def shuffle_block(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """Planes of ``ids`` (unsigned, little-endian, ``width`` bytes each), low plane first."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [raw[:, k].tobytes() for k in range(width)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def unshuffle_block(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.empty((n, width), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        spread = np.empty((n, 8 * width), np.uint8)
        for k, plane in enumerate(planes):
            spread[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw = np.packbits(spread, axis=1, bitorder="little")
    return raw.reshape(-1).view(f"<u{width}").astype("<u4")


def encode_chunk(ids: np.ndarray, width: int, bits: bool, block_ids: int, level: int) -> tuple[list[int], bytes]:
    squeeze = zstandard.ZstdCompressor(level=level)
    planes = [squeeze.compress(p) for at in range(0, len(ids), block_ids) for p in shuffle_block(ids[at : at + block_ids], width, bits)]
    return [len(p) for p in planes], b"".join(planes)


def decode_chunk(n_ids: int, plane_len: list[int], planes: bytes, width: int, bits: bool, block_ids: int) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    per = 8 * width if bits else width
    out, at, k = [], 0, 0
    for first in range(0, n_ids, block_ids):
        n = min(block_ids, n_ids - first)
        block = []
        for _ in range(per):
            block.append(open_.decompress(planes[at : at + plane_len[k]]))
            at, k = at + plane_len[k], k + 1
        out.append(unshuffle_block(block, n, width, bits))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, bits: bool = False, partitions: int | None = None,
    block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, level: int = 1,
) -> None:
    """Encode ``docs(doc_id, text)``, an end id after each, and store the ids below ``path``."""
    bound_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    wide = 2 if _vocabulary(tokenizer) <= 1 << 16 else 4

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        end = END_ID.to_bytes(4, "little")
        state = {"chunk": 0, "start": 0}
        keys: list[int | None] = []
        texts: list[bytes] = []

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            lens, planes = encode_chunk(ids, wide, bits, block_ids, level)
            one = [part, state["chunk"], state["start"], len(ids), wide, bits, block_ids, list(keys), [len(t) // 4 for t in texts], lens, planes]
            state["chunk"] += 1
            state["start"] += len(ids)
            keys.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, _ARROW.types, strict=True)], schema=_ARROW)

        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(encode(text.as_py()) + end)
                held += len(texts[-1]) // 4
                if held >= chunk_ids:
                    yield row()
                    held = 0
        if keys:
            yield row()

    count = partitions or shuffle_partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("body"))
    ordered = ordered.repartitionByRange(count, "doc_id", "body").sortWithinPartitions("doc_id", "body", "text").drop("body")
    ordered.mapInArrow(chunks, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("chunk", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("bits", pa.bool_()),
        ("block_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_ids_len", pa.list_(pa.int64())), ("plane_len", pa.list_(pa.int32())), ("planes", pa.binary()),
    ]
)


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every stored document, decoded from the files."""
    bound_batches(spark)
    stored = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per part: as many as the writer had tasks
    before = sizes.select(
        F.col("part").alias("__part"),
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                ids = decode_chunk(c["n_ids"], c["plane_len"], c["planes"], c["width"], c["bits"], c["block_ids"])
                raw, lens = ids.tobytes(), c["doc_ids_len"]
                ends = np.cumsum(lens)
                starts = ends - lens
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(c["doc_ids"], pa.int64()), pa.array([c["part"]] * len(lens), pa.int32()),
                    pa.array(starts + c["start_in_part"], pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, part int, in_part bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    rows = stored.mapInArrow(documents, schema)
    joined = rows.join(F.broadcast(before), rows["part"] == before["__part"])
    return joined.select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the corpus, read the files back, describe every document."""
    path = fresh_path(docs.sparkSession, "token-planes")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path, with_ids=False)
