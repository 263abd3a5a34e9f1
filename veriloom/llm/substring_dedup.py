"""Substring deduplication by relative Lempel-Ziv parsing against every reference block.

Reference blocks are content-defined: of any ``WINDOW`` consecutive words, the smallest hash among its word n-grams names an
anchor, so equal passages choose equal anchors wherever they stand.  The block of an anchor is the anchor with all words that a
window around it can reach.  Blocks of all documents are indexed by (anchor, block digest) with their first occurrence: document
and place.  A document meets the index at its anchors.  A block that an earlier document has whole is a match; where an earlier
document has the anchor but not the whole block, the block's windows are looked up one by one, by 128-bit digests, among the
windows of the anchor's other blocks.  Every window has exactly one anchor, so no repeated window is missed and no other is found.

``factorise`` then parses the document greedily from left to right.  Matches that lie on one diagonal of one reference (same
document, same distance) and overlap are one longer match; at a position the match that reaches furthest is the next factor
(start, length, reference document, reference start), and the parse goes on where it ends.  Factors of at least ``WINDOW`` words
are duplicate spans.  At factor boundaries, windows that begin in one factor and end beyond it are looked up among the matches;
nothing else is a span, so the parse decides what goes.

Shuffled are one row per anchor (about one for 22 words), and windows of boundary blocks only.  An anchor that a third of all
documents share shrinks to its distinct blocks before the shuffle; the index is joined by block digest and by window digest, so
one anchor in very many different blocks is spread over all tasks.

Defined results: null, empty and blank texts have no words; documents below ``WINDOW`` words lose none; of documents with equal
ids none is earlier than the other, and a null doc_id is later than any other; each row is judged by its own text, so rows that
share an id, or have none, don't touch each other's words; very long texts are parsed whole; other columns, whatever their names,
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, written

WINDOW = 50
#: Words of an anchor.
GRAM = 8
NO_ID = (1 << 63) - 1

_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U64)
    out[1:] = base
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the two bases and of their inverses modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.tables: list[np.ndarray] = []

    def upto(self, n: int) -> list[np.ndarray]:
        if not self.tables or len(self.tables[0]) < n:
            n = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.tables = [_powers(b, n) for b in (_B1, pow(_B1, -1, 1 << 64), _B2, pow(_B2, -1, 1 << 64))]
        return self.tables


_POWERS = Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Words:
    """Hashes of the words of a text, and of any run of them."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()  # bytes split at ASCII white space only
        self.n = len(self.words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), _U64, self.n)
        self.p = _POWERS.upto(self.n + 1)
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate([np.zeros(1, _U64), np.cumsum(v * self.p[k][: self.n])]) for v, k in ((h, 0), (_mix(h), 2))]

    def runs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words from start to end."""
        with np.errstate(over="ignore"):
            a, b = (_mix((s[end] - s[start]) * self.p[k][start]) for s, k in zip(self.sums, (1, 3), strict=True))
        return a, b

    def anchors(self, window: int, gram: int) -> np.ndarray:
        """First words of the anchors of all windows, and for each window its anchor."""
        grams = self.n - gram + 1
        key = self.runs(np.arange(grams), np.arange(grams) + gram)[0]
        # smallest key, leftmost of equals, over window - gram + 1 grams: minima of doubling spans
        place = np.arange(grams)
        span, reach = 1, window - gram + 1
        while span < reach:
            step = min(span, reach - span)
            left, right = key[: len(key) - step], key[step:]
            later = right < left
            key, place = np.where(later, right, left), np.where(later, place[step:], place[: len(place) - step])
            span += step
        return place


def parse(text: str | None, window: int, gram: int) -> tuple[list, int]:
    """Anchors as (anchor hash, block hash, block hash, first word of the anchor, first and end word of the block), and the number of words."""
    w = Words(text)
    if w.n < window:
        return [], w.n
    at = np.unique(w.anchors(window, gram))
    anchor = w.runs(at, at + gram)[0]
    first, last = np.maximum(0, at + gram - window), np.minimum(w.n, at + window)
    a, b = w.runs(first, last)
    with np.errstate(over="ignore"):  # how far the block reaches counts too
        b = _mix(b + (at - first).astype(_U64) * _U64(1 << 20) + (last - at).astype(_U64))
    return [anchor.view(np.int64), a.view(np.int64), b.view(np.int64), at, first, last], w.n


#: A row is told from others by its id (``doc``, for which null is last) and two hashes; the second is 0 where there is an id.
ROW = ["doc", "x", "y"]
_ROW = "doc bigint, x bigint, y bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, x, y, text``."""
    id_ = F.col("doc_id").cast("bigint")
    other = F.when(id_.isNull(), F.xxhash64(F.lit(7), "text")).otherwise(F.lit(0).cast("bigint"))
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("x"), other.alias("y"), "text")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True)


def index_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Every anchor of every document: its row, the block's first word and number of words, and the hashes."""
    kinds = f"{_ROW}, first int, n int, anchor bigint, h1 bigint, h2 bigint, at int"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, x, y, text in _rows(batch):
                found, _ = parse(text.as_py(), window, gram)
                if found:
                    anchor, a, b, at, first, last = found
                    row = (np.full(len(at), v, np.int64) for v in (doc, x, y))
                    for column, values in zip(out, (*row, first.astype(np.int32), (last - first).astype(np.int32), anchor, a, b, at.astype(np.int32)), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return docs.select(*ROW, "text").mapInArrow(run, kinds)


def _windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows whose anchor is in ``docs.ats``: row, first word and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (doc, x, y, text), ats in zip(_rows(batch), batch.column(4), strict=True):
                w = Words(text.as_py())
                starts = np.flatnonzero(np.isin(w.anchors(window, gram), np.array(ats.as_py())))
                a, b = w.runs(starts, starts + window)
                columns = [*(np.full(len(starts), v, np.int64) for v in (doc, x, y)), starts.astype(np.int32), a.view(np.int64), b.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*ROW, "start", "h1", "h2"])

    return docs.select(*ROW, "text", "ats").mapInArrow(run, f"{_ROW}, start int, h1 bigint, h2 bigint")


def matches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc, x, y, matches``: for rows of ``keyed`` that have any, ``(start, n, ref, ref_start)``: words that an earlier document has too.

    The reference is the block's first occurrence where an earlier document has the whole block, else the window's.
    """
    anchors = written(index_blocks(docs, window, gram), "anchors")
    # anchors of two documents or more, and whether they stand in different blocks: a table of its own, so that the join below is
    # between two plain shuffles, which adaptive execution splits where one anchor has very many blocks
    span = [f(c).alias(f"{f.__name__}_{c}") for c in ("doc", "h1", "h2") for f in (F.min, F.max)]
    shared = anchors.groupBy("anchor").agg(*span).filter("min_doc < max_doc")
    shared = written(shared.select(F.col("anchor").alias("__anchor"), F.expr("min_h1 < max_h1 or min_h2 < max_h2").alias("many")), "shared-anchors")
    # distinct blocks with their first occurrence
    blocks = anchors.groupBy("anchor", "h1", "h2").agg(F.min(F.struct("doc", "first")).alias("ref"))
    blocks = written(blocks.join(shared, F.col("anchor") == F.col("__anchor")).drop("__anchor"), "blocks")
    met = written(anchors.join(blocks, ["anchor", "h1", "h2"]).select(*ROW, "first", "n", "at", "ref", "many"), "met")
    whole = met.filter("ref.doc < doc").select(*ROW, F.struct(F.col("first").alias("start"), "n", F.col("ref.doc").alias("ref"), F.col("ref.first").alias("ref_start")).alias("m"))
    # factor boundaries: the first document of a block looks its windows up among those of the anchor's other blocks
    edge = met.filter("ref.doc = doc and many").groupBy(*ROW).agg(F.collect_set("at").alias("ats"))
    windows = written(_windows(docs.join(edge, ROW), window, gram), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("ref"), F.max("doc").alias("most")).filter("ref.doc < most").drop("most")
    found = windows.join(least, ["h1", "h2"]).filter("ref.doc < doc")
    found = found.select(*ROW, F.struct("start", F.lit(window).alias("n"), F.col("ref.doc").alias("ref"), F.col("ref.start").alias("ref_start")).alias("m"))
    return whole.unionByName(found).groupBy(*ROW).agg(F.collect_list("m").alias("matches"))


def joined_matches(matches: np.ndarray) -> list[list[int]]:
    """Rows ``start, end, ref, shift`` of rows ``start, n, ref, ref_start``, in order of start; matches on one diagonal that overlap are one."""
    start, n, ref, ref_start = matches.T
    order = np.lexsort((start, ref_start - start, ref))
    start, end, ref, shift = start[order], (start + n)[order], ref[order], (ref_start - start)[order]
    reach, new = 0, []
    for k in range(len(start)):
        same = k > 0 and ref[k] == ref[k - 1] and shift[k] == shift[k - 1]
        new.append(not same or start[k] > reach)
        reach = max(reach, end[k]) if same else end[k]
    head = np.flatnonzero(new)
    long = np.stack([start[head], np.maximum.reduceat(end, head), ref[head], shift[head]], axis=1)
    return long[np.lexsort((long[:, 3], long[:, 2], -long[:, 1], long[:, 0]))].tolist()


def greedy_factors(rows: list[list[int]], window: int) -> list[tuple[int, int, int, int]]:
    """``start, length, ref, ref_start`` of the factors: at each place the copy that reaches furthest, if it has a window's words."""
    factors, at, k = [], 0, 0
    open_: list[tuple[int, int, int]] = []  # matches that begin at or before ``at``, furthest first
    while True:
        while k < len(rows) and rows[k][0] <= at:
            heapq.heappush(open_, (-rows[k][1], *rows[k][2:]))
            k += 1
        if open_ and -open_[0][0] >= at + window:
            end, ref, shift = open_[0]
            factors.append((at, -end - at, ref, at + shift))
            at = -end
        elif k < len(rows):
            at = rows[k][0]
        else:
            return factors


def duplicate_spans(factors: list[tuple[int, int, int, int]], rows: list[list[int]], window: int) -> list[list[int]]:
    """The words of factors, and of windows that begin within a factor and end beyond it, looked up among the matches.

    That is all: a match that began before its factor ends no later, so only those that begin within it reach over its end; and
    windows that begin in no factor are in no match.
    """
    spans, starts = [(start, start + n) for start, n, *_ in factors], [row[0] for row in rows]
    for start, n, *_ in factors:
        boundary = start + n
        for s, e, *_ in rows[bisect_right(starts, start) : bisect_left(starts, boundary)]:
            first, last = max(s, boundary - window + 1), min(boundary - 1, e - window)  # of the windows over the boundary
            if first <= last:
                spans.append((first, last + window))
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def factorise(matches: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse over rows ``start, n, ref, ref_start``: the factors as such rows, and the duplicate spans ``[start, end)``."""
    rows = joined_matches(matches)
    factors = greedy_factors(rows, window)
    return np.array(factors, np.int64).reshape(-1, 4), np.array(duplicate_spans(factors, rows, window), np.int64).reshape(-1, 2)


FACTORS = "array<struct<start: bigint, length: bigint, ref: bigint, ref_start: bigint>>"


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_factors: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (and ``factors``): every document's words that no smaller document has in a window."""
    bound_batches(docs.sparkSession)
    rows = keyed(docs)
    joined = rows.join(matches(rows, window, gram), ROW, "left").select("doc_id", "text", "matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "ref", "ref_start")]))
        for batch in batches:
            n_words, n_removed, texts, parsed = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                factors, spans = (), np.empty((0, 2), np.int64)
                if found.is_valid:
                    factors, spans = factorise(np.stack([found.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1), window)
                for a, b in spans[::-1].tolist():
                    del words[a:b]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode())
                parsed.append([dict(zip(("start", "length", "ref", "ref_start"), f, strict=True)) for f in (factors.tolist() if len(factors) else ())])
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept"]
            if with_factors:
                columns, names = [*columns, pa.array(parsed, kind)], [*names, "factors"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string" + (f", factors {FACTORS}" if with_factors else ""))


def substring_report(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM w WHERE len(words) >= 50
), h AS (
  SELECT doc_id, p, sha256(array_to_string(words[p : p + 49], ' ')) AS h FROM s
), m AS (
  SELECT h, min(doc_id) AS least FROM h GROUP BY h
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM h JOIN m USING (h) WHERE least < doc_id
), k AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS q, unnest(words) AS word FROM w
), r AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept
  FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.q = k.q) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
