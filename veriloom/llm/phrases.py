"""Phrase collocation mining by Suffix-sigma.

Every word of a piece starts a suffix, cut after ``max_words`` words.  A task counts equal suffixes before they are shuffled by
language and first word; a partition sorts what it gets in reverse lexicographic order and counts all prefixes with one stack: a
prefix is closed, and reported if it is frequent, as soon as a suffix without it comes.  The parts of each frequent phrase then meet
their own counts in joins.

The language stands before a suffix as if it were a word, so the bottom of the stack counts all words of a language.  A prefix that
holds more of a sample of documents than half a partition's share is dealt out by one word more (and so on up to whole suffixes), so
no partition needs all rows of a frequent word; such a prefix is reported whatever its count in a partition is, and the counts are
summed afterwards.  The sample decides where rows go, never what is counted.

A frequent phrase has frequent parts, and whatever holds it inside a longer phrase as often holds it inside one that is longer by
one word, so joins on phrases shorter by one word find all that must be dropped.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count again; a very long text is
counted whole; words of any bytes are kept apart (bytes 0 and 1 are escaped); ties go by phrase; ids and other columns, whatever
their names, are not looked at; an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, shuffle_partitions, written

MAX_WORDS = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: A task hands on its counts when it holds so many suffixes, or has read so many bytes, since it did so last.
HELD_SUFFIXES, HELD_BYTES = 400_000, 32 << 20
#: Documents sampled for each partition to find prefixes that need more than one.
SAMPLED = 200
#: The best phrases of a language are found in so many groups first.
GROUPS = 256

#: A-Z to a-z, tab to space, ends of pieces to line feeds.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def escaped(raw: bytes) -> bytes:
    """Without byte 0, which separates words; the order of words stays."""
    return raw.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in raw or b"\1" in raw else raw


def restored(raw: bytes) -> bytes:
    return raw.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in raw else raw


def suffixes(text: bytes, most: int) -> Iterator[tuple[list[bytes], int]]:
    """The suffixes of all pieces of a text, each of ``most`` words at most, joined by byte 0: some at once, and their words' bytes."""
    for piece in escaped(text.translate(_PLAIN)).split(b"\n"):
        words = piece.split()
        if not words:
            continue
        mean = len(piece) // len(words) + 1
        step = max(1, 65_536 // mean)
        for low in range(0, len(words), step):
            yield [b"\0".join(words[i : i + most]) for i in range(low, min(low + step, len(words)))], step * mean


def suffix_counts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[bytes, Counter]]:
    """Counts of suffixes by language, of as much text as a task may hold."""
    counts: dict[bytes, Counter] = {}
    read = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            key = escaped(lang.as_py())
            for some, size in suffixes(text.as_py() or b"", most):
                counts.setdefault(key, Counter()).update(some)
                read += min(size, sum(map(len, some)))
                if read >= HELD_BYTES or sum(map(len, counts.values())) >= HELD_SUFFIXES:
                    yield counts
                    counts, read = {}, 0
    yield counts


def _batches(kinds: list[tuple[str, pa.DataType]], rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some megabytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) == 16_384 or total > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def crowded_prefixes(docs: DataFrame, most: int, partitions: int) -> set[bytes]:
    """Language and first words of which a sample of documents has more than half a partition's share: at most
    ``2 * partitions`` for each number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, int]]:
            for counts in suffix_counts(batches, most):
                found, total = Counter(), 0
                for lang, own in counts.items():
                    for suffix, n in own.items():
                        total += n
                        words = suffix.split(b"\0")
                        for k in range(1, min(most, len(words) + 1)):
                            found[b"\0".join([lang, *words[:k]])] += n
                yield b"", total
                yield from ((x, n) for x, n in found.items() if n * 8 * partitions > total)

        yield from _batches([("prefix", pa.binary()), ("n", pa.int64())], rows(), lambda row: len(row[0]))

    sample = docs.sample(min(1.0, SAMPLED * partitions / max(1, docs.count())), seed=1)
    found = sample.mapInArrow(count, "prefix binary, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    total = found.agg(F.max("n").alias("total"))  # the empty prefix has them all
    rows = found.join(F.broadcast(total), F.col("n") * 2 * partitions > F.col("total")).select("prefix").collect()
    return {bytes(row["prefix"]) for row in rows} - {b""}


def _same(x: bytes, y: bytes, low: int) -> int:
    """Bytes that two long suffixes share, ``low`` at least."""
    high = min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
    return low


def shared_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it, for all rows but the first; eight bytes are compared at once."""
    most, same = np.minimum(length[1:], length[:-1]), np.zeros(len(length) - 1, np.int64)
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(most)
    for _ in range(64):
        if not len(live):
            break
        differ = eights[start[live] + same[live]] ^ eights[start[live + 1] + same[live]]
        equal = differ == 0
        same[live] += np.where(equal, 8, np.bitwise_count((differ & -differ) - 1) // 8).astype(np.int64)
        live = live[equal & (same[live] < most[live])]
    for i in live.tolist():
        x, y = (data[start[j] : start[j] + length[j]].tobytes() for j in (i, i + 1))
        same[i] = _same(x, y, int(same[i]))
    return np.minimum(same, most)


#: The low bits of ``deal`` hold the number of words that it is of.
WORDS = 64


def _deal(first: bytes, words: int) -> int:
    return crc32(first) * WORDS + words


def deals(lang: bytes, own: Counter, full: set[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The suffixes of a language after it, in descending order (neighbours compress well), with their counts and where they go:
    by the fewest first words that are not crowded."""
    suffix = pa.array(list(own), pa.binary())
    order = pc.array_sort_indices(suffix, order="descending")
    suffix = suffix.take(order)
    n = np.fromiter(own.values(), np.int64, len(own))[order.to_numpy()]
    ends = np.frombuffer(suffix.buffers()[1], np.int32).astype(np.int64)[: len(suffix) + 1]
    data = np.frombuffer(suffix.buffers()[2] or b"", np.uint8)[: ends[-1]]
    gaps = np.append(np.flatnonzero(data == 0), len(data))
    size = np.minimum(gaps[np.searchsorted(gaps, ends[:-1])], ends[1:]) - ends[:-1]  # of first words
    new = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (shared_bytes(data, ends[:-1], size) != size[1:])))
    firsts = [lang + b"\0" + data[a : a + m].tobytes() for a, m in zip(ends[new].tolist(), size[new].tolist(), strict=True)]
    deal = np.repeat(np.array([_deal(first, 2) for first in firsts], np.int64), np.diff(np.append(new, len(suffix))))
    suffix = pc.binary_join_element_wise(pa.scalar(lang), suffix, pa.scalar(b"\0"))
    for first, low, high in zip(firsts, new.tolist(), [*new[1:].tolist(), len(suffix)], strict=True):
        if first in full:
            deal[low:high] = [_further(key, len(first), full) for key in suffix[low:high].to_pylist()]
    return suffix, n, deal


def _further(key: bytes, at: int, full: set[bytes]) -> int:
    """Where a suffix goes whose first word, up to ``at``, is crowded.  A crowded prefix goes on; one that ends with the suffix is
    counted elsewhere too."""
    at, words, first = at if at < len(key) else -1, 3, key
    while at >= 0:
        at = key.find(b"\0", at + 1)
        first = key if at < 0 else key[:at]
        if first not in full:
            break
        words += 1
    return _deal(first, words)


def dealt_suffixes(docs: DataFrame, most: int, partitions: int) -> DataFrame:
    """``suffix, n, deal``: counted suffixes after their language."""
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_prefixes(docs, most, partitions))
    names = ["suffix", "n", "deal"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in suffix_counts(batches, most):
            for lang, own in counts.items():
                suffix, n, deal = deals(lang, own, crowded.value)
                step = max(1, min(16_384, (4 << 20) * len(suffix) // max(1, suffix.nbytes)))
                for low in range(0, len(suffix), step):
                    some = slice(low, low + step)
                    yield pa.RecordBatch.from_arrays([suffix[some], pa.array(n[some]), pa.array(deal[some])], names=names)

    return docs.mapInArrow(count, "suffix binary, n bigint, deal bigint")


class PrefixStack:
    """Counts of all prefixes of suffixes that come in reverse lexicographic order.

    The stack holds the prefixes of the last suffix that are open, one for each number of words, with what they have counted.  A batch
    is pushed at once: for each number of words, rows that share fewer words with the row before close what is open.
    """

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.last = b""
        self.open: list[tuple[bytes, int, bool] | None] = [None] * (most + 1)  # prefix, count, and whether it is counted elsewhere too

    def push(self, suffix: pa.Array, n: np.ndarray, whole: np.ndarray) -> Iterator[tuple[bytes, int]]:
        rows = pa.concat_arrays([pa.array([self.last], suffix.type), suffix])
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
        data = np.frombuffer(rows.buffers()[2], np.uint8)[: ends[-1]]
        start, length = ends[:-1], np.diff(ends)
        same = shared_bytes(data, start, length)
        padded = np.concatenate([data == 0, [True]])
        before = np.concatenate([[0], np.cumsum(padded)])
        words = before[ends[1:]] - before[start] + 1
        # a word is shared if it ends in both rows where they differ or end
        over = [(same == length[i]) | padded[np.minimum(start[i] + same, ends[1:][i])] for i in (slice(0, -1), slice(1, None))]
        shared = before[start[1:] + same] - before[start[1:]] + (over[0] & over[1])
        if not self.last:
            shared[0] = 0
        words = words[1:]
        for depth in range(1, self.most + 1):
            own = np.flatnonzero(words >= depth)
            new = shared[own] < depth
            held = self.open[depth]
            if held and (not len(own) or own[0] or new[0]):
                yield from self._closed(*held)
                held = None
            self.open[depth] = None
            if not len(own):
                continue
            first = np.flatnonzero(new)
            if not new[0]:
                first = np.concatenate([[0], first])
            counts = np.add.reduceat(n[own], first)
            at = own[first]
            elsewhere = whole[at] > depth
            if held:
                counts[0] += held[1]
            stays = own[-1] == len(words) - 1
            closed = len(first) - int(stays)
            for i in np.flatnonzero((counts[:closed] >= self.least) | elsewhere[:closed]).tolist():
                yield self._prefix(suffix[int(at[i])].as_py(), depth), int(counts[i])
            if stays:
                self.open[depth] = self._prefix(suffix[int(at[-1])].as_py(), depth), int(counts[-1]), bool(elsewhere[-1])
        self.last = suffix[-1].as_py()

    def end(self) -> Iterator[tuple[bytes, int]]:
        for held in self.open:
            if held:
                yield from self._closed(*held)

    def _closed(self, prefix: bytes, n: int, elsewhere: bool) -> Iterator[tuple[bytes, int]]:
        if n >= self.least or elsewhere:
            yield prefix, n

    @staticmethod
    def _prefix(suffix: bytes, depth: int) -> bytes:
        return b"\0".join(suffix.split(b"\0", depth)[:depth])


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """``lang, phrase, n``: phrases of 1 to ``max_words`` words that occur ``least`` times, and an empty phrase with all words."""
    spark = docs.sparkSession
    bound_batches(spark)
    partitions = shuffle_partitions(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    sorted_ = dealt_suffixes(texts, max_words, partitions).repartition(partitions, "deal").sortWithinPartitions(F.desc("suffix")).select("suffix", "n", F.pmod("deal", F.lit(WORDS)).cast("int").alias("whole"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_words + 1, least)

        def rows() -> Iterator[tuple[bytes, bytes, int]]:
            for batch in batches:
                if batch.num_rows:
                    yield from map(named, stack.push(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            yield from map(named, stack.end())

        def named(found: tuple[bytes, int]) -> tuple[bytes, bytes, int]:
            lang, *words = map(restored, found[0].split(b"\0"))
            return lang, b" ".join(words), found[1]

        yield from _batches([("lang", pa.binary()), ("phrase", pa.binary()), ("n", pa.int64())], rows(), lambda row: len(row[1]))

    parts = sorted_.mapInArrow(count, "lang binary, phrase binary, n bigint")
    summed = parts.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return summed.filter((F.col("n") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, held_percent: int = 100, factor: int = 1000) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``score`` is ``factor * a * n / (l * r)``, rounded down, of the cut that makes it least.  A phrase goes if a longer one that holds
    it occurs ``held_percent`` as often.
    """
    counts = written(phrase_counts(docs, max_words, least), "phrases")
    totals = counts.filter("phrase = ''").select("lang", F.col("n"))
    known = counts.filter("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    phrases = known.filter(F.size("words") > 1)
    size = F.size("words")

    def joined(low: Column, n: Column) -> Column:
        return F.array_join(F.slice("words", low, n), " ")

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, size - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # a product of three counts may pass 64 bits
    score = F.expr(f"cast({factor} as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    least_cut = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # what a phrase that is longer by one word holds
    inner = phrases.filter(size > 2).select("lang", "a", F.explode(F.array(joined(F.lit(1), size - 1), joined(F.lit(2), size - 1))).alias("phrase"))
    within = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least_cut.join(within, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < held_percent * F.col("a"), F.lit(True)))

    found = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    best = found.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), often AS (
  SELECT * FROM grams WHERE f >= 100
), phrases AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k >= 2
), cuts AS (
  SELECT *, unnest(range(1, size)) AS k FROM phrases
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM phrases q WHERE q.lang = p.lang AND q.size > p.size AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.a >= 100 * p.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
