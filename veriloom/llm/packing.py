"""Best-fit packing of documents into sequences, by bin completion.

Sizes are whole numbers up to the capacity, so the whole corpus is a histogram of at most ``capacity`` counts, however many
documents there are.  The packing is found on the histogram by depth-first branch and bound: the largest size left is completed
with every undominated filling of the room around it, fullest first, and repeated as often as the counts allow, then once less, and
so on.  Best fit gives the first incumbent; a branch is cut only by dominance, by waste (what it wastes leaves no way to beat the
incumbent) or because the same sizes were left before.  The search ends with a proof, or at its node budget with the incumbent and
a known gap to the lower bound (``Plan.bound``, ``Plan.nodes``, ``Plan.proven``).  Each repeat uses up one size or leaves less of it
than one filling takes, so the plan has a size that depends on the capacity alone, not on the corpus.

Documents then take their slots in parallel: every piece knows its rank within its size (counted in the task that made it, plus
the counts of earlier tasks), and the plan maps size and rank to sequence and offset.  No rows meet in one task.

Defined results: null and empty text are one end id; rows that repeat a doc_id, or have none, are packed as documents of their own;
very long texts are cut into pieces and encoded in bounded batches; other columns, whatever their names, are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, written
from .tokens import END_ID, default_tokenizer, encoder

CAPACITY = 2048
#: Fillings that the search may look at before it settles for its incumbent.
NODES = 50_000
#: Sums of more sizes are made anew when the search comes back to them.
KEPT_MASKS = 64


@dataclass
class Plan:
    """Patterns of sizes, each repeated; sequences are numbered pattern after pattern."""

    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    #: Sequences that any packing needs, fillings that the search looked at, and whether fewer sequences are known to be impossible.
    bound: int = 0
    nodes: int = 0
    proven: bool = False

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing on the histogram: fill around the largest size with the largest that still fits."""
    left, plan = counts.copy(), Plan()
    sizes = sorted(np.flatnonzero(left).tolist())
    while sizes:
        pattern = _fill([], capacity, left, sizes)
        _take(plan, pattern, left, sizes)
    return plan


def _fill(pattern: list[int], room: int, left: np.ndarray, sizes: list[int]) -> list[int]:
    used: dict[int, int] = {}
    for s in pattern:
        used[s] = used.get(s, 0) + 1
    at = bisect_right(sizes, room) - 1
    while at >= 0 and room > 0:
        s = sizes[at]
        n = min(room // s, int(left[s]) - used.get(s, 0))
        if n > 0:
            pattern = [*pattern, *[s] * n]
            used[s] = used.get(s, 0) + n
            room -= n * s
        at = min(at - 1, bisect_right(sizes, room) - 1)
    return pattern


def _take(plan: Plan, pattern: list[int], left: np.ndarray, sizes: list[int]) -> int:
    """Repeat a pattern as often as the counts allow; the number of times."""
    need: dict[int, int] = {}
    for s in pattern:
        need[s] = need.get(s, 0) + 1
    times = min(int(left[s]) // n for s, n in need.items())
    for s, n in need.items():
        left[s] -= times * n
        if not left[s]:
            sizes.remove(s)
    plan.patterns.append((tuple(pattern), times))
    return times


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: total size, and sizes over half that can't share."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    suffix = np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    over = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    for k in np.flatnonzero(counts[: capacity // 2 + 1]).tolist():
        if k == 0:
            continue
        # sizes over capacity - k are alone among those of at least k
        high, half = capacity - k + 1, capacity // 2 + 1
        free = int(over[half] - over[high]) * capacity - int(suffix[half] - suffix[high])
        small = int(suffix[k] - suffix[half])
        best = max(best, int(over[half]) + max(0, -(-(small - free) // capacity)))
    return max(best, int(over[capacity // 2 + 1]))


def reachable(room: int, sizes: Sequence[int], left: np.ndarray) -> list[int]:
    """For each k the sums up to ``room`` that the ``k`` smallest sizes can make, as bits."""
    every, masks = (1 << room + 1) - 1, [1]
    for s in sizes:
        mask, n, step = masks[-1], min(int(left[s]), room // s), 1
        while n > 0:
            mask |= mask << min(step, n) * s & every
            n, step = n - step, 2 * step
        masks.append(mask)
        if mask == every:  # more sizes add nothing
            return masks + [every] * (len(sizes) + 1 - len(masks))
    return masks


def fillings(room: int, left: np.ndarray, most: int) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
    """All ways to fill ``room`` that waste at most ``most``, fullest first, as (size, times) from large to small, and their waste."""
    sizes = array("i", np.flatnonzero(left[: room + 1]).astype(np.int32).tobytes())
    held: list[list[int]] = []

    def masks() -> list[int]:
        if not held:
            held.append(reachable(room, sizes, left))
        return held[0]

    def exactly(target: int, k: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not target:
            yield ()
            return
        for j in range(bisect_right(sizes, target, 0, k) - 1, -1, -1):
            s = sizes[j]
            for n in range(min(int(left[s]), target // s), 0, -1):
                if masks()[j] >> target - n * s & 1:
                    for rest in exactly(target - n * s, j):
                        yield (s, n), *rest

    for waste in range(min(most, room) + 1):
        if masks()[-1] >> room - waste & 1:
            for filling in exactly(room - waste, len(sizes)):
                if len(sizes) > KEPT_MASKS:
                    held.clear()  # a deep search has many of these open, and few go on
                yield filling, waste


def dominated(filling: tuple[tuple[int, int], ...], waste: int, spare: int) -> bool:
    """Whether a part of the filling (or nothing) could give way to one document of ``spare`` (bits) that is larger, or as large
    as two or more, and fits in its place."""
    one, many = 0, 0
    for s, n in filling:
        for _ in range(n):
            many |= many << s | one << s
            one |= 1 << s
    reach, width = one | many | 1, 1
    while width < waste:  # bits t to t + width - 1 of every sum t
        step = min(width, waste - width)
        reach, width = reach | reach << step, width + step
    larger = reach << 1 if waste else 0
    return bool((larger | many) & spare)


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Bin completion branch-and-bound on a histogram of sizes (``counts[s]`` documents of size ``s``)."""
    counts = np.asarray(counts, dtype=np.int64)
    best = best_fit(counts, capacity)
    fewest, bound = best.sequences, lower_bound(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    if counts.max(initial=0) < 1 << 30:
        counts = counts.astype(np.int32)  # a deep search has many of them
    seen: dict[tuple, int] = {}
    visited = 0

    def children(left: np.ndarray, used: int, filled: int, way: tuple | None, but: tuple | None) -> Iterator[tuple]:
        """What one filling of the largest size leaves, the filling repeated as often as it can be, then less often.

        A filling repeated less often than it could be isn't taken again (``but``): that is the branch before.
        """
        nonlocal visited
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        room = capacity - largest
        exact = ((((room, 1),), 0),) if room and room < len(rest) and rest[room] else None  # one document that fills the room dominates all else
        spare = sum(1 << s for s in np.flatnonzero(rest[: room + 1]).tolist())
        for filling, waste in exact or fillings(room, rest, (fewest - 1 - used) * capacity - (total - filled)):
            visited += 1
            if visited > nodes:
                return
            if waste > (fewest - 1 - used) * capacity - (total - filled):
                return  # the incumbent got better
            gone = sum(1 << s for s, n in filling if n == rest[s])
            if filling == but or not exact and dominated(filling, waste, spare & ~gone):
                continue
            need = dict(filling)
            need[largest] = need.get(largest, 0) + 1
            most = min(int(left[s]) // n for s, n in need.items())
            pattern = tuple(x for s in sorted(need, reverse=True) for x in [s] * need[s])
            for times in range(most, 0, -1):
                after = left.copy()
                for s, n in need.items():
                    after[s] -= times * n
                yield after, used + times, filled + times * (capacity - waste), (pattern, times, way), filling if times < most else None
                visited += 1

    stack = [iter([(counts.copy(), 0, 0, None, None)])] if fewest > bound else []
    while stack and visited <= nodes and fewest > bound:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        left, used, filled, way, but = node
        if not left.any():
            if used < fewest:
                fewest, best = used, Plan(_unrolled(way))
            continue
        # the waste so far can't be made good: what is left needs its total size at least
        if used + -(-(total - filled) // capacity) >= fewest:
            continue
        state = (hashlib.blake2b(left.tobytes(), digest_size=16).digest(), but)
        if seen.get(state, used + 1) <= used:
            continue
        seen[state] = used
        stack.append(children(*node))
    best.bound, best.nodes, best.proven = bound, visited, fewest == bound or visited <= nodes
    return best


def _unrolled(way: tuple | None) -> list[tuple[tuple[int, ...], int]]:
    steps = []
    while way is not None:
        pattern, times, way = way
        steps.append((pattern, times))
    return steps[::-1]


@dataclass
class Slots:
    """A plan as arrays: for each size, runs of ranks that lie in one pattern."""

    low: dict[int, np.ndarray]
    per: dict[int, np.ndarray]  # documents of the size in the pattern
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: Plan) -> Slots:
        low, per, sequence, offset = {}, {}, {}, {}
        first, seen = 0, {}
        for pattern, times in plan.patterns:
            place = 0
            for s in sorted(set(pattern), reverse=True):
                n = pattern.count(s)
                for part, value in ((low, seen.get(s, 0)), (per, n), (sequence, first), (offset, place)):
                    part.setdefault(s, []).append(value)
                seen[s] = seen.get(s, 0) + n * times
                place += n * s
            first += times
        return cls(*({s: np.array(v, np.int64) for s, v in part.items()} for part in (low, per, sequence, offset)))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            rows = np.flatnonzero(size == s)
            at = np.searchsorted(self.low[s], rank[rows], side="right") - 1
            copy, nth = np.divmod(rank[rows] - self.low[s][at], self.per[s][at])
            sequence[rows] = self.sequence[s][at] + copy
            offset[rows] = self.offset[s][at] + nth * s
        return sequence, offset


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids, part, nth, doc_tokens``: ids as little-endian unsigned 32-bit bytes; ``nth`` counts the
    pieces of one length within the task ``part``."""
    bound_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                at = 0
                for piece in range(-(-n // capacity)):
                    length = n % capacity or capacity if piece == 0 else capacity
                    rows.append((key, piece, at, length, ids[4 * at : 4 * (at + length)], part, int(seen[length]), n))
                    seen[length] += 1
                    at += length
                held += len(ids)
                if held > 8 << 20:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint, doc_tokens bigint")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64()), ("doc_tokens", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, nodes: int = NODES, with_ids: bool = True) -> DataFrame:
    """Every piece and its place: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``."""
    return pack_by_plan(docs, tokenizer, capacity, nodes, with_ids)[0]


def pack_by_plan(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, nodes: int = NODES, with_ids: bool = True) -> tuple[DataFrame, Plan]:
    """What ``pack`` gives, and the plan with its sequences, bound and nodes."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, capacity).drop("doc_tokens"), "pieces")
    # counts by task and length: at most ``capacity`` for each task, whatever the tasks read
    held = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    plan = complete_bins(histogram, capacity, nodes)
    slots = spark.sparkContext.broadcast(Slots.of(plan))  # its size follows the capacity
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            size = columns["length"].to_numpy()
            sequence, offset = slots.value.find(size, columns.pop("before").to_numpy() + columns.pop("nth").to_numpy())
            columns.pop("part")
            columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    carried = ["doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else [])]
    # the counts grow with the number of tasks, so they are never broadcast
    ranked = pieces.select(*carried, "part", "nth").join(before.hint("merge"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "part", "nth", "before")
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint"), plan


def packing_digest(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece went, without its ids; rows, empty input and other columns as in ``pack``."""
    return pack(docs, tokenizer, capacity, with_ids=False)
