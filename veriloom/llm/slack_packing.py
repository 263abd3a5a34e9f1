"""Packing by minimum bin slack: each window takes the multiset of remaining lengths whose sum comes closest to the capacity.

Lengths are whole numbers up to the capacity, so the whole corpus is a histogram of at most ``capacity`` counts.  A window opens with
the longest piece left; subset sums of the other lengths, as often as they are left, are the bits of whole numbers, one for each
number of lengths allowed, and walking back from the highest sum that fits gives how often each length is taken, long ones first.
The filling is repeated as often as the counts allow.

If no filling is exact, nothing that is left fits the slack, so the longest piece left is cut: its first tokens fill the window and
the rest waits as a piece of its own.  A window of a power of two needs no padding and is not filled up.  What can't fill a last
window is laid out in windows of powers of two.  So nothing is padded, documents of up to ``capacity`` tokens are cut only where no
filling is exact, and the plan's size depends on the capacity, not on the corpus.

Pieces then take their places in parallel: every piece knows its rank within its length (counted in the task that made it, plus the
counts of earlier tasks), and the plan maps length and rank to sequence and offset, or to the two parts of a cut.

Defined results: null and empty text are one end id; rows that repeat a doc_id, or have none, are packed as documents of their own;
very long texts are cut into full windows and a rest; other columns, whatever their names, are not looked at; ties between fillings
go to longer pieces; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import cut_pieces, reachable
from .storage import written

CAPACITY = 4096
END_ID = 2


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Kind:
    """Pieces of one length and origin: whole ones, or rests of a cut.  Ranks from ``low[i]`` on (to ``low[i + 1]``) lie ``per[i]`` to
    a window at ``offset[i]``, or, if ``rest[i]`` names a kind, are cut after ``head[i]`` tokens."""

    size: int
    count: int
    start: int = 0
    taken: int = 0
    low: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    head: list[int] = field(default_factory=list)
    rest: list[int] = field(default_factory=list)

    def add(self, n: int, per: int, sequence: int, offset: int, head: int, rest: int) -> None:
        for held, value in zip((self.low, self.per, self.sequence, self.offset, self.head, self.rest), (self.taken, per, sequence, offset, head, rest), strict=True):
            held.append(value)
        self.taken += n

    @property
    def left(self) -> int:
        return self.count - self.taken


class SlackPlan:
    """The packing of a histogram (``counts[s]`` pieces of length ``s``); kinds 0 to ``capacity`` are the whole pieces by length."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity, self.sequences, self.cuts, self.fillings = capacity, 0, 0, 0
        self.left = [*np.asarray(counts, np.int64).tolist(), *[0] * (capacity + 1 - len(counts))]
        self.kinds = [Kind(s, n) for s, n in enumerate(self.left)]
        self.sizes = [s for s, n in enumerate(self.left) if n]  # lengths with pieces left, and their kinds
        self.of = {s: [s] for s in self.sizes}
        while self.sizes:
            self._window()
        self.numbered = [tuple(np.array(x, np.int64) for x in (k.low, k.per, k.sequence, k.offset, k.head, k.rest)) for k in self.kinds]

    def filling(self) -> tuple[dict[int, int], int]:
        """How often the next window takes each length, and its slack."""
        self.fillings += 1
        longest = self.sizes[-1]
        room, need = self.capacity - longest, {longest: 1}
        if room and room != longest and self.left[room]:
            return need | {room: 1}, 0  # the longest that fits fills it
        own = self.left[longest]
        self.left[longest] = own - 1
        sizes = self.sizes[: bisect_right(self.sizes, room)]
        if longest <= room and own == 1:
            sizes.pop()
        sums = reachable(room, sizes, self.left)
        target = sums[-1].bit_length() - 1
        slack = room - target
        k = len(sizes)
        while target:
            k = bisect_right(sizes, target, 0, k) - 1
            size = sizes[k]
            n = next(n for n in range(min(self.left[size], target // size), -1, -1) if sums[k] >> target - n * size & 1)
            if n:
                need[size] = need.get(size, 0) + n
                target -= n * size
        self.left[longest] = own
        return need, slack

    def _window(self) -> None:
        need, slack = self.filling()
        full = self.capacity - slack
        donor = 0
        if slack and full & full - 1:
            donor = next((s for s in reversed(self.sizes) if self.left[s] > need.get(s, 0)), 0)
            if not donor:
                self._last()
                return
        wanted = need | ({donor: need.get(donor, 0) + 1} if donor else {})
        times = min(self.left[size] // n for size, n in wanted.items())
        place = 0
        for size in sorted(need, reverse=True):
            self._take(size, need[size], times, place)
            place += need[size] * size
        if donor:
            self._cut(donor, slack, times, place)
        self.sequences += times

    def _kinds(self, size: int, n: int) -> Iterator[tuple[Kind, int]]:
        """Kinds that give ``n`` pieces of a length, and how many each."""
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        while n:
            kind = self.kinds[self.of[size][-1]]
            some = min(n, kind.left)
            yield kind, some
            n -= some
            if not kind.left:
                self.of[size].pop()

    def _take(self, size: int, per: int, times: int, place: int) -> None:
        done = 0
        for kind, n in self._kinds(size, per * times):
            # where a kind ends within a window, the window's pieces come from two
            while n:
                window, nth = divmod(done, per)
                some = min(n, per - nth) if nth or n < per else n // per * per
                kind.add(some, per if not nth and some >= per else some, self.sequences + window, place + nth * size, size, -1)
                done, n = done + some, n - some

    def _cut(self, size: int, head: int, times: int, place: int) -> None:
        done = 0
        for kind, n in self._kinds(size, times):
            rest = len(self.kinds)
            kind.add(n, 1, self.sequences + done, place, head, rest)
            self.kinds.append(Kind(size - head, n, kind.start + head))
            self.of.setdefault(size - head, []).append(rest)
            if not self.left[size - head]:
                insort(self.sizes, size - head)
            self.left[size - head] += n
            done += n
        self.cuts += times

    def _last(self) -> None:
        """Pieces that are all that is left and no power of two: windows of powers of two, from large to small."""
        while self.sizes:
            total = sum(s * self.left[s] for s in self.sizes)
            window = min(1 << total.bit_length() - 1, self.capacity)
            place = 0
            while place < window:
                size = self.sizes[-1]
                if size <= window - place:
                    self._take(size, 1, 1, place)
                    place += size
                else:
                    self._cut(size, window - place, 1, place)
                    place = window
            self.sequences += 1

    def places(self, kind: int, row: np.ndarray, rank: np.ndarray, start: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
        """``row, start, length, sequence, offset`` of the parts of pieces of a kind; a cut goes on with its rest."""
        low, per, sequence, offset, head, rest = self.numbered[kind]
        at = np.searchsorted(low, rank, side="right") - 1
        copy, nth = np.divmod(rank - low[at], per[at])
        yield row, np.full(len(row), start), head[at], sequence[at] + copy, offset[at] + nth * head[at]
        for i in np.unique(at[rest[at] >= 0]).tolist():
            own = at == i
            yield from self.places(int(rest[i]), row[own], rank[own] - low[i], start + int(head[i]))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """``row, start, length, sequence, offset`` of all parts of pieces."""
        found = [part for size in np.unique(length).tolist() for own in [np.flatnonzero(length == size)] for part in self.places(size, own, rank[own])]
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> tuple[DataFrame, SlackPlan]:
    """``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset`` of every piece, and the plan."""
    pieces = written(cut_pieces(docs, tokenizer or word_tokenizer(), capacity, end_id).drop("piece"), "pieces")
    held = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    plan = SlackPlan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # its size follows the capacity
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            row, low, length, sequence, offset = shared.value.find(column["length"].to_numpy(), column["before"].to_numpy() + column["nth"].to_numpy())
            ids = [column["ids"][i].as_py()[4 * a : 4 * (a + n)] for i, a, n in zip(row.tolist(), low.tolist(), length.tolist(), strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [column["doc_id"].take(at), pa.array(column["start"].to_numpy()[row] + low), pa.array(length), pa.array(ids, pa.binary()), pa.array(map(zlib.crc32, ids), pa.int64()), column["doc_tokens"].take(at), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    # the counts grow with the number of tasks, so they are never broadcast
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).select("doc_id", "start", "length", "ids", "doc_tokens", "nth", "before")
    return ranked.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"), plan


def packing_report(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece went, without its ids."""
    return pack(docs, tokenizer, capacity)[0].select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
