"""Language identification of whole texts, with spans of mixed-language text.

Scripts come first: each word's Unicode script leaves only the languages that were seen in that script.  Words are scored by
hashed character trigrams, one smoothed model per language, and Viterbi with a switching penalty labels the words; neighbours
with one label are a span.  A text's language is the one with the most letters, its score their share.

Most texts have one language; that the constant path is best is then certified from running sums (no run of words gains half the
penalty elsewhere), and only other texts go through the recursion.  The labels are the same.

The model is fitted on about ``TRAIN_DOCS`` labelled documents of each language (a bound, documented here), drawn by a hash of
their ids; ``crc32(doc_id) mod 5 = 0`` is held out.  Its size is bounded by languages times ``BUCKETS``.

Defined results: ``und`` with score 0 for null text, text without letters, and where no language was learned; among languages with
equally many letters the first by code point; rows that repeat are predicted alike, and a null doc_id is held out; very long texts
are read whole, ``STEP`` characters at a time; other columns, whatever their names, are not looked at by the query and kept as they
are by the stage; an empty table gives no rows, and the stage no documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches

TRAIN_DOCS = 2000
BUCKETS = 1 << 16
PENALTY = 12.0
SMOOTHING = 0.3
#: A language is a candidate in a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: Cost of a word for a language that is no candidate in its script.
EXCLUDED = -40.0
UNKNOWN = "und"
#: Characters handled at once.
STEP = 1 << 20

# First code points of Unicode ranges by script; "other" between them.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))
_STARTS = np.array([at for at, _ in SCRIPT_STARTS], np.uint32)
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def lowered(text: str) -> str:
    """Lower case, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def word_features(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of about STEP characters: offset, starts and ends of words, first letters, trigram bucket of each letter."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        code = np.frombuffer(lowered(text[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[code]
        x = np.zeros(len(code) + 2, np.uint32)
        x[1:-1] = np.where(letter, code, 0)
        with np.errstate(over="ignore"):
            mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (mixed >> np.uint32(16)).astype(np.int64)
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            yield at, starts, ends, code[starts], bucket
        at = end


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # bucket by language
    allowed: np.ndarray  # script by language

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> Model:
        names = sorted(counts)
        if not names:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
        table = np.stack([counts[x] for x in names], axis=1).astype(np.float64) + SMOOTHING
        logs = np.log(table / table.sum(axis=0)).astype(np.float32)
        seen = np.stack([scripts[x] / max(1, scripts[x].sum()) for x in names], axis=1)
        return cls(names, logs, seen >= SCRIPT_SHARE)

    def label(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and languages of the words."""
        starts, ends, scores = [], [], []
        for at, s, e, first, bucket in word_features(text or ""):
            starts.append(s + at)
            ends.append(e + at)
            if self.languages:
                bounds = np.stack([s, np.minimum(e, len(bucket) - 1)], axis=1).ravel()  # words and the gaps between them
                rows = self.logs[bucket]
                score = np.add.reduceat(rows, bounds, axis=0)[::2].astype(np.float64)
                if e[-1] == len(bucket) and e[-1] - s[-1] > 1:  # the last word reaches the end
                    score[-1] += rows[-1]
                ok = self.allowed[_SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]]
                some = ok.any(axis=1)
                score[~some] = 0
                score[some[:, None] & ~ok] += EXCLUDED
                scores.append(score)
        if not starts:
            none = np.empty(0, np.int64)
            return none, none, none
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        return starts, ends, viterbi(np.concatenate(scores), PENALTY) if self.languages else np.full(len(starts), -1)

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score and spans (start, end, language) in code points."""
        starts, ends, label = self.label(text)
        if not len(starts) or not self.languages:
            return UNKNOWN, 0.0, []
        weight = np.bincount(label, ends - starts, len(self.languages))
        best = int(np.argmax(weight))
        first = np.flatnonzero(np.diff(label, prepend=-1))
        last = np.append(first[1:], len(label)) - 1
        spans = [(int(starts[a]), int(ends[b]), self.languages[label[a]]) for a, b in zip(first, last, strict=True)]
        return self.languages[best], float(weight[best] / weight.sum()), spans


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of words (rows) when each change of label costs ``penalty``; of equal paths the smaller label, staying first."""
    n, k = scores.shape
    best = int(np.argmax(scores.sum(axis=0)))
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores - scores[:, best : best + 1], axis=0)])
    if (sums - np.minimum.accumulate(sums, axis=0)).max() < penalty / 2:
        return np.full(n, best)
    rows = scores.tolist()
    value = rows[0]
    back = []
    for row in rows[1:]:
        top = max(value)
        frm, top = value.index(top), top - penalty
        back.append([i if v >= top else frm for i, v in enumerate(value)])
        value = [(v if v >= top else top) + s for v, s in zip(value, row, strict=True)]
    at = value.index(max(value))
    out = np.empty(n, np.int64)
    for t in range(n - 1, 0, -1):
        out[t] = at
        at = back[t - 1][at]
    out[0] = at
    return out


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of documents that are not held out."""
    bound_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not totals:
        return Model.of({}, {})
    part = F.lit(0.0)
    for name, n in totals.items():
        part = F.when(F.col("lang") == name, F.lit(min(1.0, train_docs / n))).otherwise(part)
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = found.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for _, s, e, first, bucket in word_features(text.as_py()):
                    inside = np.zeros(len(bucket) + 1, np.int8)
                    np.add.at(inside, s, 1)
                    np.add.at(inside, e, -1)
                    table[:BUCKETS] += np.bincount(bucket[np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)
                    script = _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]
                    table[BUCKETS:] += np.bincount(script, e - s, len(SCRIPTS)).astype(np.int64)
        for name, table in found.items():
            slot = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot, pa.int32()), pa.array(table[slot])], names=["lang", "slot", "n"])

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = {name: np.zeros(BUCKETS + len(SCRIPTS)) for name in totals}
    table = rows.toPandas()  # at most languages x BUCKETS rows
    for name, some in table.groupby("lang"):
        counts[name][some["slot"].to_numpy()] = some["n"].to_numpy()
    return Model.of({k: v[:BUCKETS] for k, v in counts.items()}, {k: v[BUCKETS:] for k, v in counts.items()})


def identify(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` (and ``spans``); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                columns.append(pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in found], kind))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spans = ", spans array<struct<start: bigint, end: bigint, lang: string>>" if with_spans else ""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double" + spans)


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every document, by a model of those that are not held out."""
    return identify(docs, fit(docs))


def keep_identified(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """Documents, with all their columns, whose language is known and holds at least that share of the letters."""
    shared, place = docs.sparkSession.sparkContext.broadcast(fit(docs)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shared.value.predict(t.as_py()) for t in batch.column(place))
            yield batch.filter(pa.array([name != UNKNOWN and score >= least_score for name, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
