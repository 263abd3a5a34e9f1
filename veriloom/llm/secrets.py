"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of token characters.  An allow-list of placeholder words and runs of the alphabet is cut out of it;
what is left on either side is judged for itself, so such a word suppresses itself and not the secret it is glued to.  Within a
candidate, each character class has its own runs and its own threshold: a window of ``WINDOW`` characters moves over the run, its
entropy is kept up to date from counts of the characters that enter and leave, and windows at or above the threshold merge into one
span.  A window without digits needs the higher threshold ``LETTERS``; one without letters, or that mostly counts up or down the
alphabet, is no secret.

Defined results: null and empty texts have no spans; rows that repeat, with or without an id, are scanned alike; offsets are code
points, ends exclusive; very long texts are scanned whole, in batches bounded by bytes; other columns, whatever their names, are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character classes and the entropy, in bits for a character, from which a window is suspicious.
CLASSES = (
    ("lower hex", re.compile(r"[0-9a-f]{20,}"), 3.0),
    ("upper hex", re.compile(r"[0-9A-F]{20,}"), 3.0),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]{20,}"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALLOWED = re.compile(r"example|sample|dummy|placeholder|changeme|redacted|xxxx|abcdef|012345|123456", re.IGNORECASE)
#: Entropy from which a window without digits is suspicious; long words in camel case stay below.
LETTERS = 4.1

_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def windows_above(run: str, threshold: float, window: int = WINDOW, letters: float = LETTERS) -> Iterator[tuple[int, int]]:
    """Merged [start, end) of the windows of ``run`` that have a letter and an entropy of at least ``threshold`` (without digits
    ``letters``, if that is more), and in which most characters aren't neighbours in the alphabet of the one before.

    With counts n of its characters a window has entropy log2(w) - sum(n log2 n) / w; the sum changes by two terms a step.
    """
    counts: dict[str, int] = {}
    total, n_digits, n_letters, n_steps = 0.0, 0, 0, 0
    limit, strict = ((math.log2(window) - max(t, threshold)) * window + 1e-9 for t in (threshold, letters))
    start = end = -1
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        n_digits += c.isdigit()
        n_letters += c.isalpha()
        n_steps += i > 0 and abs(ord(c) - ord(run[i - 1])) == 1
        if i >= window:
            old = run[i - window]
            n = counts[old]
            total += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
            n_digits -= old.isdigit()
            n_letters -= old.isalpha()
            n_steps -= abs(ord(run[i - window + 1]) - ord(old)) == 1
        if i >= window - 1 and n_letters and 2 * n_steps <= window and total <= (limit if n_digits else strict):
            if i - window + 1 > end:
                if end >= 0:
                    yield start, end
                start = i - window + 1
            end = i + 1
    if end >= 0:
        yield start, end


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for candidate in CANDIDATE.finditer(text):
        at = candidate.start()
        for word in [*ALLOWED.finditer(text, candidate.start(), candidate.end()), None]:
            end = word.start() if word else candidate.end()
            if end - at >= WINDOW:
                for _, pattern, threshold in CLASSES:
                    for run in pattern.finditer(text, at, end):
                        found += [(run.start() + a, run.start() + b) for a, b in windows_above(run[0], threshold)]
            at = word.end() if word else end
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start, then of kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, found``: all spans as ``kind, start, end``."""

    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = sorted(base_spans(text) + [(a, 3, b) for a, b in entropy_spans(text)])
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, found array<struct<kind: string, start: bigint, end: bigint>>")


def secret_report(docs: DataFrame) -> DataFrame:
    def many(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = text(F.filter("found", lambda x: x["kind"] != "entropy"))
    return scan(docs).select(
        "doc_id", many("assign"), many("access"), many("hex"), many("entropy"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), text("found").alias("spans")
    )
