"""Ordered event logs: legality, pairing, hash chains, replay and streaks.  All windows are per stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, record, sha256_text

START = "start"


def illegal_transitions(log: DataFrame, stream: str, seq: str, phase: str, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose phase doesn't follow from the one before; a stream's first row follows ``start``."""
    before = F.coalesce(F.lag(phase).over(Window.partitionBy(stream).orderBy(seq)), F.lit(START))
    steps = F.array(*(F.lit(f"{a}>{b}") for a, many in sorted(legal.items()) for b in many))
    rows = log.withColumn("before", before)
    return rows.filter(~F.array_contains(steps, F.concat_ws(">", "before", F.col(phase)))).select(stream, seq, "before", phase)


def final_phase(log: DataFrame, stream: str, seq: str, phase: str) -> DataFrame:
    return log.groupBy(stream).agg(F.max_by(phase, seq).alias("final"), F.count(F.lit(1)).alias("n"))


def final_phase_findings(log: DataFrame, incidents: DataFrame, stream: str, seq: str, phase: str, final: dict[str, str]) -> DataFrame:
    """``stream, status, final, wanted`` where a stream's last phase isn't the one that its incident's status asks for.

    ``incidents`` has ``stream, status``; ``final`` names the phase of each status, and a status that it doesn't name is a finding with
    ``wanted`` null.  A stream without events ends in ``start``.
    """
    wanted = F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(final.items()) for x in pair)), F.col("status"))
    last = final_phase(log, stream, seq, phase).select(stream, "final")
    rows = incidents.select(stream, "status").join(last, stream, "left").withColumns({"final": F.coalesce("final", F.lit(START)), "wanted": wanted})
    return rows.filter(F.col("wanted").isNull() | (F.col("final") != F.col("wanted"))).select(stream, "status", "final", "wanted")


def sequence_gaps(log: DataFrame, stream: str, seq: str) -> DataFrame:
    """Numbers after which one or more are missing."""
    before = F.lag(seq).over(Window.partitionBy(stream).orderBy(seq))
    rows = log.select(stream, F.col(seq).alias("seq"), before.alias("before"))
    return rows.filter(F.col("seq") > F.col("before") + 1).withColumn("fault", F.lit("gap"))


def sequence_faults(log: DataFrame, stream: str, position: str, seq: str) -> DataFrame:
    """Sequence numbers below 1 or below the one before, in the order of the log's own positions; equal ones are allowed."""
    before = F.lag(seq).over(Window.partitionBy(stream).orderBy(position))
    rows = log.select(stream, F.col(position).alias("position"), F.col(seq).alias("seq"), before.alias("before"))
    fault = F.when(F.coalesce(F.col("seq") < 1, F.lit(True)), "below_one").when(F.col("seq") < F.col("before"), "decreasing")
    return rows.withColumn("fault", fault).filter("fault is not null")


def unmatched(pending: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = pending.select(key).distinct().withColumn("p", F.lit(1)), completed.select(key).distinct().withColumn("c", F.lit(1))
    rows = a.join(b, key, "full_outer").filter("p is null or c is null")
    return rows.select(key, F.when(F.col("p").isNull(), "completed_only").otherwise("pending_only").alias("side"))


def event_hash(previous: Column, payload: Column) -> Column:
    return F.concat(F.lit("evhash-"), F.substr(sha256_text(canonical_json(record(payload=payload, previous=previous))), F.lit(1), F.lit(24)))


def build_chain(log: DataFrame, stream: str, seq: str, payload: str) -> DataFrame:
    """Each event with the hash of its predecessor and its own: ``stream, seq, payload, previous, hash``.

    A chain is sequential within its stream by nature.  Streams are spread over tasks and sorted, and one pass carries nothing but
    the last hash, however long a stream is.
    """
    kind = log.schema[stream].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no stream is equal to it
        last = ""
        for batch in batches:
            previous, hashes = [], []
            for name, text, seed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if name != current:
                    current, last = name, f"seed-{seed or ''}"
                previous.append(last)
                line = json.dumps({"payload": text, "previous": last}, separators=(",", ":"), ensure_ascii=False)
                last = f"evhash-{hashlib.sha256(line.encode()).hexdigest()[:24]}"
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(previous, pa.string()), pa.array(hashes, pa.string())], names=[stream, "seq", "payload", "previous", "hash"])

    rows = log.select(stream, F.col(seq).cast("bigint").alias("seq"), F.col(payload).alias("payload"), F.col(stream).cast("string").alias("__seed"))
    rows = rows.repartition(stream).sortWithinPartitions(stream, "seq", "payload")
    return rows.mapInArrow(run, f"`{stream}` {kind}, seq bigint, payload string, previous string, hash string")


def broken_links(chain: DataFrame, stream: str) -> DataFrame:
    """Events whose predecessor or own hash is wrong; each row is checked by itself and its neighbour."""
    expected = F.coalesce(F.lag("hash").over(Window.partitionBy(stream).orderBy("seq")), F.concat(F.lit("seed-"), F.col(stream).cast("string")))
    rows = chain.withColumns({"link": F.col("previous") == expected, "own": F.col("hash") == event_hash(F.col("previous"), F.col("payload"))})
    return rows.filter("not link or not own").select(stream, "seq", "link", "own")


def expected_frames(plans: DataFrame) -> DataFrame:
    """The event skeleton of ``plans(plan_id, epochs, batches, accumulation)``: started, per epoch its batches and steps, finished.

    Places are computed, not counted, so nothing is sorted.  Epochs are dealt over tasks before they are expanded: what follows is
    shuffled by the size of the frames, not by that of the plans.  A plan without epochs or batches only starts and finishes.
    """
    n, epochs, last = F.col("__batches"), F.col("__epochs"), F.col("__epochs") + 1
    steps_before = lambda batch: F.coalesce(F.floor((batch - 1) / F.abs("accumulation")), F.lit(0))  # noqa: E731 - every epoch ends in a step
    rows = plans.select("plan_id", "epochs", "batches", "accumulation", *(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(f"__{c}") for c in ("epochs", "batches")))
    rows = rows.withColumn("__length", F.when(n > 0, n + steps_before(n) + 2).otherwise(0))  # rows of an epoch
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0), last))).repartition("plan_id", "__epoch")
    epoch, batch = F.col("__epoch"), F.col("__batch")
    edge = (epoch == 0) | (epoch == last)
    rows = rows.withColumn("__batch", F.explode(F.when(edge, F.sequence(F.lit(1), F.lit(1))).when(n > 0, F.sequence(F.lit(1), n))))
    step = (batch % F.col("accumulation") == 0) | (batch == n)
    inner = F.array_compact(F.array(F.lit("batch"), F.when(step, F.lit("step")), F.when(batch == n, F.lit("epoch_end"))))
    events = F.when(epoch == 0, F.array(F.lit("started"))).when(epoch == last, F.array(F.lit("finished"))).otherwise(inner)
    rows = rows.select("*", F.posexplode(events).alias("__place", "event"))
    seq = F.when(epoch == 0, 0).when(epoch == last, 1 + epochs * F.col("__length")).otherwise((epoch - 1) * F.col("__length") + batch + steps_before(batch) + F.col("__place"))
    of = lambda value, end: F.when(epoch == 0, 0).when(epoch == last, end).otherwise(value)
    return rows.select("plan_id", seq.cast("int").alias("seq"), of(epoch, F.col("epochs")).alias("epoch"), of(batch, F.col("batches")).alias("batch"), "event")


def replay_differences(expected: DataFrame, recorded: DataFrame) -> DataFrame:
    a, b = expected.select("plan_id", "seq", F.col("event").alias("expected")), recorded.select("plan_id", "seq", F.col("event").alias("recorded"))
    return a.join(b, ["plan_id", "seq"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("recorded")))


def epochs_completed(frames: DataFrame) -> DataFrame:
    """Epochs that are complete at each optimizer step; rows that are neither a step nor an epoch's end are left out before they are sorted."""
    done = F.sum(F.when(F.col("event") == "epoch_end", 1).otherwise(0)).over(Window.partitionBy("plan_id").orderBy("seq"))
    some = frames.filter(F.col("event").isin("step", "epoch_end"))
    return some.withColumn("completed", done).filter("event = 'step'").select("plan_id", "seq", "epoch", "completed")


def first_confirmation(log: DataFrame, stream: str, order: list[str], ok: Column, times: int) -> DataFrame:
    """Per stream the first row at which ``ok`` held ``times`` in a row, with the row's ordinal; null if it never did."""
    window = Window.partitionBy(stream).orderBy(*order)
    rows = log.select(stream, *order, ok.alias("ok")).withColumn("attempt", F.row_number().over(window))
    rows = rows.withColumn("island", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(window))
    rows = rows.withColumn("streak", F.when(F.col("ok"), F.row_number().over(Window.partitionBy(stream, "island", "ok").orderBy(*order))).otherwise(0))
    return rows.groupBy(stream).agg(F.min(F.when(F.col("streak") >= times, F.col("attempt"))).alias("confirmed_at"), F.max("streak").alias("longest"), F.count(F.lit(1)).alias("attempts"))


def polled(log: DataFrame, stream: str, order: list[str], ok: Column, times: int, deadline: int) -> DataFrame:
    """``stream, confirmed_at, attempts, outcome`` of polling that ends at the ``times``-th success in a row or after ``deadline`` attempts:
    ``confirmed``, ``timed_out``, or ``unfinished`` where the log ends before either."""
    rows = first_confirmation(log, stream, order, ok, times)
    at = F.when(F.col("confirmed_at") <= deadline, F.col("confirmed_at"))
    outcome = F.when(at.isNotNull(), "confirmed").when(F.col("attempts") >= deadline, "timed_out").otherwise("unfinished")
    return rows.select(stream, at.alias("confirmed_at"), F.least(F.coalesce(at, F.col("attempts")), F.lit(deadline)).alias("attempts"), outcome.alias("outcome"))


def phase_prefixes(log: DataFrame, stream: str, seq: str, phase: str, canonical: list[str]) -> DataFrame:
    """Whether each stream's phases are a prefix of the canonical ones."""
    names = F.array(*map(F.lit, canonical))
    place = F.row_number().over(Window.partitionBy(stream).orderBy(seq))
    rows = log.withColumn("place", place).withColumn("fits", F.coalesce(F.try_element_at(names, F.col("place")) == F.col(phase), F.lit(False)))
    return rows.groupBy(stream).agg(F.bool_and("fits").alias("is_prefix"), F.count(F.lit(1)).alias("n"))


def attempts(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Attempt numbers per group; a retry is an attempt beyond the first."""
    numbered = rows.withColumn("attempt", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return numbered.groupBy(group).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("attempt") > 1).alias("retries"))
