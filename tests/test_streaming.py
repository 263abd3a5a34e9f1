import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veriloom.operators import eventlog
from veriloom.sources.store import ArtifactError
from veriloom.streaming import state
from veriloom.streaming.publish import PublishedTable

LEGAL = {"start": ("a",), "a": ("b",), "b": ("a", "c")}
BEGIN = datetime(2026, 1, 1)


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def streamed(spark, tmp_path, name, batches, schema, operator):
    """What an operator gives for batches that come one after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"in{k:03}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    query = operator(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_equal_batch_for_rows_in_any_order(spark, few_partitions, tmp_path):
    r = random.Random(3)
    rows = [(s, k, r.choice("abc"), r.random() < 0.7, at(k)) for s in "pqrs" for k in range(r.randrange(5, 25))]
    r.shuffle(rows)
    batches = [rows[low : low + 20] for low in range(0, len(rows), 20)]
    schema = "stream string, seq bigint, phase string, ok boolean, ts timestamp"
    log = spark.createDataFrame(rows, schema)
    got = streamed(spark, tmp_path, "illegal", batches, schema, lambda s: state.illegal_transitions(s.select("stream", "seq", "phase", "ts"), LEGAL))
    want = eventlog.illegal_transitions(log, "stream", "seq", "phase", LEGAL)
    assert sorted(got) == sorted((*tuple(x), "illegal") for x in want.collect()) and got
    got = streamed(spark, tmp_path, "confirmed", batches, schema, lambda s: state.confirmations(s.select("stream", "seq", "ok", "ts"), 3))
    want = eventlog.first_confirmation(log, "stream", ["seq"], F.col("ok"), 3).filter("confirmed_at is not null")
    assert sorted(got) == sorted((x["stream"], x["confirmed_at"] - 1) for x in want.collect())


def test_a_lost_row_is_waited_for_until_the_watermark(spark, few_partitions, tmp_path):
    schema = "stream string, seq bigint, phase string, ts timestamp"
    batches = [
        [("x", 0, "a", at(0)), ("x", 2, "a", at(2)), ("x", 3, "c", at(3))],  # 1 is missing
        [("y", 0, "a", at(100))],  # the watermark passes 3
        [("y", 1, "c", at(101))],
        [("x", 1, "b", at(102)), ("x", 4, "a", at(103))],  # too late for its place
    ]
    got = streamed(spark, tmp_path, "lost", batches, schema, lambda s: state.illegal_transitions(s, LEGAL, "10 seconds"))
    assert sorted(got, key=str) == sorted([("x", 2, "a", "a", "illegal"), ("x", 3, "a", "c", "illegal"), ("y", 1, "a", "c", "illegal"), ("x", 1, None, "b", "late"), ("x", 4, "c", "a", "illegal")], key=str)


def test_commands_and_their_deadlines(spark, few_partitions, tmp_path):
    schema = "command_id string, kind string, ts timestamp"
    batches = [
        [("quick", "pending", at(0)), ("quick", "completed", at(5)), ("slow", "pending", at(0)), ("never", "pending", at(1)), ("turned", "completed", at(9))],
        [("turned", "pending", at(8)), ("quick", "completed", at(6)), ("orphan", "completed", at(20))],
        [("slow", "completed", at(40)), ("other", "pending", at(70))],
        [("other", "completed", at(71))],
        [("last", "pending", at(300))],
        [("last", "pending", at(301))],
    ]
    got = streamed(spark, tmp_path, "commands", batches, schema, lambda s: state.command_outcomes(s, 30, "5 seconds"))
    assert sorted(got, key=str) == sorted([
        ("quick", at(0), at(5), "completed"), ("turned", at(8), at(9), "completed"), ("other", at(70), at(71), "completed"),
        ("never", at(1), None, "timed_out"), ("slow", at(0), at(40), "timed_out"), ("orphan", None, at(20), "completed_only"),
    ], key=str)


def test_publication_is_exactly_once(spark, tmp_path):
    published = PublishedTable(spark, str(tmp_path / "table"), "id bigint, v string")
    rows = [spark.createDataFrame([(k, f"v{k}"), (k + 10, "w")], "id bigint, v string") for k in range(3)]
    assert published.latest() == -1 and published.read().count() == 0
    with pytest.raises(ArtifactError):
        published.publish(rows[1], 1)  # a gap
    assert published.publish(rows[0], 0)
    assert not published.publish(rows[1], 0)  # run again: nothing changes
    # an attempt that wrote its rows and crashed before the commit
    rows[2].write.parquet(f"{published.root}/data/version=1")
    assert published.read().count() == 2 and published.latest() == 0
    assert published.publish(rows[1], 1) and published.read().count() == 4
    assert sorted(r["id"] for r in published.read(0).collect()) == [0, 10]
    assert {r["version"]: r["passed"] for r in published.verify().collect()} == {0: True, 1: True}
    rows[2].limit(1).write.mode("append").parquet(f"{published.root}/data/version=1")
    assert {r["version"]: r["passed"] for r in published.verify().collect()} == {0: True, 1: False}
    with pytest.raises(ArtifactError):
        published.read(5)


def test_a_stream_that_is_stopped_and_run_again(spark, tmp_path):
    schema = "id bigint, v string"
    source, published = str(tmp_path / "in"), PublishedTable(spark, str(tmp_path / "out"), schema)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = published.writer(stream, str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(3):
        spark.createDataFrame([(k, "x")], schema).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    run("c1")
    spark.createDataFrame([(3, "y")], schema).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    assert sorted(r["id"] for r in published.read().collect()) == [0, 1, 2, 3]
    versions = published.latest()
    run("c2")  # a lost checkpoint replays every batch under its number
    assert sorted(r["id"] for r in published.read().collect()) == [0, 1, 2, 3] and published.latest() == versions
    assert all(r["passed"] for r in published.verify().collect())
