import pytest
from pyspark.sql import functions as F

from veriloom.operators import eventlog


def brute(epochs, batches, accumulation):
    rows = [(0, 0, "started")]
    for e in range(1, epochs + 1):
        for b in range(1, batches + 1):
            rows.append((e, b, "batch"))
            if b % accumulation == 0 or b == batches:
                rows.append((e, b, "step"))
            if b == batches:
                rows.append((e, b, "epoch_end"))
    return [(k, *r) for k, r in enumerate([*rows, (epochs, batches, "finished")])]


def grouped(spark):
    """Plans as the queries get them: counted, so that they lie by plan."""
    rows = spark.range(600).groupBy((F.col("id") % 40).alias("plan_id")).agg(F.count(F.lit(1)).cast("int").alias("batches"))
    return rows.select("plan_id", F.lit(2).alias("epochs"), "batches", F.lit(2).alias("accumulation"))


def above_generate(df):
    """The part of a physical plan that is done after rows are expanded."""
    return df._jdf.queryExecution().executedPlan().toString().split("Generate")[0]


@pytest.mark.parametrize("epochs, batches, accumulation", [(1, 1, 1), (1, 7, 2), (3, 4, 2), (2, 5, 9), (2, 3, 1), (0, 3, 2), (2, 0, 2)])
def test_frames_against_brute_force(spark, epochs, batches, accumulation):
    plans = spark.createDataFrame([(1, epochs, batches, accumulation)], "plan_id bigint, epochs int, batches int, accumulation int")
    got = [tuple(r)[1:] for r in eventlog.expected_frames(plans).orderBy("seq").collect()]
    assert got == brute(epochs, batches, accumulation) or (batches == 0 and got == [(0, 0, 0, "started"), (1, epochs, 0, "finished")])


def test_frames_are_not_sorted_and_compared_by_their_own_size(spark):
    frames = eventlog.expected_frames(grouped(spark))
    whole = frames._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in whole and "Sort" not in whole
    assert "Exchange" in above_generate(eventlog.replay_differences(frames, frames.filter("seq <> 3")))
    assert eventlog.replay_differences(frames, frames.filter("seq <> 3")).count() == 40


def test_completed_epochs_sort_steps_and_ends_only(spark, tmp_path):
    eventlog.expected_frames(grouped(spark)).write.parquet(str(tmp_path / "frames"))
    done = eventlog.epochs_completed(spark.read.parquet(str(tmp_path / "frames")))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (step,epoch_end)" in plan.split("Window")[-1]
    rows = done.collect()
    assert len(rows) == 40 * 2 * 8 and all(r["completed"] == r["epoch"] - 1 for r in rows)
