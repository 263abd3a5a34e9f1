import pytest
from pyspark.sql import functions as F

from veriloom.operators import order
from veriloom.plans.kinds import KINDS, metrics_of
from veriloom.sources.shelf import Kind, Shelf
from veriloom.sources.store import ArtifactError

PLAIN = {"plain": Kind({"rows": "k bigint, v string", "notes": "note string"})}


def made(spark, artifacts, rows=3):
    df = spark.range(artifacts * rows).select((F.col("id") % rows).alias("k"), F.lit("v").alias("v"), F.concat(F.lit("a"), F.floor(F.col("id") / rows)).alias("artifact"))
    return {"rows": df, "notes": spark.createDataFrame([], "note string, artifact string")}


def test_round_trip_tamper_and_refusal(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path), PLAIN)
    assert shelf.listing("plain").count() == 0
    shelf.write("plain", made(spark, 4))
    assert sorted(r["artifact"] for r in shelf.listing("plain").collect()) == ["a0", "a1", "a2", "a3"]
    assert shelf.read("plain", "a1")["rows"].count() == 3 and shelf.read("plain", "a1")["notes"].count() == 0
    with pytest.raises(ArtifactError):
        shelf.write("plain", made(spark, 1))
    with pytest.raises(ArtifactError):
        shelf.write("plain", {"rows": made(spark, 1)["rows"]})
    with pytest.raises(ArtifactError):
        shelf.read("plain", "nothing")
    # one byte in one artifact, a table of another emptied, and a folder that no manifest names
    spark.createDataFrame([(0, "v"), (1, "v"), (2, "w")], "k bigint, v string").write.mode("overwrite").parquet(f"{shelf.root}/plain/rows/artifact=a0")
    spark.createDataFrame([], "k bigint, v string").write.mode("overwrite").parquet(f"{shelf.root}/plain/rows/artifact=a2")
    spark.createDataFrame([(1, "v")], "k bigint, v string").write.parquet(f"{shelf.root}/plain/rows/artifact=stray")
    bad = {(r["artifact"], r["rule"]) for r in shelf.verify("plain").filter("not passed").collect()}
    assert bad == {("a0", "digest"), ("a2", "row_count"), ("a2", "digest"), ("stray", "published"), ("stray", "row_count"), ("stray", "digest")}
    assert sorted(r["artifact"] for r in shelf.listing("plain").collect()) == ["a1", "a3"]
    with pytest.raises(ArtifactError, match="digest"):
        shelf.read("plain", "a0")


def test_a_write_cut_short_is_written_again(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path), PLAIN)
    made(spark, 2, 5)["rows"].write.partitionBy("artifact").parquet(f"{shelf.root}/plain/rows")  # no manifest yet
    assert shelf.listing("plain").count() == 0
    shelf.write("plain", made(spark, 2))
    assert shelf.listing("plain").count() == 2 and shelf.table("plain", "rows").count() == 6


def test_jobs_do_not_follow_the_artifacts(spark, tmp_path):
    jobs = []
    for n in (3, 300):
        shelf = Shelf(spark, str(tmp_path / str(n)), PLAIN)
        shelf.write("plain", made(spark, n, 2))
        spark.sparkContext.setJobGroup(f"verify-{n}", "verify")
        assert shelf.listing("plain").count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"verify-{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2  # but for listing many folders


@pytest.fixture(params=["-1", "10m"])
def unmerged(spark, request):
    """Small partitions stay apart; small sides are broadcast or not."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": request.param}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def most_read(spark, group):
    """The most rows that a task of a job group got through shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker, most = context._jsc.sc().statusStore(), context.statusTracker(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000) if tracker.getStageInfo(stage) else None
        for k in range(tasks.size() if tasks else 0):
            metrics = tasks.apply(k).taskMetrics()
            most = max(most, metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return most


def test_no_task_of_a_write_or_listing_gets_most_rows(spark, tmp_path, unmerged):
    shelf = Shelf(spark, str(tmp_path / "shelf"), PLAIN)
    tables = made(spark, 1, 6000)
    tables["rows"].repartition(6).write.parquet(f"{tmp_path}/given")
    tables["rows"] = spark.read.parquet(f"{tmp_path}/given")
    read = {}
    for what, job in (("write", lambda: shelf.write("plain", tables)), ("list", lambda: shelf.listing("plain").collect())):
        spark.sparkContext.setJobGroup(f"{what}{unmerged}", what)
        job()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        read[what] = most_read(spark, f"{what}{unmerged}")
    assert all(100 < n < 3000 for n in read.values()), read


def test_a_write_digests_its_own_artifacts_only(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path), PLAIN)
    shelf.write("plain", made(spark, 2))
    first = {tuple(r) for r in shelf.manifest("plain").collect()}
    later = made(spark, 3, 700)
    shelf.write("plain", {name: rows.withColumn("artifact", F.concat(F.lit("b"), "artifact")) for name, rows in later.items()})
    stated = [tuple(r) for r in shelf.manifest("plain").collect()]
    assert first < set(stated) and len(stated) == len(set(stated)) == 10
    assert sorted(r["artifact"] for r in shelf.listing("plain").collect()) == ["a0", "a1", "ba0", "ba1", "ba2"]


def test_rules_of_an_evaluation(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path), KINDS)
    records = spark.createDataFrame([("a", "e1", "p", True), ("a", "e2", "p", False), ("b", "e1", "p", True), ("c", "e1", "p", True)], "artifact string, example_id string, predictor string, correct boolean")
    metrics = metrics_of(records)
    wrong = metrics.withColumn("correct", F.when(F.col("artifact") == "b", 0).otherwise(F.col("correct")).cast("bigint"))
    sources = spark.createDataFrame([("c", "dataset", "none", "x")], "artifact string, kind string, source string, digest string")
    shelf.write("evaluation", {"records": records, "metrics": wrong, "sources": sources})
    bad = {(r["artifact"], r["rule"], r["detail"]) for r in shelf.verify("evaluation").filter("not passed").collect()}
    assert bad == {("b", "metrics", "p"), ("c", "lineage", "unknown none")}


def ordered(spark, tmp_path, files, kind="bigint"):
    path = str(tmp_path / "rows")
    for k, keys in enumerate(files):
        spark.createDataFrame([(x,) for x in keys], f"k {kind}").coalesce(1).write.parquet(f"{path}/f{k:02}")
    return order.block_orders(spark, f"{path}/*", "k")


@pytest.mark.parametrize("files, unique, faults", [
    ([[1, 2, 3], [3, 4], [7]], False, []), ([[1, 2, 3], [3, 4], [7]], True, [("01", "out_of_place", "3 after 3")]), ([[1, 2, 2]], True, [("00", "repeated", "1")]),
    ([[1, 5, 4, 6], [7, 8]], False, [("00", "descent", "2")]), ([[1, 9], [2, 3], [10]], False, [("01", "out_of_place", "2 after 9")]), ([[1, None, 2], [None]], False, [("00", "null_key", "1"), ("01", "null_key", "1")]),
    ([[None, 5, None, 3]], False, [("00", "descent", "3"), ("00", "null_key", "2")]), ([[]], False, []), ([[1, 9], [5], [8]], False, [("01", "out_of_place", "5 after 9"), ("02", "out_of_place", "8 after 9")]),
])
def test_disorder_inside_and_across_files(spark, tmp_path, files, unique, faults):
    blocks = ordered(spark, tmp_path, files)
    got = sorted((r["file"].split("/f")[-1][:2], r["fault"], r["detail"]) for r in order.order_faults(blocks, unique).collect())
    assert got == faults


def test_order_of_text_over_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        keys = [f"k{i:04}" for i in range(100)]
        keys[50] = "k0000"
        row = ordered(spark, tmp_path, [keys], "string").first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (row["rows"], row["first"], row["last"], row["descents"], row["at"]) == (100, "k0000", "k0099", 1, 50)
