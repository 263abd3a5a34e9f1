"""Kinds of artifacts with the rules that their tables must keep, and queries over a shelf of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import collectors, versions
from ..functions.canonical import ratio
from ..functions.responses import parse_response
from ..operators import dataset, evaluate, order
from ..sources import folders, jsonl, store
from ..sources.shared import fresh_folder
from ..sources.shelf import SOURCES, SOURCES_SCHEMA, Kind, Shelf, differing
from .domain import EX, FAMILIES, POLICY, examples, records, table
from .registry import query


def misplaced(tables: dict[str, DataFrame]) -> DataFrame:
    """Examples whose partition, recomputed from kind and group, is another."""
    rows = tables["examples"]
    again = dataset.partition(F.col("kind"), F.col("group_id"), POLICY)
    return rows.filter(~F.col("partition").eqNullSafe(again)).select("artifact", F.col("example_id").alias("detail"))


def torn_groups(tables: dict[str, DataFrame]) -> DataFrame:
    """Groups that lie in more than one partition besides the abstentions."""
    rows = tables["examples"].filter(~F.col("kind").eqNullSafe(F.lit(dataset.ABSTENTION))).groupBy("artifact", "group_id").agg(F.min("partition").alias("low"), F.max("partition").alias("high"))
    return rows.filter("low <> high").select("artifact", F.col("group_id").alias("detail"))


def false_ids(tables: dict[str, DataFrame]) -> DataFrame:
    rows = tables["examples"]
    return rows.filter(~F.col("example_id").eqNullSafe(dataset.example_id(F.col("run_id")))).select("artifact", F.col("example_id").alias("detail"))


def repeated_examples(tables: dict[str, DataFrame]) -> DataFrame:
    rows = tables["examples"].groupBy("artifact", "example_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 1").select("artifact", F.col("example_id").alias("detail"))


def unaligned(tables: dict[str, DataFrame]) -> DataFrame:
    """Examples that one of the layers lacks or has twice."""
    f, l = (tables[name].select("artifact", "example_id") for name in ("features", "labels"))  # noqa: E741
    twice = f.unionByName(l).groupBy("artifact", "example_id").agg(F.count(F.lit(1)).alias("n")).filter("n <> 2").select("artifact", F.col("example_id").alias("detail"))
    return twice.unionByName(differing(f, l, F.col("example_id")))


def metrics_of(rows: DataFrame) -> DataFrame:
    """``artifact, predictor, evaluated, correct, accuracy`` from records."""
    some = rows.groupBy("artifact", "predictor").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("correct").alias("correct"))
    return some.withColumn("accuracy", ratio(F.col("correct"), F.col("evaluated")))


def stale_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Predictors whose stored metrics aren't what the records give."""
    columns = ["artifact", "predictor", "evaluated", "correct", "accuracy"]
    return differing(tables["metrics"].select(columns), metrics_of(tables["records"]).select(columns), F.col("predictor"))


KINDS = {
    "dataset": Kind({"examples": "example_id string, run_id string, group_id string, kind string, partition string"}, {"placement": misplaced, "cohesion": torn_groups, "example_ids": false_ids, "unique_examples": repeated_examples}),
    "prepared": Kind({"features": "example_id string, backend string", "labels": "example_id string, fault_family string", SOURCES: SOURCES_SCHEMA}, {"alignment": unaligned}),
    "evaluation": Kind({"records": "example_id string, predictor string, correct boolean", "metrics": "predictor string, evaluated bigint, correct bigint, accuracy string", SOURCES: SOURCES_SCHEMA}, {"metrics": stale_metrics}),
}


def shelf_of_sources(spark, d) -> Shelf:
    """A dataset, a prepared corpus and an evaluation for each source, with faults planted before and after publication."""
    shelf = Shelf(spark, fresh_folder(spark, "shelf"), KINDS)
    rows = examples(spark, d).withColumn("artifact", F.col("source"))
    moved = F.when((F.col("source") == "src3") & (F.col("kind") == dataset.ACCEPTED), F.when(F.col("partition") == "test", "train").otherwise("test")).otherwise(F.col("partition"))
    shelf.write("dataset", {"examples": rows.withColumn("partition", moved)})
    bound = shelf.bindings("dataset").withColumn("artifact", F.col("source"))
    bound = bound.withColumn("digest", F.when(F.col("source") == "src8", "else").otherwise(F.col("digest"))).withColumn("source", F.when(F.col("artifact") == "src9", "src99").otherwise(F.col("source")))
    lost = rows.filter("source = 'src4'").groupBy("artifact").agg(F.min("example_id").alias("example_id"))
    shelf.write("prepared", {"features": rows, "labels": rows.join(lost, ["artifact", "example_id"], "left_anti"), SOURCES: bound})
    scored = records(spark, d).withColumn("artifact", F.col("source"))
    wrong = F.when((F.col("artifact") == "src5") & (F.col("predictor") == "fixed_prior"), F.col("correct") + 1).otherwise(F.col("correct"))
    shelf.write("evaluation", {"records": scored, "metrics": metrics_of(scored).withColumn("correct", wrong), SOURCES: bound.filter("artifact not in ('src8', 'src9')")})
    # after publication: a file more in one artifact, and rows of an artifact that was never published
    some = shelf.table("dataset", "examples").filter("artifact = 'src7'").limit(1).drop("artifact")
    some.write.mode("append").parquet(f"{shelf.root}/dataset/examples/artifact=src7")
    some.write.mode("append").parquet(f"{shelf.root}/dataset/examples/artifact=loose")
    return shelf


_RULES = """(VALUES ('dataset', 'published'), ('dataset', 'row_count'), ('dataset', 'digest'), ('dataset', 'placement'), ('dataset', 'cohesion'), ('dataset', 'example_ids'), ('dataset', 'unique_examples'),
    ('prepared', 'published'), ('prepared', 'row_count'), ('prepared', 'digest'), ('prepared', 'alignment'), ('prepared', 'lineage'), ('evaluation', 'published'), ('evaluation', 'row_count'), ('evaluation', 'digest'), ('evaluation', 'metrics'), ('evaluation', 'lineage')) r(what, rule)"""
_SHELF = f"""{EX}, bad AS (
  SELECT DISTINCT 'dataset' AS what, source AS artifact, 'placement' AS rule FROM ex WHERE source = 'src3' AND kind = 'accepted_fault' UNION ALL
  SELECT 'dataset', source, 'unique_examples' FROM ex WHERE source = 'src7' GROUP BY 2 UNION ALL SELECT 'dataset', source, r FROM (SELECT DISTINCT source FROM ex WHERE source = 'src7'), (VALUES ('row_count'), ('digest')) t(r) UNION ALL
  SELECT DISTINCT 'prepared', source, 'alignment' FROM ex WHERE source = 'src4' UNION ALL SELECT DISTINCT 'prepared', source, 'lineage' FROM ex WHERE source IN ('src8', 'src9') UNION ALL
  SELECT DISTINCT 'evaluation', source, 'metrics' FROM ex WHERE source = 'src5'
), every AS (SELECT what, artifact, rule FROM (SELECT DISTINCT source AS artifact FROM ex), {_RULES} UNION ALL SELECT 'dataset', 'loose', r FROM (VALUES ('published'), ('row_count'), ('digest')) t(r)),
  checks AS (SELECT e.*, artifact <> 'loose' AND b.rule IS NULL AS passed FROM every e LEFT JOIN bad b USING (what, artifact, rule))"""


@query(f"WITH {_SHELF} SELECT what, artifact, rule, passed FROM checks")
def shelf_verification(spark, d):
    shelf = shelf_of_sources(spark, d)
    out = None
    for kind in KINDS:
        rows = shelf.verify(kind).groupBy("artifact", "rule").agg(F.bool_and("passed").alias("passed")).select(F.lit(kind).alias("what"), "artifact", "rule", "passed")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_SHELF} SELECT artifact FROM checks WHERE what = 'dataset' GROUP BY 1 HAVING bool_and(passed)")
def shelf_listing(spark, d):
    return shelf_of_sources(spark, d).listing("dataset")


_ORDERED = "SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN o_orderkey - 50 ELSE o_orderkey END AS k FROM orders"


@query(f"WITH o AS ({_ORDERED}), b AS (SELECT o_orderkey, k, lag(k) OVER (ORDER BY o_orderkey) AS before FROM o) SELECT count(*)::BIGINT AS \"rows\", max(k) AS high, count(*) FILTER (WHERE k < before) AS descents, 0::BIGINT AS misplaced FROM b")
def order_audit(spark, d):
    """Files of orders in order of key, with keys planted that break it: a row for each block is all that leaves a task."""
    path = fresh_folder(spark, "ordered")
    key = F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_orderkey") - 50).otherwise(F.col("o_orderkey"))
    table(spark, d, "orders").select("o_orderkey", key.alias("k")).repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").select("k").write.parquet(path)
    blocks = order.block_orders(spark, path, "k")
    misplaced_ = order.order_faults(blocks).filter("fault = 'out_of_place'").agg(F.count(F.lit(1)).alias("misplaced"))
    sums = blocks.agg(F.sum("rows").alias("rows"), F.max("last").alias("high"), F.sum("descents").alias("descents"))
    return sums.crossJoin(misplaced_)


def _run_folders(spark, d) -> str:
    """A folder for each source and language with its documents' lengths in JSON lines."""
    path = fresh_folder(spark, "runs")
    rows = table(spark, d, "documents").select(F.concat_ws("-", "source", F.coalesce("lang", F.lit("und"))).alias("run"), "doc_id", "n_chars")
    rows.repartition(4, "run").write.partitionBy("run").json(path)
    return path


@query("SELECT 'run=' || source || '-' || coalesce(lang, 'und') AS run_id, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(n_chars)::BIGINT AS chars, 0::BIGINT AS errors FROM documents GROUP BY 1")
def run_records(spark, d):
    """Run folders read record by record through the data source."""
    folders.register(spark)
    rows = spark.read.format("run_folders").load(_run_folders(spark, d)).filter("kind = 'text' or kind = 'json_lines' or kind = 'json'")
    value = F.from_json(F.coalesce("record", "text"), "doc_id bigint, n_chars bigint")
    rows = rows.filter("path not like '%.crc'").select("run_id", value.alias("v"), "error")
    return rows.groupBy("run_id").agg(F.count("v.doc_id").alias("n"), F.sum("v.doc_id").alias("ids"), F.sum("v.n_chars").alias("chars"), F.count("error").alias("errors"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND lang = 'en'")
def run_records_of_one(spark, d):
    """One run: the filter goes down to the source, which opens that folder only."""
    folders.register(spark)
    rows = spark.read.format("run_folders").load(_run_folders(spark, d)).filter("run_id = 'run=src3-en'").filter("path not like '%.crc'")
    return rows.select(F.from_json("record", "doc_id bigint, n_chars bigint").alias("v")).select("v.*")


_OUTPUT = """CASE WHEN user_id % 11 = 5 THEN '[' WHEN user_id % 5 = 0 THEN '{}' ELSE '{"ipv4Unicast":{"peers":{"10.0.0.' || user_id || '":{' || CASE WHEN user_id % 2 = 0 THEN '"state":"Established"' ELSE '"peerState":"IDLE"' END || ',"remoteAs":' || (65000 + n) || '}}}}' END"""


@query(f"""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, CASE WHEN user_id % 7 = 3 THEN 'status timeout' WHEN user_id % 11 = 5 THEN 'not JSON' END AS error FROM u)
  SELECT user_id, NULL AS metric, NULL AS value, error FROM k WHERE error IS NOT NULL UNION ALL
  SELECT user_id, 'bgp.peer.10.0.0.' || user_id || '.' || m, CASE m WHEN 'present' THEN 'true' WHEN 'remote_as' THEN (65000 + n)::VARCHAR ELSE CASE WHEN user_id % 2 = 0 THEN 'established' ELSE 'idle' END END, NULL
  FROM k, (VALUES ('present'), ('remote_as'), ('state')) t(m) WHERE error IS NULL AND user_id % 5 <> 0""")
def collected_metrics(spark, d):
    """Device output of every user, joined laterally to a collector; bad outputs are rows with an error."""
    collectors.register(spark)
    users = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    users = users.select("user_id", F.when(F.col("user_id") % 7 == 3, "timeout").otherwise("ok").alias("status"), F.expr(_OUTPUT).alias("stdout"))
    return spark.sql("SELECT o.user_id, m.metric, m.value, m.error FROM {outputs} o, LATERAL collect_bgp(o.status, o.stdout) m", outputs=users)


@query("SELECT 'f' || doc_id AS path, t AS tensor, 'F32' AS dtype, [doc_id % 5 + 1, n_chars]::BIGINT[] AS shape, ((doc_id % 5 + 1) * n_chars)::BIGINT AS parameters FROM documents, (VALUES ('bias'), ('weight')) v(t)")
def tensor_parameters(spark, d):
    """A file for each document whose header names two tensors; parameters are counted from headers alone."""
    shape = F.concat(F.lit('{"dtype":"F32","data_offsets":[0,8],"shape":['), F.col("doc_id") % 5 + 1, F.lit(","), F.col("n_chars"), F.lit("]}"))
    header = F.concat(F.lit('{"__metadata__":{"format":"x"},"weight":'), shape, F.lit(',"bias":'), shape, F.lit("}"))
    size = F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.octet_length(header)), 16, "0"), F.lit("(..)")))
    content = F.concat(F.unhex(F.array_join(size, "")), header.cast("binary"), F.unhex(F.lit("00" * 8)))
    rows = table(spark, d, "documents").select(F.concat(F.lit("f"), "doc_id").alias("path"), content.alias("content"))
    return jsonl.tensor_headers(rows)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def exactly_one_customer(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey", "c_name", "c_mktsegment")
    last = rows.agg(F.max("c_custkey").cast("string").alias("key")).first()["key"]
    return store.exactly_one(rows, "key", last).drop("key")


@query("SELECT 'customer' AS part, c_custkey AS key, c_mktsegment AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def artifact_read(spark, d):
    """Tables of an artifact, written, verified and read back."""
    home = store.ArtifactStore(spark, fresh_folder(spark, "artifacts"))
    home.write("trade", {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))})
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("part"), "key", "value") for name, rows in sorted(home.read("trade").items())))


@query("SELECT 'src' AS log, rule, count(*) AS files FROM (SELECT source, CASE WHEN source IN ('src1', 'src2') THEN ['no_final_line_feed'] WHEN source = 'src3' THEN ['blank_line'] ELSE [] END AS rules FROM (SELECT DISTINCT source FROM documents)), unnest(rules) AS u(rule) GROUP BY ALL")
def framing_of_exports(spark, d):
    """One export of JSON lines for each source; two lack their last line feed and one has a blank line."""
    line = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit("}"))
    rows = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # a small export is one file
    body = F.when(F.col("source") == "src3", F.array_join("lines", "\n\n")).otherwise(F.array_join("lines", "\n"))
    path, cut = fresh_folder(spark, "exports"), F.col("source").isin("src1", "src2")
    for end, some in (("\r", rows.filter(cut)), ("\n", rows.filter(~cut))):
        some.select("source", body.alias("value")).repartition(4, "source").write.mode("append").option("lineSep", end).partitionBy("source").text(path)
    found = jsonl.framing_findings(spark, f"{path}/*/*.txt")
    return found.groupBy(F.lit("src").alias("log"), "rule").agg(F.count(F.lit(1)).alias("files"))


def _by_length():
    """A user's backend: it answers from the columns that it may see, and fails on one of them."""

    def answer(rows):
        if "label" in rows.columns:
            raise ValueError("the answer is in the prompt")
        return ['{"prediction_type":"diagnosis","fault_family":"q1t0"}' if n >= 500 else '{"prediction_type":"abstention"}' for n in rows["n_chars"]]

    return answer


@query(f"""WITH {EX} SELECT example_id, CASE WHEN n_chars >= 500 THEN 'diagnosis' ELSE 'abstention' END AS outcome, CASE WHEN n_chars >= 500 THEN 'q1t0' END AS fault_family, NULL AS failure FROM ex
  UNION ALL SELECT example_id, 'invalid', NULL, 'backend_ValueError' FROM ex""")
def backend_predictions(spark, d):
    """Responses of a backend over all examples, parsed; and the same where it fails, which is a row for each example."""
    rows = examples(spark, d).select("example_id", "n_chars", F.col("fault_family").alias("label"))
    out = None
    for allowed in (("n_chars",), ("n_chars", "label")):
        said = evaluate.predict_with(rows, _by_length, allowed).withColumn("p", parse_response(F.col("response"), FAMILIES))
        some = said.select("example_id", F.when(F.col("failure").isNull(), F.col("p.outcome")).otherwise("invalid").alias("outcome"), F.when(F.col("failure").isNull(), F.col("p.fault_family")).alias("fault_family"), "failure")
        out = some if out is None else out.unionByName(some)
    return out


_LOG = "SELECT conv_id::VARCHAR AS stream, turn AS seq, role AS phase FROM conversations"


def _ended(spark, rows: DataFrame, name: str) -> DataFrame:
    """Run a stream to the end of what is there, into the shared folder, and read what it gave."""
    path = fresh_folder(spark, name)
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def _streamed(spark, d, name: str) -> DataFrame:
    """A table as a stream, whether it is a folder or one file among others."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    source = spark.readStream.schema(table(spark, d, name).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return source.parquet(f"{d}/{name}.parquet")
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _turns(spark, d) -> DataFrame:
    rows = _streamed(spark, d, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("seq"), F.col("role").alias("phase"), F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"), F.length("text").alias("size"))


@query(f"""WITH l AS ({_LOG}), b AS (SELECT *, coalesce(lag(phase) OVER (PARTITION BY stream ORDER BY seq), 'start') AS before FROM l)
  SELECT stream, seq, before, phase, 'illegal' AS fault FROM b WHERE before || '>' || phase NOT IN ('start>user', 'user>assistant', 'assistant>user')""")
def streamed_legality(spark, d):
    from ..streaming import state

    legal = {"start": ("user",), "user": ("assistant",), "assistant": ("user",)}
    return _ended(spark, state.illegal_transitions(_turns(spark, d).drop("size"), legal), "legality")


@query("""WITH l AS (SELECT conv_id, turn, length(text) > 300 AS ok FROM conversations), s AS (SELECT *, ok AND coalesce(lag(ok) OVER w, false) AS two FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id::VARCHAR AS stream, min(turn) AS seq FROM s WHERE two GROUP BY 1""")
def streamed_confirmations(spark, d):
    from ..streaming import state

    rows = _turns(spark, d).select("stream", "seq", (F.col("size") > 300).alias("ok"), "ts")
    return _ended(spark, state.confirmations(rows, 2), "confirmations")


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def published_events(spark, d):
    """Events published by a stream, replayed once, and read back: nothing is there twice."""
    from ..streaming.publish import PublishedTable

    root = fresh_folder(spark, "published")
    schema = table(spark, d, "events").schema
    published = PublishedTable(spark, f"{root}/table", schema)
    for run in ("first", "again"):
        published.writer(_streamed(spark, d, "events"), f"{root}/{run}").trigger(availableNow=True).start().awaitTermination()
    return published.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT o_orderkey, o_custkey % 3 || '.' || o_orderkey % 7 || CASE WHEN o_orderkey % 5 = 0 THEN 'rc1' WHEN o_orderkey % 5 = 1 THEN '.post2' ELSE '' END AS version,
  (o_custkey % 3 = 1 AND o_orderkey % 7 >= 2 OR o_custkey % 3 = 1 AND o_orderkey % 7 = 2) AND NOT (o_orderkey % 7 = 4) AND o_orderkey % 5 <> 0 AS fits FROM orders""")
def version_fits(spark, d):
    """Versions of all orders against one specifier set."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    version = F.concat((c % 3).cast("string"), F.lit("."), (k % 7).cast("string"), F.when(k % 5 == 0, "rc1").when(k % 5 == 1, ".post2").otherwise(""))
    rows = table(spark, d, "orders").select("o_orderkey", version.alias("version"))
    return versions.fitted(rows.withColumn("specifiers", F.lit(">=1.2,<2,!=1.4.*")), "version", "specifiers", "fits").drop("specifiers")
