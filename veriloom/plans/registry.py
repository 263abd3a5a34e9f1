"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, responses
from ..functions.canonical import ratio_sql
from ..operators import audit, compare, coverage, dataset, evaluate, eventlog, evidence, select
from ..sources import merkle, store
from .domain import EX, FAMILIES, POLICY, REC, examples, records, response, runs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


# --- identity and split


@query(f"WITH {EX} SELECT run_id, group_id FROM ex")
def group_ids(spark, d):
    return dataset.identified(runs(spark, d)).select("run_id", "group_id")


@query(f"WITH {EX} SELECT run_id, example_id FROM ex")
def example_ids(spark, d):
    return dataset.identified(runs(spark, d)).select("run_id", "example_id")


@query(f"WITH {EX} SELECT example_id, group_id, bucket, partition FROM ex")
def split_assignment(spark, d):
    rows = examples(spark, d)
    return rows.select("example_id", "group_id", dataset.bucket(F.col("group_id"), POLICY).alias("bucket"), "partition")


@query(f"WITH {EX} SELECT partition, kind, count(*) AS n FROM ex GROUP BY ALL")
def split_counts(spark, d):
    return examples(spark, d).groupBy("partition", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EX} SELECT run_id, 'accepted_fault' AS kind FROM ex WHERE kind = 'accepted_fault' AND doc_id % 7 <> 0 UNION ALL SELECT run_id, 'abstention' FROM ex WHERE kind = 'abstention' AND doc_id % 11 <> 0 AND doc_id % 121 NOT IN (5, 6)")
def projected_runs(spark, d):
    return dataset.project(_run_status(spark, d))[0].select("run_id", "kind")


@query(f"""WITH {EX} SELECT run_id, 'recovery_missing' AS rule FROM ex WHERE kind = 'accepted_fault' AND doc_id % 7 = 0 UNION ALL SELECT run_id, 'mutation_present' FROM ex WHERE kind = 'abstention' AND doc_id % 11 = 0
  UNION ALL SELECT run_id, CASE doc_id % 121 WHEN 5 THEN 'fault_present' ELSE 'phase_not_precondition' END FROM ex WHERE kind = 'abstention' AND doc_id % 121 IN (5, 6)""")
def projection_findings(spark, d):
    return dataset.project(_run_status(spark, d))[1]


def _run_status(spark, d):
    accepted = F.col("kind") == dataset.ACCEPTED
    phases = F.when(accepted, F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("baseline"), F.lit("onset"))).otherwise(F.array(F.lit("baseline"), F.lit("onset"), F.lit("recovery")))).otherwise(F.array(F.lit("baseline")))
    rows = runs(spark, d).withColumns({"status": F.when(accepted, "accepted").otherwise("rejected"), "ground_truth": F.col("fault_family"), "phases": phases})
    rows = rows.withColumns({"fault": F.when(~accepted & (F.col("doc_id") % 121 == 5), "f"), "failed_phase": F.when(~accepted & (F.col("doc_id") % 121 == 6), "onset").otherwise("precondition")})
    return rows.withColumn("mutations", F.when(~accepted & (F.col("doc_id") % 11 == 0), 1).otherwise(0)).drop("kind")


@query(f"WITH {EX} SELECT example_id, lang AS topology_hash, source AS backend, n_chars FROM ex WHERE partition = 'test'")
def model_facing_features(spark, d):
    layers = dataset.separate(examples(spark, d))
    test = layers["trace"].filter("partition = 'test'").select("example_id")
    return layers["features"].join(test, "example_id", "left_semi").select("example_id", "topology_hash", "backend", "n_chars")


@query(f"WITH {EX} SELECT 'complete' AS state, count(*) AS n FROM ex WHERE doc_id % 13 <> 0 UNION ALL SELECT 'features,trace', count(*) FROM ex WHERE doc_id % 13 = 0")
def layer_alignment(spark, d):
    rows = examples(spark, d)
    layers = dataset.separate(rows)
    kept = rows.filter("doc_id % 13 <> 0").select("example_id")
    layers["labels"] = layers["labels"].join(kept, "example_id", "left_semi")
    whole, incomplete = dataset.rejoin(layers)
    one = whole.agg(F.lit("complete").alias("state"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(incomplete.groupBy(F.array_join("layers", ",").alias("state")).agg(F.count(F.lit(1)).alias("n")))


# --- evaluation


@query(f"WITH {REC} SELECT predictor, example_id, outcome, said, reason, category, correct FROM rec")
def eval_records(spark, d):
    return records(spark, d).select("predictor", "example_id", F.col("prediction.outcome").alias("outcome"), F.col("prediction.fault_family").alias("said"), F.col("prediction.reason").alias("reason"), F.col("outcome_category").alias("category"), "correct")


@query(f"WITH {REC} SELECT predictor, count(*) AS n FROM rec WHERE false GROUP BY predictor")
def recategorized_differences(spark, d):
    rows = records(spark, d)
    return rows.filter(~evaluate.outcome_again(rows).eqNullSafe(F.col("outcome_category"))).groupBy("predictor").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REC} SELECT predictor, count(*) AS total, {count("kind = 'accepted_fault'")} AS accepted, {count("kind = 'abstention'")} AS abstention, {count("partition = 'train'")} AS train,
  {count("partition = 'validation'")} AS validation, {count("partition = 'test'")} AS test, {count("partition = 'abstention'")} AS abstention_partition FROM rec GROUP BY predictor""")
def corpus_counts(spark, d):
    return evaluate.corpus_counts(records(spark, d))


_ACCEPTED = f"""SELECT predictor, partition, count(*) AS evaluated, {count("category = 'correct_diagnosis'")} AS r, {count("category IN ('incorrect_diagnosis', 'invalid_prediction')")} AS incorrect, {count("category = 'abstained_on_diagnosis'")} AS abstained
  FROM rec WHERE kind = 'accepted_fault' GROUP BY predictor, partition"""


@query(f'WITH {REC}, m AS ({_ACCEPTED}) SELECT predictor, partition, evaluated, r AS "right", incorrect, abstained, {ratio_sql("r", "evaluated")} AS accuracy FROM m')
def accepted_metrics(spark, d):
    return evaluate.accepted_metrics(records(spark, d))


@query(f"""WITH {REC}, m AS (SELECT predictor, {count("kind = 'abstention'")} AS n, {count("category = 'correct_abstention'")} AS r, {count("category = 'false_diagnosis_on_rejected'")} AS false_diagnosis FROM rec GROUP BY predictor)
  SELECT predictor, n, r AS "right", false_diagnosis, {ratio_sql("r", "n")} AS accuracy FROM m""")
def abstention_metrics(spark, d):
    return evaluate.abstention_metrics(records(spark, d))


@query(f"""WITH {REC}, m AS (SELECT predictor, partition, count(*) AS n, {count("correct")} AS r FROM rec GROUP BY GROUPING SETS ((predictor, partition), (predictor)))
  SELECT predictor, partition, n, r AS "right", {ratio_sql("r", "n")} AS accuracy FROM m""")
def partition_summaries(spark, d):
    return evaluate.partition_summaries(records(spark, d))


@query(f"""WITH {REC} SELECT predictor, fault_family AS actual, CASE WHEN outcome = 'abstention' THEN '<abstain>' ELSE said END AS predicted, count(*) AS n
  FROM rec WHERE kind = 'accepted_fault' AND outcome <> 'invalid' GROUP BY ALL""")
def confusion(spark, d):
    return evaluate.confusion(records(spark, d))


_COMPARISON = f"""SELECT predictor, {count("kind = 'accepted_fault'")} AS accepted_evaluated, {count("category = 'correct_diagnosis'")} AS accepted_correct, {count("kind = 'abstention'")} AS abstention_count,
  {count("category = 'correct_abstention'")} AS abstention_correct, {count("category = 'invalid_prediction'")} AS invalid_count, count(*) AS evaluated FROM rec GROUP BY predictor"""
_COMPARED = f'SELECT *, {ratio_sql("accepted_correct", "accepted_evaluated")} AS accuracy, {ratio_sql("abstention_correct", "abstention_count")} AS abstention_accuracy FROM c'


@query(f"WITH {REC}, c AS ({_COMPARISON}) {_COMPARED}")
def benchmark_comparison(spark, d):
    return evaluate.comparison(records(spark, d))


@query(f"""WITH {REC}, c AS ({_COMPARISON}), k AS ({_COMPARED})
  SELECT row_number() OVER (ORDER BY coalesce(accuracy::DECIMAL(26,6), -1) DESC, coalesce(abstention_accuracy::DECIMAL(26,6), -1) DESC, invalid_count, predictor) AS place, predictor, accuracy, abstention_accuracy, invalid_count FROM k""")
def benchmark_ranking(spark, d):
    return evaluate.ranking(evaluate.comparison(records(spark, d)))


@query(f"WITH {REC}, c AS ({_COMPARISON}) SELECT predictor, 'stored' AS side FROM c WHERE predictor = 'fixed_prior' UNION ALL SELECT predictor, 'recomputed' FROM c WHERE predictor = 'fixed_prior'")
def audit_recomputation(spark, d):
    rows = records(spark, d)
    stored = evaluate.comparison(rows).withColumn("evaluated", F.when(F.col("predictor") == "fixed_prior", F.col("evaluated") + 1).otherwise(F.col("evaluated")))
    return evaluate.audit_metrics(stored, rows).select("predictor", "side")


@query(f"""WITH {REC}, k AS (SELECT CASE reason WHEN 'malformed_json' THEN CASE doc_id % 6 WHEN 2 THEN 'truncated_json' ELSE 'empty_output' END WHEN 'not_an_object' THEN 'non_object_json' WHEN 'unknown_fault_family' THEN 'out_of_schema_value' END AS category
  FROM rec WHERE predictor = 'responses' AND outcome = 'invalid') SELECT category, count(*) AS n FROM k GROUP BY category""")
def invalid_output_categories(spark, d):
    rows = records(spark, d).filter("predictor = 'responses' and prediction.outcome = 'invalid'")
    return rows.groupBy(responses.invalid_category(F.col("prediction.reason"), F.col("prediction.excerpt")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, doc_id % 6 NOT IN (2, 5) AS parsed, doc_id % 6 NOT IN (2, 3, 5) AS is_object, doc_id % 6 IN (0, 1, 4) AS type_valid, CASE doc_id % 6 WHEN 0 THEN true WHEN 4 THEN false END AS family_valid, doc_id % 6 IN (0, 1) AS compliant FROM documents""")
def response_schema(spark, d):
    return table(spark, d, "documents").select("doc_id", responses.response_schema(response(), FAMILIES).alias("s")).select("doc_id", "s.*")


@query(f"""WITH {REC}, m AS (SELECT predictor, count(*) AS n, {count("outcome = 'diagnosis'")} AS diagnoses, {count("outcome = 'abstention'")} AS abstentions, {count("outcome = 'invalid'")} AS invalid FROM rec GROUP BY predictor)
  SELECT *, {ratio_sql("n - invalid", "n")} AS valid_rate FROM m""")
def parser_stats(spark, d):
    return evaluate.parser_statistics(records(spark, d))


@query(f"""WITH {REC}, c AS (SELECT predictor, {count("kind = 'accepted_fault'")} AS accepted_evaluated, {count("category = 'correct_diagnosis'")} AS accepted_correct, {count("kind = 'abstention'")} AS abstention_count, {count("category = 'correct_abstention'")} AS abstention_correct,
  {count("category = 'invalid_prediction'")} AS invalid_count, {count("outcome = 'diagnosis'")} AS diagnoses, {count("outcome = 'abstention'")} AS abstentions, count(*) AS n FROM rec GROUP BY predictor)
  SELECT * EXCLUDE (n), {ratio_sql("accepted_correct", "accepted_evaluated")} AS exact_match_accuracy, {ratio_sql("abstention_correct", "abstention_count")} AS abstention_accuracy, {ratio_sql("n - invalid_count", "n")} AS valid_rate FROM c""")
def structured_output_report(spark, d):
    return evaluate.structured_output_report(records(spark, d))


# --- audits


def _planted(spark, d):
    """Examples with faults of each kind, by doc_id."""
    rows = examples(spark, d)
    id_ = F.col("doc_id")
    moved = F.when((F.col("kind") == dataset.ABSTENTION) & (id_ % 50 == 1), "train").when((F.col("kind") == dataset.ACCEPTED) & (id_ % 40 == 2), dataset.ABSTENTION).otherwise(F.col("partition"))
    rows = rows.withColumns({"partition": moved, "group_id": F.when(id_ % 90 == 3, "grp-0000000000000000").otherwise(F.col("group_id"))})
    return rows.unionByName(rows.filter(id_ % 100 == 5))


_BAD = f"""{EX}, one AS (SELECT doc_id, run_id, example_id, kind, CASE WHEN doc_id % 90 = 3 THEN 'grp-0000000000000000' ELSE group_id END AS group_id, group_id AS true_group,
  CASE WHEN kind = 'abstention' AND doc_id % 50 = 1 THEN 'train' WHEN kind = 'accepted_fault' AND doc_id % 40 = 2 THEN 'abstention' ELSE partition END AS partition FROM ex),
bad AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE doc_id % 100 = 5)"""
_LEAKS = f"""
spans AS (SELECT 'group_spans_partitions' AS code, 'error' AS severity, group_id, group_id AS subject, string_agg(DISTINCT partition, ',' ORDER BY partition) AS detail FROM bad GROUP BY group_id HAVING count(DISTINCT partition) > 1),
dups AS (SELECT 'duplicate_example' AS code, 'error' AS severity, NULL AS group_id, example_id AS subject, count(*)::VARCHAR AS detail FROM bad GROUP BY example_id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_run', 'error', NULL, run_id, count(*)::VARCHAR FROM bad GROUP BY run_id HAVING count(*) > 1),
idents AS (SELECT 'group_id_mismatch' AS code, 'error' AS severity, group_id, example_id AS subject, true_group AS detail FROM bad WHERE group_id <> true_group),
kinds AS (SELECT 'abstention_outside' AS code, 'error' AS severity, group_id, example_id AS subject, partition AS detail FROM bad WHERE kind = 'abstention' AND partition <> 'abstention'
  UNION ALL SELECT 'accepted_among_abstentions', 'error', group_id, example_id, partition FROM bad WHERE kind <> 'abstention' AND partition = 'abstention'
  UNION ALL SELECT 'accepted_not_trainable', 'error', group_id, example_id, partition FROM bad WHERE kind <> 'abstention' AND partition = 'abstention')"""


@query(f"WITH {_BAD},{_LEAKS} SELECT * FROM spans")
def leak_group_spans(spark, d):
    return audit.group_spans(_planted(spark, d))


@query(f"WITH {_BAD},{_LEAKS} SELECT * FROM dups")
def leak_duplicates(spark, d):
    rows = _planted(spark, d)
    return audit.duplicates(rows, "example_id", "duplicate_example").unionByName(audit.duplicates(rows, "run_id", "duplicate_run"))


@query(f"WITH {_BAD},{_LEAKS} SELECT * FROM idents")
def leak_identity_mismatch(spark, d):
    return audit.identity_mismatches(_planted(spark, d))


@query(f"WITH {_BAD},{_LEAKS} SELECT * FROM kinds")
def leak_kind_partition(spark, d):
    return audit.kind_partitions(_planted(spark, d))


@query(f"WITH {_BAD},{_LEAKS}, a AS (SELECT * FROM spans UNION ALL SELECT * FROM dups UNION ALL SELECT * FROM idents UNION ALL SELECT * FROM kinds) SELECT code, count(*) AS n FROM a GROUP BY code")
def leak_audit(spark, d):
    return audit.audit_leakage(_planted(spark, d)).filter("severity = 'error'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EX} SELECT 'parameter_siblings' AS code, count(*) AS families, sum(n)::BIGINT AS groups FROM (SELECT lang, source, count(DISTINCT group_id) AS n FROM ex GROUP BY ALL HAVING n > 1)""")
def siblings(spark, d):
    rows = audit.siblings(examples(spark, d))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("families"), F.sum(F.col("detail").cast("bigint")).alias("groups"))


@query(f"""WITH {EX}, g AS (SELECT DISTINCT group_id, lang, source FROM ex), k AS (SELECT lang, source, min(group_id) AS first FROM g GROUP BY ALL HAVING count(*) > 1) SELECT 'parameter_siblings' AS code, first, group_id FROM g JOIN k USING (lang, source)""")
def sibling_members(spark, d):
    return audit.sibling_members(examples(spark, d))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_lineitems(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""SELECT * FROM (SELECT doc_id, 'forbidden_key' AS rule, 'meta.partition' AS path FROM documents WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'forbidden_prefix', 'dataset_id' FROM documents WHERE doc_id % 19 = 0
  UNION ALL SELECT doc_id, 'forbidden_value', 'note' FROM documents WHERE doc_id % 23 = 0 UNION ALL SELECT doc_id, 'forbidden_key', 'a.b.c.d.e.f.group_id' FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id, 'forbidden_key', 'list[1][0].split' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'forbidden_value', 'list[0]' FROM documents WHERE doc_id % 11 = 0) WHERE doc_id % 29 <> 0 UNION ALL SELECT doc_id, 'unreadable', '' FROM documents WHERE doc_id % 29 = 0""")
def feature_payload_audit(spark, d):
    id_ = F.col("doc_id")
    part = lambda n, *text: F.when(id_ % n == 0, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in text))).otherwise("")
    payload = F.concat(
        F.lit('{"n":'), "n_chars", part(17, ',"meta":{"partition":1}'), part(19, ',"dataset_id":2'), part(23, ',"note":"run-', id_, '"'), part(13, ',"a":{"b":{"c":{"d":{"e":{"f":{"group_id":null}}}}}}'),
        part(11, ',"list":["run-', id_, '",[{"split":{}}]]'), F.when(id_ % 29 == 0, ",").otherwise("}"),
    )
    payload = F.when(id_ % 29 == 0, '{"n":1,').otherwise(payload)
    rows = table(spark, d, "documents").select("doc_id", payload.alias("payload"), F.array(F.concat(F.lit("run-"), id_)).alias("sensitive"))
    return audit.feature_payload_findings(rows, "doc_id", "payload", "sensitive")


@query(f"WITH {EX} SELECT t.example_id, t.example_id AS token FROM ex t WHERE t.partition <> 'train' AND t.doc_id % 3 = 0")
def heldout_id_firewall(spark, d):
    rows = examples(spark, d)
    held = rows.filter("partition <> 'train'").select(F.col("example_id").alias("token"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see "), "example_id", F.when(F.col("doc_id") % 2 == 0, "fx_7!").otherwise("-"))).otherwise("nothing")
    return audit.firewall(rows.withColumn("payload", text), "example_id", "payload", held, "token")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def heldout_firewall(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("text", "passage")
    return audit.passages_inside(docs.select("doc_id", "text"), "doc_id", "text", items, "item_id", "passage")


@query("""SELECT 'nation' AS child, count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'nation_even', count(*) FROM supplier WHERE s_nationkey % 2 = 1""")
def orphan_references(spark, d):
    t = lambda n: table(spark, d, n)
    parts = [
        ("nation", t("nation"), "n_regionkey", t("region"), "r_regionkey"), ("supplier", t("supplier"), "s_nationkey", t("nation"), "n_nationkey"), ("customer", t("customer"), "c_nationkey", t("nation"), "n_nationkey"),
        ("orders", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("nation_even", t("supplier"), "s_nationkey", t("nation").filter("n_nationkey % 2 = 0"), "n_nationkey"),
    ]
    out = None
    for name, rows, key, target, target_key in parts:
        one = audit.missing_references(rows.select(key), key, target, target_key).agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# --- pairs and versions


_PAIR = f"""{REC}, b AS (SELECT * FROM rec WHERE predictor = 'length_rule'), t AS (SELECT * FROM rec WHERE predictor = 'responses'),
pairs AS (SELECT b.example_id, b.partition, b.fault_family, b.kind, b.correct AS bc, t.correct AS tc, b.outcome AS bo, t.outcome AS t_o, b.outcome = t.outcome AND b.said IS NOT DISTINCT FROM t.said AND b.reason IS NOT DISTINCT FROM t.reason AS identical
  FROM b JOIN t USING (example_id)),
tr AS (SELECT *, CASE WHEN bc AND tc THEN 'unchanged_correct' WHEN bc THEN 'regressed' WHEN tc THEN 'improved' WHEN identical THEN 'unchanged_incorrect' ELSE 'changed_still_incorrect' END AS transition, (bo = 'abstention') <> (t_o = 'abstention') AS abstention_changed FROM pairs)"""
_COUNTS = f"""count(*) AS total, {count("transition = 'unchanged_correct'")} AS both_correct, {count("transition IN ('unchanged_incorrect', 'changed_still_incorrect')")} AS both_incorrect, {count("transition = 'regressed'")} AS regressed,
  {count("transition = 'improved'")} AS improved, {count("identical")} AS identical, {count("NOT identical")} AS differed, {count("bo = 'invalid'")} AS base_invalid, {count("t_o = 'invalid'")} AS trained_invalid, {count("abstention_changed")} AS abstention_changed"""


def _pairs(spark, d):
    rows = records(spark, d)
    return compare.paired(rows.filter("predictor = 'length_rule'"), rows.filter("predictor = 'responses'"))[0]


@query(f"WITH {_PAIR} SELECT example_id, transition, identical, abstention_changed FROM tr")
def paired_transitions(spark, d):
    return compare.transitions(_pairs(spark, d), whole=False).select("example_id", "transition", "identical", "abstention_changed")


@query(f"WITH {_PAIR} SELECT {_COUNTS} FROM tr WHERE partition <> 'train'")
def paired_counts(spark, d):
    return compare.paired_counts(compare.transitions(_pairs(spark, d), whole=False).filter("partition <> 'train'"))


@query(f"WITH {_PAIR} SELECT coalesce(fault_family, 'none') AS family, {_COUNTS} FROM tr GROUP BY 1")
def paired_counts_by_family(spark, d):
    rows = compare.transitions(_pairs(spark, d), whole=False).withColumn("family", F.coalesce("fault_family", F.lit("none")))
    return compare.paired_counts(rows, ["family"])


@query(f"WITH {_PAIR} SELECT example_id, partition, transition FROM tr WHERE NOT identical")
def disagreements(spark, d):
    return compare.transitions(_pairs(spark, d), whole=False).filter("not identical").select("example_id", "partition", "transition")


@query(f"WITH {EX} SELECT example_id, CASE WHEN doc_id % 10 = 0 THEN 'only_trained' ELSE 'only_base' END AS problem FROM ex WHERE (doc_id % 10 = 0) <> (doc_id % 12 = 0)")
def alignment_faults(spark, d):
    rows = records(spark, d).filter("predictor = 'fixed_prior'")
    return compare.paired(rows.filter("doc_id % 10 <> 0"), rows.filter("doc_id % 12 <> 0"))[1]


@query(f"""WITH {_PAIR}, c AS (SELECT {_COUNTS}, {count("partition = 'test'")} AS eligible_test FROM tr WHERE partition <> 'train') SELECT improved, regressed, differed, CASE WHEN differed = 0 THEN 'no_observed_effect' WHEN eligible_test < 5 OR differed < 3 THEN 'inconclusive_underpowered'
  WHEN improved > 0 AND regressed = 0 THEN 'better' WHEN regressed > 0 AND improved = 0 THEN 'worse' WHEN improved > 0 AND regressed > 0 THEN 'mixed' ELSE 'unchanged' END AS conclusion FROM c""")
def interpretation(spark, d):
    rows = compare.transitions(_pairs(spark, d), whole=False).filter("partition <> 'train'")
    rows = rows.withColumn("all", F.lit(1))
    counts = compare.paired_counts(rows, ["all"]).join(rows.groupBy("all").agg(F.count_if(F.col("partition") == "test").alias("eligible_test")), "all")
    return compare.interpretation(counts, F.lit(True), 5, 3, F.lit(False)).select("improved", "regressed", "differed", "conclusion")


_METRICS = f"""SELECT {count("partition = 'test' AND kind = 'accepted_fault'")} AS test_evaluated, {count("partition = 'test' AND bc")} AS base_correct, {count("partition = 'test' AND tc")} AS trained_correct, {count("partition = 'test' AND NOT bc AND tc")} AS wins,
  {count("partition = 'test' AND bc AND NOT tc")} AS losses, {count("bo = 'invalid'")} AS base_invalid, {count("t_o = 'invalid'")} AS trained_invalid, {count("kind = 'abstention'")} AS abstentions, {count("kind = 'abstention' AND bc")} AS base_abstained,
  {count("kind = 'abstention' AND tc")} AS trained_abstained FROM tr"""


@query(f"""WITH {_PAIR}, m AS ({_METRICS}), f AS (SELECT *, trained_correct > base_correct AS up, trained_correct < base_correct AS down, trained_invalid > base_invalid AS iu, trained_invalid < base_invalid AS idn, trained_abstained > base_abstained AS au,
  trained_abstained < base_abstained AS ad, wins > losses AS w, wins < losses AS l FROM m) SELECT test_evaluated, base_correct, trained_correct, wins, losses, CASE WHEN test_evaluated < 1 THEN 'inconclusive' WHEN up AND w AND NOT iu AND NOT ad THEN 'improved'
  WHEN (down OR iu OR ad OR l) AND (up OR idn OR au OR w) THEN 'mixed' WHEN down OR iu OR ad OR l THEN 'regressed' WHEN up OR idn OR au OR w THEN 'mixed' ELSE 'unchanged' END AS verdict FROM f""")
def experiment_outcome(spark, d):
    rows = records(spark, d)
    metrics = compare.primary_metrics(rows.filter("predictor = 'length_rule'"), rows.filter("predictor = 'responses'"))
    return compare.experiment_outcome(metrics, F.lit(True), 1, 0).select("test_evaluated", "base_correct", "trained_correct", "wins", "losses", "verdict")


_CONFIG = "SELECT count(DISTINCT o_orderpriority)::VARCHAR AS priorities, count(*)::VARCHAR AS orders, max(o_orderstatus) AS status FROM orders"


@query(f"""WITH b AS ({_CONFIG} WHERE o_orderkey % 2 = 0), t AS ({_CONFIG} WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'P'), l AS (UNPIVOT b ON priorities, orders, status INTO NAME field VALUE base), r AS (UNPIVOT t ON priorities, orders, status INTO NAME field VALUE trained)
  SELECT field, base, trained, base IS NOT DISTINCT FROM trained AS equal FROM l JOIN r USING (field)""")
def fairness_fields(spark, d):
    """Two halves of the orders as configurations that ought to agree, field by field."""
    one = lambda rows: rows.agg(F.countDistinct("o_orderpriority").alias("priorities"), F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("status"))
    rows = table(spark, d, "orders")
    return compare.fairness(one(rows.filter("o_orderkey % 2 = 0")), one(rows.filter("o_orderkey % 2 = 1 and o_orderstatus <> 'P'")), ["priorities", "orders", "status"])


@query(f"""WITH {EX} SELECT {count("doc_id % 10 <> 0 AND doc_id % 97 <> 0")} AS unchanged, {count("doc_id % 10 <> 0 AND doc_id % 97 = 0")} AS modified, 0::BIGINT AS removed, {count("doc_id % 10 = 0")} AS added, 0::BIGINT AS repartitioned,
  {count("doc_id % 10 <> 0 AND doc_id % 97 = 0 AND partition <> 'train'")} AS held_out_modified FROM ex""")
def append_only_diff(spark, d):
    new = examples(spark, d)
    old = new.filter("doc_id % 10 <> 0")
    new = new.withColumn("n_chars", F.when(F.col("doc_id") % 97 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return compare.version_diff(old, new, "example_id", ["backend", "fault_family", "n_chars", "topology_hash"], "partition")


@query(f"""WITH {EX}, o AS (SELECT fault_family AS metric, count(*) AS n FROM ex WHERE kind = 'accepted_fault' AND doc_id % 10 <> 0 GROUP BY 1), v AS (SELECT fault_family AS metric, count(*) AS n FROM ex WHERE kind = 'accepted_fault' GROUP BY 1)
  SELECT metric, coalesce(o.n, 0) AS before, coalesce(v.n, 0) AS after, coalesce(v.n, 0) - coalesce(o.n, 0) AS delta FROM o FULL JOIN v USING (metric)""")
def version_deltas(spark, d):
    rows = examples(spark, d).filter("kind = 'accepted_fault'")
    families = lambda x: x.groupBy(F.col("fault_family").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return compare.metric_deltas(families(rows.filter("doc_id % 10 <> 0")), families(rows))


@query("SELECT text, 'left' AS side FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT text FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT text, 'right' FROM (SELECT text FROM documents WHERE doc_id % 3 = 0 EXCEPT ALL SELECT text FROM documents WHERE doc_id % 2 = 0)")
def symmetric_difference(spark, d):
    rows = table(spark, d, "documents")
    return compare.symmetric_difference(rows.filter("doc_id % 2 = 0").select("text"), rows.filter("doc_id % 3 = 0").select("text"))


# --- coverage


@query(f"""WITH {EX} SELECT 'fault_family' AS dimension, fault_family AS key, count(*) AS n FROM ex WHERE fault_family IS NOT NULL GROUP BY 2 UNION ALL SELECT 'scenario_id', source, count(*) FROM ex GROUP BY 2
  UNION ALL SELECT 'topology_hash', lang, count(*) FROM ex GROUP BY 2 UNION ALL SELECT 'partition', partition, count(*) FROM ex GROUP BY 2""")
def coverage_distributions(spark, d):
    return coverage.distributions(examples(spark, d), ["fault_family", "scenario_id", "topology_hash", "partition"])


@query(f"""WITH {EX}, n AS (SELECT 'fault_family' AS dimension, fault_family AS key, count(*) AS n FROM ex WHERE fault_family IS NOT NULL GROUP BY 2 UNION ALL SELECT 'topology_hash', lang, count(*) FROM ex GROUP BY 2),
  m AS (SELECT dimension, count(*) AS classes, max(n) AS largest, min(n) AS smallest FROM n GROUP BY 1) SELECT *, CASE WHEN classes >= 2 THEN {ratio_sql("largest", "smallest")} END AS imbalance FROM m""")
def class_imbalance(spark, d):
    return coverage.imbalance(coverage.distributions(examples(spark, d), ["fault_family", "topology_hash"]))


@query("SELECT sha256('{\"text\":' || to_json(text) || '}') AS content_sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content_groups(spark, d):
    return coverage.duplicate_content(table(spark, d, "documents"), ["text"])


@query(f"""WITH {EX} SELECT fault_family, string_agg(DISTINCT source, ',' ORDER BY source) AS scenario_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS topology_hash, {count("partition = 'train'")} AS train, {count("partition = 'validation'")} AS validation,
  {count("partition = 'test'")} AS test FROM ex WHERE fault_family IS NOT NULL GROUP BY 1""")
def coverage_matrix(spark, d):
    return coverage.coverage_matrix(examples(spark, d).filter("fault_family is not null"), "fault_family", ["scenario_id", "topology_hash"])


@query(f"WITH {EX} SELECT partition, count(DISTINCT group_id) AS groups, count(*) AS n FROM ex GROUP BY 1")
def identity_coverage(spark, d):
    return coverage.identity_coverage(examples(spark, d))


_FIRST = "coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT {0} AS x FROM {1} ORDER BY 1 LIMIT 5)), '')"


@query(f"""WITH {_BAD}, rep AS (SELECT example_id FROM bad GROUP BY 1 HAVING count(*) > 1), leak AS (SELECT group_id FROM bad GROUP BY 1 HAVING count(DISTINCT partition) > 1), mal AS (SELECT example_id FROM bad WHERE (kind = 'accepted_fault') = (partition = 'abstention'))
  SELECT rule, detail = '' AS passed, detail FROM (SELECT 'unique_example_ids' AS rule, {_FIRST.format('example_id', 'rep')} AS detail UNION ALL SELECT 'no_split_leakage', {_FIRST.format('group_id', 'leak')}
  UNION ALL SELECT 'no_malformed_examples', {_FIRST.format('example_id', 'mal')} UNION ALL SELECT 'no_missing_evidence', '' UNION ALL SELECT 'uniform_policy', '' UNION ALL SELECT 'uniform_label_policy', 'lab-1')""")
def quality_checks(spark, d):
    rows = _planted(spark, d)
    return coverage.quality_checks(rows.withColumn("label_policy_id", F.when(F.col("doc_id") % 10 == 7, "lab-2").otherwise(F.col("label_policy_id"))))


_TARGETS = [("accepted", 100, True), ("test", 40, True), ("test_groups", 30, False), ("families", 4, True), ("topologies", 5, False)]
_ASSESS = f"""{EX}, m AS (SELECT * FROM (SELECT {count("kind = 'accepted_fault'")} AS accepted, {count("partition = 'test'")} AS test, count(DISTINCT CASE WHEN partition = 'test' THEN group_id END) AS test_groups, count(DISTINCT fault_family) AS families, count(DISTINCT lang) AS topologies FROM ex)
  UNPIVOT (value FOR metric IN (accepted, test, test_groups, families, topologies))), g AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {b}::BIGINT, {str(c).lower()})" for a, b, c in _TARGETS)}) t(metric, least, mandatory)),
a AS (SELECT g.*, coalesce(value, 0) AS value, coalesce(value, 0) >= least AS passed FROM g LEFT JOIN m USING (metric))"""


def _assessed(spark, d):
    rows = examples(spark, d).agg(
        F.count_if(F.col("kind") == dataset.ACCEPTED).alias("accepted"), F.count_if(F.col("partition") == "test").alias("test"), F.countDistinct(F.when(F.col("partition") == "test", F.col("group_id"))).alias("test_groups"),
        F.countDistinct("fault_family").alias("families"), F.countDistinct("topology_hash").alias("topologies"),
    )
    targets = spark.createDataFrame(_TARGETS, "metric string, least bigint, mandatory boolean")
    return coverage.long(rows, [t[0] for t in _TARGETS]), targets


@query(f"WITH {_ASSESS} SELECT metric, value, least, mandatory, passed FROM a")
def target_assessment(spark, d):
    return coverage.assess(*_assessed(spark, d))


@query(f"WITH {_ASSESS} SELECT metric, value, least, mandatory, passed, least - value AS missing FROM a WHERE value < least")
def expansion_deficits(spark, d):
    return coverage.deficits(*_assessed(spark, d))


@query(f"WITH {_ASSESS} SELECT CASE WHEN NOT bool_and(passed OR NOT mandatory) THEN 'not_ready' WHEN NOT bool_and(passed) THEN 'ready_with_advisories' ELSE 'ready' END AS outcome, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE NOT passed), '') AS unmet FROM a")
def readiness(spark, d):
    return coverage.readiness(coverage.assess(*_assessed(spark, d)))


# --- selection


_TRAIN = f"{EX}, tr AS (SELECT * FROM ex WHERE partition = 'train')"


@query(f"""WITH {_TRAIN}, s AS (SELECT example_id, fault_family, row_number() OVER (PARTITION BY fault_family ORDER BY group_id, example_id) AS round FROM tr)
  SELECT example_id, fault_family, round, row_number() OVER (ORDER BY round, fault_family) AS position FROM s WHERE round <= 8""")
def family_balanced_selection(spark, d):
    rows = select.first_per_family(dataset.eligible_for_training(examples(spark, d)), 8)
    return rows.select("example_id", "fault_family", "round", "position")


@query(f"""WITH {_TRAIN}, s AS (SELECT example_id, fault_family, group_id, row_number() OVER (PARTITION BY fault_family, group_id ORDER BY example_id) AS round FROM tr),
  p AS (SELECT *, row_number() OVER (PARTITION BY fault_family ORDER BY round, group_id) AS pick FROM s) SELECT example_id, fault_family, group_id, round, pick FROM p WHERE pick <= 16""")
def group_balanced_selection(spark, d):
    rows = select.group_round_robin(dataset.eligible_for_training(examples(spark, d)), 16)
    return rows.select("example_id", "fault_family", "group_id", "round", "pick")


@query(f"""WITH {_TRAIN}, s AS (SELECT *, row_number() OVER (PARTITION BY fault_family, group_id ORDER BY example_id) AS round FROM tr), p AS (SELECT *, row_number() OVER (PARTITION BY fault_family ORDER BY round, group_id) AS pick FROM s)
  SELECT fault_family, count(*) AS n, count(DISTINCT group_id) AS groups FROM p WHERE pick <= 16 GROUP BY 1 HAVING count(*) < 16 OR count(DISTINCT group_id) < 12""")
def selection_shortfalls(spark, d):
    return select.shortfalls(select.group_round_robin(dataset.eligible_for_training(examples(spark, d)), 16), 16, 12)


@query(f"WITH {_TRAIN} SELECT example_id FROM tr ORDER BY example_id LIMIT 20")
def first_n_cap(spark, d):
    return select.first_n(dataset.eligible_for_training(examples(spark, d)), "example_id", 20).select("example_id")


_POOL = f"""{EX}, pool AS (SELECT group_id, min(fault_family) AS fault_family, min(lang) AS topology_hash, min(source) AS case_id, min(partition) AS partition FROM ex WHERE kind = 'accepted_fault' GROUP BY group_id)"""


def _pool(spark, d):
    return examples(spark, d).filter("kind = 'accepted_fault'").groupBy("group_id").agg(F.min("fault_family").alias("fault_family"), F.min("topology_hash").alias("topology_hash"), F.min("scenario_id").alias("case_id"), F.min("partition").alias("partition"))


@query(f"WITH {_POOL} SELECT group_id, partition FROM pool WHERE partition = 'train' AND case_id NOT IN ('src0', 'src1', 'src2') ORDER BY group_id LIMIT 10")
def anti_frozen_candidates(spark, d):
    pool = _pool(spark, d)
    return select.unused_candidates(pool, pool.filter(F.col("case_id").isin("src0", "src1", "src2")), 10).select("group_id", "partition")


@query(f"""WITH {_POOL}, r AS (SELECT *, CASE partition WHEN 'test' THEN 3 WHEN 'validation' THEN 3 ELSE 2 END AS runs, CASE partition WHEN 'test' THEN 1 WHEN 'validation' THEN 2 END AS r1 FROM pool),
b AS (SELECT *, coalesce(sum(CASE WHEN r1 IS NOT NULL THEN runs END) OVER (PARTITION BY fault_family), 0) AS base FROM r), m AS (SELECT *, max(base) OVER () AS most, base + coalesce(sum(runs) OVER (PARTITION BY fault_family, r1 IS NULL ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS projected FROM b),
c AS (SELECT *, coalesce(r1, CASE WHEN projected < most THEN 3 END) AS r3 FROM m), t AS (SELECT *, coalesce(r3, CASE WHEN NOT max(r3 IS NOT NULL) OVER (PARTITION BY topology_hash) AND row_number() OVER (PARTITION BY topology_hash, r3 IS NULL ORDER BY group_id) = 1 THEN 4 END) AS r4 FROM c),
k AS (SELECT *, coalesce(r4, CASE WHEN NOT max(r4 IS NOT NULL) OVER (PARTITION BY case_id) AND row_number() OVER (PARTITION BY case_id, r4 IS NULL ORDER BY group_id) = 1 THEN 5 END) AS rule FROM t)
SELECT group_id, fault_family, topology_hash, case_id, partition, runs, rule FROM k WHERE rule IS NOT NULL""")
def identity_first_plan(spark, d):
    return select.identity_first(_pool(spark, d), {"test": 3, "validation": 3, "train": 2})


@query(f"WITH {_POOL} SELECT partition, sum(CASE partition WHEN 'test' THEN 3 WHEN 'validation' THEN 3 ELSE 2 END)::BIGINT AS planned_runs, count(*) AS groups FROM pool GROUP BY 1")
def predicted_split_totals(spark, d):
    runs_ = F.when(F.col("partition").isin("test", "validation"), 3).otherwise(2)
    return _pool(spark, d).groupBy("partition").agg(F.sum(runs_).alias("planned_runs"), F.count(F.lit(1)).alias("groups"))


@query("SELECT n, (n + 3) // 4 AS batches, ((n + 3) // 4 + 1) // 2 AS steps_per_epoch, ((n + 3) // 4 + 1) // 2 * 3 AS total_steps FROM (SELECT DISTINCT n_chars AS n FROM documents)")
def plan_counts(spark, d):
    n = F.col("n")
    return table(spark, d, "documents").select(F.col("n_chars").alias("n")).distinct().withColumns(select.plan_counts(n, F.lit(4), F.lit(2), F.lit(3)))


# --- evidence


_PHASED = "ev AS (SELECT user_id, event_type, value, CASE WHEN day(ts) <= 10 THEN 'baseline' WHEN day(ts) <= 20 THEN 'onset' ELSE 'recovery' END AS phase, props FROM events)"
_CHECKS = [
    ("views_positive", "view", "greater_than", ["0"]), ("errors_small", "error", "less_than", ["50"]), ("purchase_any", "purchase", "any", []), ("signup_none", "signup", "equals", []),
    ("absent", "nothing", "equals", ["1"]), ("odd_limit", "click", "less_than", ["many"]), ("not_minus", "click", "not_equals", ["-1"]), ("click_is_one", "click", "equals", ["1"]), ("click_is_none", "click", "equals", ["-5"]),
    ("view_in", "view", "in_set", [str(k) for k in range(1000)]), ("view_in_few", "view", "in_set", ["1", "2"]), ("error_out", "error", "not_in_set", ["-1", "-2"]), ("error_out_of", "error", "not_in_set", ["3", "4", "5"]), ("only_foreign", "foreign", "any", []),
]
_CHECK_VALUES = ", ".join(f"('{a}', '{b}', '{c}', [{', '.join(repr(x) for x in e)}]::VARCHAR[])" for a, b, c, e in _CHECKS)


@query(f"""WITH v AS (SELECT event_type AS metric, floor(value)::BIGINT::VARCHAR AS value, user_id % 5 <> 0 AS trusted FROM events UNION ALL SELECT 'foreign', '1', false FROM events WHERE user_id = 1),
  c AS (SELECT * FROM (VALUES {_CHECK_VALUES}) t(check_id, metric, predicate, expected)),
  j AS (SELECT c.*, v.value, v.trusted, CASE predicate WHEN 'equals' THEN v.value = expected[1] WHEN 'not_equals' THEN v.value <> expected[1] WHEN 'in_set' THEN list_contains(expected, v.value) WHEN 'not_in_set' THEN NOT list_contains(expected, v.value)
    WHEN 'greater_than' THEN try_cast(v.value AS DOUBLE) > try_cast(expected[1] AS DOUBLE) WHEN 'less_than' THEN try_cast(v.value AS DOUBLE) < try_cast(expected[1] AS DOUBLE) END AS holds,
    predicate IN ('greater_than', 'less_than') AND (try_cast(v.value AS DOUBLE) IS NULL OR try_cast(expected[1] AS DOUBLE) IS NULL) AS broken FROM c LEFT JOIN v USING (metric)),
  s AS (SELECT check_id, predicate, any_value(len(expected)) AS wanted, {count("trusted")} AS observed, {count("NOT trusted")} AS ignored, bool_and(holds) FILTER (WHERE trusted) AS every, bool_or(holds) FILTER (WHERE trusted) AS one_holds, coalesce(bool_or(broken) FILTER (WHERE trusted), false) AS broken FROM j GROUP BY check_id, predicate),
  w AS (SELECT *, CASE WHEN observed = 0 THEN 'insufficient' WHEN predicate = 'any' THEN 'pass' WHEN wanted = 0 OR broken THEN 'unknown' WHEN every THEN 'pass' ELSE 'fail' END AS verdict FROM s)
  SELECT check_id, verdict, CASE WHEN verdict = 'insufficient' AND ignored > 0 THEN 'only_untrusted_observed' WHEN verdict = 'insufficient' THEN 'nothing_observed' WHEN verdict = 'unknown' AND wanted = 0 THEN 'nothing_expected' WHEN verdict = 'unknown' THEN 'not_a_number'
    WHEN verdict = 'fail' AND predicate = 'equals' AND one_holds THEN 'contradictory' END AS detail, observed, ignored FROM w""")
def claim_verdicts(spark, d):
    checks = spark.createDataFrame([(a, b, c, e, True) for a, b, c, e in _CHECKS], "check_id string, metric string, predicate string, expected array<string>, trusted_only boolean")
    events = table(spark, d, "events")
    seen = events.select(F.col("event_type").alias("metric"), F.floor("value").cast("string").alias("value"), (F.col("user_id") % 5 != 0).alias("trusted"))
    foreign = events.filter("user_id = 1").select(F.lit("foreign").alias("metric"), F.lit("1").alias("value"), F.lit(False).alias("trusted"))
    return evidence.verify_claims(checks, seen.unionByName(foreign))


@query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'idle' WHEN 'click' THEN 'active' WHEN 'view' THEN 'established' ELSE 'other' END AS s, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 6 ELSE 5 END AS r FROM events)
  SELECT user_id, min_by(s, r) AS worst FROM s GROUP BY 1""")
def worst_state(spark, d):
    state = F.when(F.col("event_type") == "error", " Idle").when(F.col("event_type") == "click", "ACTIVE").when(F.col("event_type") == "view", "established").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(evidence.worst_state(state).alias("worst"))


@query(f"""WITH {_PHASED}, u AS (SELECT user_id, event_type, max(CASE WHEN phase = 'baseline' THEN floor(value)::BIGINT END) AS b, max(CASE WHEN phase = 'onset' THEN floor(value)::BIGINT END) AS o FROM ev GROUP BY 1, 2),
  h AS (SELECT user_id, bool_or(phase = 'onset') AS has FROM ev WHERE phase <> 'recovery' GROUP BY 1)
  SELECT user_id::VARCHAR AS run_id, coalesce(bool_or(event_type = 'click' AND b IS NOT NULL AND o IS NOT NULL AND b <> o), false) AS remote_as_changed, coalesce(bool_or(event_type = 'view' AND b IS NOT NULL AND o IS NULL AND has), false) AS route_withdrawn
  FROM u JOIN h USING (user_id) WHERE NOT (b IS NULL AND o IS NULL) GROUP BY 1""")
def evidence_deltas(spark, d):
    day = F.dayofmonth("ts")
    rows = table(spark, d, "events").withColumn("phase", F.when(day <= 10, "baseline").when(day <= 20, "onset").otherwise("recovery"))
    top = rows.groupBy("user_id", "phase", "event_type").agg(F.max(F.floor("value")).cast("string").alias("value"))
    click = top.filter("event_type = 'click'").select("user_id", "phase", F.lit("bgp.peer.click.remote_as").alias("metric"), "value")
    view = top.filter("event_type = 'view'")
    routes = view.select("user_id", "phase", F.lit("route.view.present").alias("metric"), F.lit("true").alias("value")).unionByName(view.select("user_id", "phase", F.lit("route.view.protocols").alias("metric"), F.lit("bgp,static").alias("value")))
    other = top.filter("event_type not in ('click', 'view')").select("user_id", "phase", F.concat(F.lit("ping."), "event_type", F.lit(".all_success")).alias("metric"), F.lit("true").alias("value"))
    seen = click.unionByName(routes).unionByName(other).withColumn("run_id", F.col("user_id").cast("string"))
    return evidence.observable_features(seen).select("run_id", "remote_as_changed", "route_withdrawn")


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def event_props_parse(spark, d):
    k = F.from_json("props", "struct<k: bigint>", {"mode": "FAILFAST"})["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- event logs


LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
STRICT = LEGAL | {"start": ("system",)}
_LAG = "l AS (SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') AS before FROM conversations)"
_STEPS = ", ".join(f"'{a}>{b}'" for a, many in STRICT.items() for b in many)


@query(f"WITH {_LAG} SELECT conv_id, turn, before, role FROM l WHERE before || '>' || role NOT IN ({_STEPS})")
def ledger_violations(spark, d):
    return eventlog.illegal_transitions(table(spark, d, "conversations"), "conv_id", "turn", "role", STRICT)


@query("SELECT conv_id, max_by(role, turn) AS final, count(*) AS n FROM conversations GROUP BY 1")
def ledger_final_phase(spark, d):
    return eventlog.final_phase(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query("""WITH l AS (SELECT conv_id, turn AS seq, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE (conv_id + turn) % 7 <> 0)
  SELECT conv_id, seq, before, 'gap' AS fault FROM l WHERE seq > before + 1""")
def seq_gaps(spark, d):
    return eventlog.sequence_gaps(table(spark, d, "conversations").filter("(conv_id + turn) % 7 <> 0"), "conv_id", "turn")


@query("""WITH o AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
  s AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY user_id, island, ok ORDER BY attempt) ELSE 0 END AS streak FROM o)
  SELECT user_id, min(CASE WHEN streak >= 6 THEN attempt END) AS confirmed_at, max(streak) AS longest, count(*) AS attempts FROM s GROUP BY 1""")
def streaks(spark, d):
    return eventlog.first_confirmation(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error", 6)


@query("""WITH p AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) SELECT conv_id, bool_and(coalesce((['user', 'assistant', 'user', 'assistant'])[place] = role, false)) AS is_prefix, count(*) AS n FROM p GROUP BY 1""")
def phase_prefix(spark, d):
    return eventlog.phase_prefixes(table(spark, d, "conversations"), "conv_id", "turn", "role", ["user", "assistant", "user", "assistant"])


@query("""SELECT o_orderkey AS orderkey, 'pending_only' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'completed_only' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def unmatched_pairs(spark, d):
    return eventlog.unmatched(table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), c AS (
  SELECT conv_id, turn, n, 'evhash-' || left(sha256('{"payload":"' || role || '","previous":"seed-' || conv_id || '"}'), 24) AS hash FROM e WHERE n = 1
  UNION ALL SELECT e.conv_id, e.turn, e.n, 'evhash-' || left(sha256('{"payload":"' || e.role || '","previous":"' || c.hash || '"}'), 24) FROM e JOIN c ON e.conv_id = c.conv_id AND e.n = c.n + 1)
  SELECT conv_id, turn AS seq, hash FROM c""")
def chain_build(spark, d):
    return eventlog.build_chain(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "seq", "hash")


@query("""SELECT conv_id, turn AS seq, true AS link, false AS own FROM conversations WHERE turn = 1 AND conv_id % 5 = 0""")
def chain_verify(spark, d):
    chain = eventlog.build_chain(table(spark, d, "conversations"), "conv_id", "turn", "role")
    changed = (F.col("seq") == 1) & (F.col("conv_id") % 5 == 0)
    return eventlog.broken_links(chain.withColumn("payload", F.when(changed, "forged").otherwise(F.col("payload"))), "conv_id")


_FRAMES = """pl AS (SELECT conv_id AS plan_id, 1 + conv_id % 3 AS epochs, count(*) AS batches, 2 AS accumulation FROM conversations GROUP BY 1, 2), e AS (SELECT *, unnest(range(1, epochs + 1)) AS epoch FROM pl), b AS (SELECT *, unnest(range(1, batches + 1)) AS batch FROM e),
f AS (SELECT plan_id, epoch, batch, 'batch' AS event, 0 AS o FROM b UNION ALL SELECT plan_id, epoch, batch, 'step', 1 FROM b WHERE batch % accumulation = 0 OR batch = batches UNION ALL SELECT plan_id, epoch, batch, 'epoch_end', 2 FROM b WHERE batch = batches
  UNION ALL SELECT plan_id, 0, 0, 'started', 0 FROM pl UNION ALL SELECT plan_id, epochs, batches, 'finished', 3 FROM pl),
fr AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY epoch, batch, o) - 1 AS seq, epoch, batch, event FROM f)"""


@query(f"WITH {_FRAMES} SELECT * FROM fr")
def replay_skeleton(spark, d):
    """What a log must have for a plan of as many batches as a conversation has turns."""
    plans = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("plan_id")).agg(F.count(F.lit(1)).cast("int").alias("batches"))
    return eventlog.expected_frames(plans.select("plan_id", (1 + F.col("plan_id") % 3).cast("int").alias("epochs"), "batches", F.lit(2).alias("accumulation")))


@query("""WITH n AS (SELECT conv_id, unnest(range(0, max(turn) + 1)) AS turn FROM conversations GROUP BY 1), x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS expected FROM n)
  SELECT coalesce(x.conv_id, c.conv_id) AS plan_id, coalesce(x.turn, c.turn) AS seq, expected, role AS recorded FROM x FULL JOIN conversations c ON x.conv_id = c.conv_id AND x.turn = c.turn WHERE expected IS DISTINCT FROM role""")
def replay_differences(spark, d):
    """Recorded turns against the protocol that user and assistant take turns."""
    log = table(spark, d, "conversations")
    turns = log.groupBy("conv_id").agg(F.max("turn").alias("last")).select(F.col("conv_id").alias("plan_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("seq"))
    expected = turns.withColumn("event", F.when(F.col("seq") % 2 == 0, "user").otherwise("assistant"))
    return eventlog.replay_differences(expected, log.select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("seq"), F.col("role").alias("event")))


_KIND = "CASE event_type WHEN 'purchase' THEN 'epoch_end' WHEN 'click' THEN 'step' ELSE 'batch' END"


@query(f"""WITH f AS (SELECT user_id AS plan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS epoch, {_KIND} AS event FROM events)
  SELECT plan_id, seq, epoch, sum(CASE WHEN event = 'epoch_end' THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY seq)::BIGINT AS completed FROM f QUALIFY event = 'step'""")
def epochs_completed(spark, d):
    """Purchases that came before each click of a user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("plan_id"), F.row_number().over(order).alias("seq"), F.col("event_id").alias("epoch"), F.expr(_KIND).alias("event"))
    return eventlog.epochs_completed(rows)


@query("SELECT o_custkey, count(*) AS attempts, count(*) - 1 AS retries FROM orders GROUP BY 1")
def attempt_numbers(spark, d):
    return eventlog.attempts(table(spark, d, "orders"), "o_custkey", "o_orderkey")


# --- digests and rendering


def merkle_sql(source: str, leaf: str, by: str) -> str:
    """SQL of ``table_digest``: the tree of each value of ``by``, level by level from the deepest that its rows ask for."""
    depth = " + ".join(f"(size > {merkle.NODE_ROWS * 16**k})::INT" for k in range(6))
    levels = [f"""n6 AS (SELECT g, left(leaf, depth) AS prefix, sum(n)::BIGINT AS n, sha256(string_agg(leaf || ':' || n, ',' ORDER BY leaf)) AS digest FROM l JOIN s USING (g) GROUP BY 1, 2)"""]
    for k in range(5, 0, -1):
        levels.append(f"""n{k} AS (SELECT g, left(prefix, {k}) AS prefix, sum(n)::BIGINT AS n, CASE WHEN max(length(prefix)) <= {k} THEN min(digest) ELSE sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) END AS digest FROM n{k + 1} GROUP BY 1, 2)""")
    return f"""{source}, leaves AS (SELECT {by} AS g, sha256({leaf}) AS leaf FROM ex), l AS (SELECT g, leaf, count(*) AS n FROM leaves GROUP BY 1, 2), s AS (SELECT g, {depth} AS depth FROM (SELECT g, count(*) AS size FROM leaves GROUP BY 1)),
  {", ".join(levels)} SELECT g, sum(n)::BIGINT AS "rows", sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM n1 GROUP BY 1"""


_LEAF = """'{"example_id":"' || example_id || '","group_id":"' || group_id || '"}'"""


@query(f"""SELECT g AS partition, "rows", digest FROM ({merkle_sql(f"WITH {EX}", _LEAF, "partition")})""")
def partition_digest(spark, d):
    return store.table_digest(examples(spark, d).select("partition", "example_id", "group_id"), "partition")


@query("""SELECT n_regionkey, count(*) AS n, sha256(string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', chr(10) ORDER BY n_nationkey) || chr(10)) AS digest FROM nation GROUP BY 1""")
def export_digest(spark, d):
    line = canonical.canonical_json(canonical.record(key=F.col("n_nationkey"), name=F.col("n_name")))
    return store.ordered_digest(table(spark, d, "nation"), "n_nationkey", line, "n_regionkey")


@query(f"""SELECT "rows", digest FROM ({merkle_sql(f"WITH {EX}", _LEAF, "1")})""")
def merkle_digest(spark, d):
    return store.table_digest(examples(spark, d).select("example_id", "group_id"))


@query(f"WITH {_TRAIN} SELECT example_id, 'Name the fault family.' || chr(10) || chr(10) || 'Observations:' || chr(10) || 'backend=' || source || chr(10) || 'n_chars=' || n_chars || chr(10) || 'topology_hash=' || lang || chr(10) || chr(10) || 'Answer:' || chr(10) AS input_text, '{{\"fault_family\":\"' || fault_family || '\",\"prediction_type\":\"diagnosis\"}}' AS target_text FROM tr")
def training_corpus(spark, d):
    rows = dataset.eligible_for_training(examples(spark, d))
    text = evidence.feature_text(rows.select("backend", "n_chars", "topology_hash"))
    return rows.select("example_id", responses.training_input(text, "Name the fault family.").alias("input_text"), responses.training_target(F.col("fault_family")).alias("target_text"))


@query("SELECT doc_id, [1, 2, doc_id % 50 + 3, doc_id % 9 + 3, 0]::VARCHAR AS input_ids, [-100, -100, doc_id % 50 + 3, doc_id % 9 + 3, 0]::VARCHAR AS labels FROM documents")
def causal_labels(spark, d):
    pair = responses.causal_labels(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.array(F.col("doc_id") % 50 + 3, F.col("doc_id") % 9 + 3), F.lit(0).cast("bigint"), 16)
    rows = table(spark, d, "documents").select("doc_id", pair.alias("p"))
    return rows.select("doc_id", F.col("p.input_ids").cast("string").alias("input_ids"), F.col("p.labels").cast("string").alias("labels"))


@query("SELECT page_id, NOT contains(url, '..') AND NOT starts_with(url, '/') AND url <> '' AS safe FROM pages")
def path_safety(spark, d):
    return table(spark, d, "pages").select("page_id", canonical.safe_path(F.col("url")).alias("safe"))


# --- streaming, as batch over the same operator


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming.logs import event_windows as windows

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
