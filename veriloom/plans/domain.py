"""Domain relations over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import bucket_sql
from ..functions.responses import parse_response
from ..operators import dataset, evaluate

POLICY = dataset.SplitPolicy(salt="gate6")
FAMILIES = ("q0t0", "q0t1", "q1t0", "q1t1")
RESPONSES = ('{"prediction_type":"diagnosis","fault_family":" Q1T0 "}', '{"prediction_type":"abstention"}', '{"prediction_type":"diagnosis"', "[1]", '{"prediction_type":"diagnosis","fault_family":"zzz"}', "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as verified runs; a label makes an accepted run and names its family."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "__id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(labels, F.col("doc_id") == F.col("__id"), "left")
    kind = F.when(F.col("__id").isNull(), dataset.ABSTENTION).otherwise(dataset.ACCEPTED)
    rows = rows.withColumns({
        "run_id": F.concat(F.lit("run-"), "doc_id"), "kind": kind, "fault_family": F.concat(F.lit("q"), "quality", F.lit("t"), "toxic"),
        "template_id": F.col("lang"), "scenario_id": F.col("source"), "topology_hash": F.col("lang"), "backend": F.col("source"), "target_node": F.lit(""), "target_session": F.lit(""),
        "baseline_evidence": F.lit("baseline"), "onset_evidence": F.when(F.col("__id").isNotNull(), "onset"), "rejection_code": F.when(F.col("__id").isNull(), "no_label"), "policy_id": F.lit("feat-1"), "label_policy_id": F.lit("lab-1"),
    })
    return rows.withColumn("parameters", F.create_map(F.lit("kind"), "kind")).drop("__id", "quality", "toxic")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.assigned(dataset.identified(runs(spark, sf_dir)), POLICY)


def response() -> F.Column:
    texts = F.array(*map(F.lit, RESPONSES))
    return F.element_at(texts, (F.col("doc_id") % len(RESPONSES) + 1).cast("int"))


def predictors() -> dict:
    by_length = F.when(F.col("n_chars") >= 2000, F.lit("q1t0")).otherwise(F.lit("q0t0"))
    return {
        "evidence_rule": evaluate.evidence_rule("q1t0"), "fixed_prior": evaluate.fixed_prior("q1t0"), "length_rule": F.when(F.col("n_chars") < 200, evaluate.abstention("too_short")).otherwise(evaluate.diagnosis(by_length, "length")),
        "responses": parse_response(response(), FAMILIES),
    }


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score(evaluate.predict_all(examples(spark, sf_dir), predictors()))


EX = f"""
runs AS (
  SELECT d.doc_id, 'run-' || d.doc_id AS run_id, CASE WHEN l.doc_id IS NULL THEN 'abstention' ELSE 'accepted_fault' END AS kind, 'q' || quality || 't' || toxic AS fault_family, d.lang, d.source, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), ids AS (
  SELECT *, 'grp-' || left(sha256('{{"backend":"' || source || '","parameters":{{"kind":"' || kind || '"}},"scenario_id":"' || source || '","target_node":"","target_session":"","template_id":"' || lang || '","topology_hash":"' || lang || '"}}'), 16) AS group_id,
    'ex-' || left(sha256('{{"run_id":"' || run_id || '"}}'), 16) AS example_id FROM runs
), digests AS (SELECT *, sha256('{{"algorithm_version":1,"group_id":"' || group_id || '","salt":"gate6"}}') AS h FROM ids),
buckets AS (SELECT *, {bucket_sql("h")} AS bucket FROM digests),
ex AS (SELECT *, CASE WHEN kind = 'abstention' THEN 'abstention' WHEN bucket < 8000 THEN 'train' WHEN bucket < 9000 THEN 'validation' ELSE 'test' END AS partition FROM buckets)"""

REC = f"""{EX},
said AS (
  SELECT ex.*, 'evidence_rule' AS predictor, CASE WHEN kind = 'abstention' THEN 'abstention' ELSE 'diagnosis' END AS outcome, CASE WHEN kind <> 'abstention' THEN 'q1t0' END AS said, CASE WHEN kind = 'abstention' THEN 'no_onset_evidence' END AS reason FROM ex
  UNION ALL SELECT ex.*, 'fixed_prior', 'diagnosis', 'q1t0', NULL FROM ex
  UNION ALL SELECT ex.*, 'length_rule', CASE WHEN n_chars < 200 THEN 'abstention' ELSE 'diagnosis' END, CASE WHEN n_chars >= 2000 THEN 'q1t0' WHEN n_chars >= 200 THEN 'q0t0' END, CASE WHEN n_chars < 200 THEN 'too_short' END FROM ex
  UNION ALL SELECT ex.*, 'responses', CASE doc_id % 6 WHEN 0 THEN 'diagnosis' WHEN 1 THEN 'abstention' ELSE 'invalid' END, CASE doc_id % 6 WHEN 0 THEN 'q1t0' END,
    CASE doc_id % 6 WHEN 1 THEN 'model_abstained' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'unknown_fault_family' WHEN 2 THEN 'malformed_json' WHEN 5 THEN 'malformed_json' END FROM ex
), rec AS (
  SELECT *, category IN ('correct_diagnosis', 'correct_abstention') AS correct FROM (SELECT *, CASE WHEN outcome = 'invalid' THEN 'invalid_prediction'
    WHEN kind = 'accepted_fault' AND outcome = 'abstention' THEN 'abstained_on_diagnosis' WHEN kind = 'accepted_fault' AND said = fault_family THEN 'correct_diagnosis' WHEN kind = 'accepted_fault' THEN 'incorrect_diagnosis'
    WHEN outcome = 'abstention' THEN 'correct_abstention' ELSE 'false_diagnosis_on_rejected' END AS category FROM said)
)"""
