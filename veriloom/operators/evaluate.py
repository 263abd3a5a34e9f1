"""Predictors as expressions, scoring, metrics, comparison and ranking.

All predictors run in one scan: a row is repeated per predictor by an array of predictions, so N predictors cost one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import content_id, normalised_label, ratio, record
from .dataset import ABSTENTION, ACCEPTED

ABSTAIN = "<abstain>"
PREDICTION = "struct<outcome: string, fault_family: string, reason: string, rules: array<string>, excerpt: string>"


def diagnosis(family: Column, *rules: str) -> Column:
    return _prediction("diagnosis", family, F.lit(None), rules)


def abstention(reason: str, *rules: str) -> Column:
    return _prediction("abstention", F.lit(None), F.lit(reason), rules)


def _prediction(outcome: str, family: Column, reason: Column, rules: tuple[str, ...]) -> Column:
    names = F.array(*map(F.lit, rules)) if rules else F.array().cast("array<string>")
    return F.struct(
        F.lit(outcome).alias("outcome"), family.cast("string").alias("fault_family"), reason.cast("string").alias("reason"), names.alias("rules"), F.lit(None).cast("string").alias("excerpt")
    )


def fixed_prior(family: str) -> Column:
    return diagnosis(F.lit(family), "fixed-prior")


def evidence_rule(family: str) -> Column:
    """First rule that matches: without onset evidence abstain, else the default family."""
    return F.when(F.col("onset_evidence").isNull(), abstention("no_onset_evidence", "no-onset")).otherwise(diagnosis(F.lit(family), "onset-default"))


def predict_all(examples: DataFrame, predictors: dict[str, Column]) -> DataFrame:
    """Rows of all predictors: ``predictor`` and ``prediction``, in one pass over the examples."""
    parts = F.array(*(F.struct(F.lit(k).alias("predictor"), v.alias("prediction")) for k, v in sorted(predictors.items())))
    return examples.withColumn("__p", F.explode(parts)).withColumns({"predictor": F.col("__p.predictor"), "prediction": F.col("__p.prediction")}).drop("__p")


def predict_with(features: DataFrame, backend, allowed: tuple[str, ...]) -> DataFrame:
    """Text responses of a user's ``backend(prompt frame) -> texts``, which sees the allowed feature columns only.

    The backend is made once per task by calling ``backend()``; a failure becomes a row with a reason, never an exception.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = backend()
        for batch in batches:
            try:
                texts, reason = list(answer(batch[list(allowed)])), None
                if len(texts) != len(batch):
                    texts, reason = [None] * len(batch), "backend_length"
            except Exception as error:  # noqa: BLE001 - a user's code
                texts, reason = [None] * len(batch), f"backend_{type(error).__name__}"
            yield pd.DataFrame({"example_id": batch["example_id"], "response": texts, "failure": reason})

    return features.select("example_id", *allowed).mapInPandas(run, "example_id string, response string, failure string")


def prediction_id(prediction: Column, predictor: Column, example: Column) -> Column:
    return content_id("pred", record(example_id=example, predictor=predictor, prediction=record(**{k: prediction[k] for k in ("outcome", "fault_family", "reason", "rules", "excerpt")})))


def prediction_id_mismatches(rows: DataFrame, stored: str = "prediction_id") -> DataFrame:
    """``predictor, example_id`` of rows whose stored prediction id isn't what their own content gives."""
    again = prediction_id(F.col("prediction"), F.col("predictor"), F.col("example_id"))
    return rows.filter(~F.col(stored).eqNullSafe(again)).select("predictor", "example_id")


def outcome(prediction: Column, kind: Column, family: Column) -> Column:
    """Category of a prediction: invalid output is never right, whatever the label."""
    accepted = kind == ACCEPTED
    right = normalised_label(prediction["fault_family"]).eqNullSafe(normalised_label(family))
    return (
        F.when(prediction["outcome"] == "invalid", "invalid_prediction")
        .when(accepted & (prediction["outcome"] == "abstention"), "abstained_on_diagnosis")
        .when(accepted & right, "correct_diagnosis")
        .when(accepted, "incorrect_diagnosis")
        .when(prediction["outcome"] == "abstention", "correct_abstention")
        .otherwise("false_diagnosis_on_rejected")
    )


def outcome_again(rows: DataFrame) -> Column:
    """The category by another road, for audits: a table of cases instead of a chain."""
    key = F.concat_ws("|", F.col("kind"), "prediction.outcome", (F.lower(F.trim("prediction.fault_family")) == F.lower(F.trim("fault_family"))).cast("string"))
    table = {"accepted_fault|abstention": "abstained_on_diagnosis", "accepted_fault|diagnosis|true": "correct_diagnosis", "accepted_fault|diagnosis|false": "incorrect_diagnosis", "abstention|abstention": "correct_abstention"}
    cases = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    fallback = F.when(F.col("prediction.outcome") == "invalid", "invalid_prediction").otherwise("false_diagnosis_on_rejected")
    return F.coalesce(F.try_element_at(cases, key), fallback)


def score(rows: DataFrame) -> DataFrame:
    """``rows(kind, fault_family, predictor, prediction, …)`` with ``outcome_category, correct, mismatch_reason``."""
    rows = rows.withColumn("outcome_category", outcome(F.col("prediction"), F.col("kind"), F.col("fault_family")))
    reason = (
        F.when(F.col("outcome_category") == "invalid_prediction", F.concat(F.lit("invalid: "), "prediction.reason"))
        .when(F.col("outcome_category") == "abstained_on_diagnosis", "abstained where a diagnosis was due")
        .when(F.col("outcome_category") == "incorrect_diagnosis", F.concat_ws(" instead of ", "prediction.fault_family", "fault_family"))
        .when(F.col("outcome_category") == "false_diagnosis_on_rejected", "diagnosed a rejected run")
    )
    return rows.withColumn("correct", F.col("outcome_category").isin("correct_diagnosis", "correct_abstention")).withColumn("mismatch_reason", reason)


def _is(*categories: str) -> Column:
    return F.count_if(F.col("outcome_category").isin(*categories))


def corpus_counts(records: DataFrame, by: tuple[str, ...] = ("predictor",)) -> DataFrame:
    parts = [F.count_if(F.col("partition") == p).alias(p if p != ABSTENTION else "abstention_partition") for p in ("train", "validation", "test", ABSTENTION)]
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == ACCEPTED).alias("accepted"), F.count_if(F.col("kind") == ABSTENTION).alias("abstention"), *parts
    )


def accepted_metrics(records: DataFrame, by: tuple[str, ...] = ("predictor", "partition")) -> DataFrame:
    """Per partition; invalid output counts as incorrect; partitions without accepted rows don't appear."""
    rows = records.filter((F.col("kind") == ACCEPTED) & F.col("partition").isin("train", "validation", "test")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated"), _is("correct_diagnosis").alias("right"), _is("incorrect_diagnosis", "invalid_prediction").alias("incorrect"), _is("abstained_on_diagnosis").alias("abstained")
    )
    return rows.withColumn("accuracy", ratio(F.col("right"), F.col("evaluated")))


def abstention_metrics(records: DataFrame) -> DataFrame:
    rows = records.groupBy("predictor").agg(
        F.count_if(F.col("kind") == ABSTENTION).alias("n"), _is("correct_abstention").alias("right"), _is("false_diagnosis_on_rejected").alias("false_diagnosis")
    )
    return rows.withColumn("accuracy", ratio(F.col("right"), F.col("n")))


def partition_summaries(records: DataFrame) -> DataFrame:
    """Per partition, and over all of them (``partition`` null), in one pass."""
    rows = records.rollup("predictor", "partition").agg(F.grouping("predictor").alias("__all"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    return rows.filter("__all = 0").drop("__all").withColumn("accuracy", ratio(F.col("right"), F.col("n")))


def confusion(records: DataFrame) -> DataFrame:
    rows = records.filter((F.col("kind") == ACCEPTED) & (F.col("prediction.outcome") != "invalid"))
    said = F.when(F.col("prediction.outcome") == "abstention", ABSTAIN).otherwise(F.col("prediction.fault_family"))
    return rows.groupBy("predictor", F.col("fault_family").alias("actual"), said.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def comparison(records: DataFrame) -> DataFrame:
    """One row per predictor."""
    trainable = (F.col("kind") == ACCEPTED) & F.col("partition").isin("train", "validation", "test")
    rows = records.groupBy("predictor").agg(
        F.count_if(trainable).alias("accepted_evaluated"), F.count_if(trainable & (F.col("outcome_category") == "correct_diagnosis")).alias("accepted_correct"),
        F.count_if(F.col("kind") == ABSTENTION).alias("abstention_count"), _is("correct_abstention").alias("abstention_correct"),
        _is("invalid_prediction").alias("invalid_count"), F.count(F.lit(1)).alias("evaluated"),
    )
    return rows.withColumns({"accuracy": ratio(F.col("accepted_correct"), F.col("accepted_evaluated")), "abstention_accuracy": ratio(F.col("abstention_correct"), F.col("abstention_count"))})


def parser_statistics(records: DataFrame) -> DataFrame:
    """Outcomes of each predictor's responses, and the share that is valid."""
    said = lambda x: F.count_if(F.col("prediction.outcome") == x)
    rows = records.groupBy("predictor").agg(F.count(F.lit(1)).alias("n"), said("diagnosis").alias("diagnoses"), said("abstention").alias("abstentions"), said("invalid").alias("invalid"))
    return rows.withColumn("valid_rate", ratio(F.col("n") - F.col("invalid"), F.col("n")))


def structured_output_report(records: DataFrame) -> DataFrame:
    """Reliability of every predictor: its scores, and how its responses parse; nothing is ranked on it."""
    scores = comparison(records).select("predictor", "accepted_evaluated", "accepted_correct", F.col("accuracy").alias("exact_match_accuracy"), "abstention_count", "abstention_correct", "abstention_accuracy", "invalid_count")
    return scores.join(parser_statistics(records).select("predictor", "diagnoses", "abstentions", "valid_rate"), "predictor")


def overall(records: DataFrame) -> DataFrame:
    """All of a predictor's metrics in one row: counts, accuracies of accepted and abstaining rows, and the accuracy over all."""
    rows = records.groupBy("predictor").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    return comparison(records).join(rows.select("predictor", "right", ratio(F.col("right"), F.col("n")).alias("overall_accuracy")), "predictor")


def ranking(rows: DataFrame) -> DataFrame:
    """A total order of predictors: accuracy, abstention accuracy (null lowest), fewer invalid, name.  One row per predictor."""
    key = [F.coalesce(F.col(c).cast("decimal(26,6)"), F.lit(-1)).desc() for c in ("accuracy", "abstention_accuracy")]
    order = Window.orderBy(*key, "invalid_count", "predictor")
    return rows.select(F.row_number().over(order).alias("place"), "predictor", "accuracy", "abstention_accuracy", "invalid_count")


def audit_metrics(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of a stored comparison that differ from what its records give, either way."""
    again = comparison(records).select(*stored.columns)
    return stored.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(again.exceptAll(stored).withColumn("side", F.lit("recomputed")))
