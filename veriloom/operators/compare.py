"""Paired comparison of two predictors, verdicts, and differences of corpus versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, ratio, record, sha256_text


def paired(base: DataFrame, trained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of two runs by example, and the examples that only one has or on whose label they disagree."""
    keep = ["example_id", "partition", "kind", "fault_family", "prediction", "correct", "outcome_category"]
    b = base.select("example_id", F.struct(*keep).alias("b"))
    t = trained.select("example_id", F.struct(*keep).alias("t"))
    both = b.join(t, "example_id", "full_outer")
    same = F.col("b.partition").eqNullSafe(F.col("t.partition")) & F.col("b.fault_family").eqNullSafe(F.col("t.fault_family")) & F.col("b.kind").eqNullSafe(F.col("t.kind"))
    problem = F.when(F.col("b").isNull(), "only_trained").when(F.col("t").isNull(), "only_base").when(~same, "label_differs")
    both = both.withColumn("problem", problem)
    return both.filter("problem is null").drop("problem"), both.filter("problem is not null").select("example_id", "problem")


def transitions(pairs: DataFrame, whole: bool = True) -> DataFrame:
    """Each pair's ``transition, identical, abstention_changed``.

    Predictions are identical if all their content is (``whole``), or if kind, family and reason are.
    """
    fields = ("outcome", "fault_family", "reason", "rules", "excerpt") if whole else ("outcome", "fault_family", "reason")
    identical = F.lit(True)
    for f in fields:
        identical = identical & F.col(f"b.prediction.{f}").eqNullSafe(F.col(f"t.prediction.{f}"))
    b, t = F.col("b.correct"), F.col("t.correct")
    name = F.when(b & t, "unchanged_correct").when(b, "regressed").when(t, "improved").when(identical, "unchanged_incorrect").otherwise("changed_still_incorrect")
    changed = (F.col("b.prediction.outcome") == "abstention") != (F.col("t.prediction.outcome") == "abstention")
    return pairs.select(
        "example_id", F.col("b.partition").alias("partition"), F.col("b.fault_family").alias("fault_family"), name.alias("transition"), identical.alias("identical"), changed.alias("abstention_changed"),
        (F.col("b.prediction.outcome") == "invalid").alias("base_invalid"), (F.col("t.prediction.outcome") == "invalid").alias("trained_invalid"),
    )


def paired_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    is_ = lambda *names: F.count_if(F.col("transition").isin(*names))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), is_("unchanged_correct").alias("both_correct"), is_("unchanged_incorrect", "changed_still_incorrect").alias("both_incorrect"),
        is_("regressed").alias("regressed"), is_("improved").alias("improved"), F.count_if("identical").alias("identical"), F.count_if(~F.col("identical")).alias("differed"),
        F.count_if("base_invalid").alias("base_invalid"), F.count_if("trained_invalid").alias("trained_invalid"), F.count_if("abstention_changed").alias("abstention_changed"),
    )


def interpretation(counts: DataFrame, fair: Column, min_test: int, min_changed: int, fixture: Column) -> DataFrame:
    """A conclusion from the counts of non-train pairs (one row, with ``eligible_test``), in fixed precedence."""
    up, down, changed = F.col("improved"), F.col("regressed"), F.col("differed")
    small = (F.col("eligible_test") < min_test) | (changed < min_changed)
    conclusion = (
        F.when(~fair, "confounded").when(changed == 0, "no_observed_effect").when(small, "inconclusive_underpowered")
        .when((up > 0) & (down == 0), "better").when((down > 0) & (up == 0), "worse").when((up > 0) & (down > 0), "mixed").otherwise("unchanged")
    )
    notes = F.array_sort(F.array_compact(F.array(
        F.when(fixture, F.lit("fixture_corpus")), F.when(down > 0, F.lit("regressions_present")), F.when((up + down > 0) & (up + down <= 1), F.lit("single_example")),
        F.when(fair & (changed > 0) & small, F.lit("insufficient_evidence")), F.when(~fair, F.lit("fairness_failed")),
    )))
    return counts.withColumns({"conclusion": conclusion, "qualifiers": notes})


def primary_metrics(base: DataFrame, trained: DataFrame) -> DataFrame:
    """One row: what an experiment's verdict rests on."""
    pairs, _ = paired(base, trained)
    test = F.col("b.partition") == "test"
    accepted = F.col("b.kind") == "accepted_fault"
    rows = pairs.agg(
        F.count_if(test & accepted).alias("test_evaluated"), F.count_if(test & F.col("b.correct")).alias("base_correct"), F.count_if(test & F.col("t.correct")).alias("trained_correct"),
        F.count_if(test & ~F.col("b.correct") & F.col("t.correct")).alias("wins"), F.count_if(test & F.col("b.correct") & ~F.col("t.correct")).alias("losses"),
        F.count_if(F.col("b.prediction.outcome") == "invalid").alias("base_invalid"), F.count_if(F.col("t.prediction.outcome") == "invalid").alias("trained_invalid"),
        F.count_if(~accepted).alias("abstentions"), F.count_if(~accepted & F.col("b.correct")).alias("base_abstained"), F.count_if(~accepted & F.col("t.correct")).alias("trained_abstained"),
    )
    return rows


def experiment_outcome(metrics: DataFrame, unconfounded: Column, min_test: int, more_invalid: int) -> DataFrame:
    """The verdict, a total rule in fixed precedence."""
    up, down = F.col("trained_correct") > F.col("base_correct"), F.col("trained_correct") < F.col("base_correct")
    invalid_up, invalid_down = F.col("trained_invalid") > F.col("base_invalid") + more_invalid, F.col("trained_invalid") < F.col("base_invalid")
    abstain_up, abstain_down = F.col("trained_abstained") > F.col("base_abstained"), F.col("trained_abstained") < F.col("base_abstained")
    wins, losses = F.col("wins") > F.col("losses"), F.col("wins") < F.col("losses")
    worse, better = down | invalid_up | abstain_down | losses, up | invalid_down | abstain_up | wins
    word = (
        F.when(~unconfounded, "experiment_failed").when(F.col("test_evaluated") < min_test, "inconclusive").when(up & wins & ~invalid_up & ~abstain_down, "improved")
        .when(worse & better, "mixed").when(worse, "regressed").when(better, "mixed").otherwise("unchanged")
    )
    return metrics.withColumn("verdict", word)


def fairness(base: DataFrame, trained: DataFrame, fields: list[str]) -> DataFrame:
    """``field, base, trained, equal`` of two one-row configurations."""
    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", name)

    return long(base, "base").join(long(trained, "trained"), "field").withColumn("equal", F.col("base").eqNullSafe(F.col("trained")))


def row_digest(*columns: str) -> Column:
    return sha256_text(canonical_json(record(**{c: F.col(c) for c in columns})))


def version_diff(old: DataFrame, new: DataFrame, key: str, content: list[str], partition: str) -> DataFrame:
    """One row of counts: how ``new`` differs from ``old``, by key and digest of content."""
    a = old.select(key, F.col(partition).alias("pa"), row_digest(*content).alias("da"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(partition).alias("pb"), row_digest(*content).alias("db"), F.lit(True).alias("in_new"))
    both = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    held = F.coalesce("pa", "pb") != "train"
    return a.join(b, key, "full_outer").agg(
        F.count_if(both & (F.col("da") == F.col("db"))).alias("unchanged"), F.count_if(both & (F.col("da") != F.col("db"))).alias("modified"),
        F.count_if(F.col("in_new").isNull()).alias("removed"), F.count_if(F.col("in_old").isNull()).alias("added"),
        F.count_if(both & (F.col("pa") != F.col("pb"))).alias("repartitioned"), F.count_if(held & both & (F.col("da") != F.col("db"))).alias("held_out_modified"),
    )


def appended_groups(old: DataFrame, new: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row ``appended_accepted, appended_rejected, new_groups, collisions`` of what ``new`` adds to ``old``; a collision is a group of
    an added example that ``frozen(group_id)`` has."""
    added = new.join(old.select("example_id"), "example_id", "left_anti")
    held = frozen.select("group_id", F.lit(True).alias("__frozen")).distinct()
    return added.join(held, "group_id", "left").agg(
        F.count_if(F.col("kind") == "accepted_fault").alias("appended_accepted"), F.count_if(F.col("kind") != "accepted_fault").alias("appended_rejected"), F.countDistinct("group_id").alias("new_groups"),
        F.countDistinct(F.when(F.col("__frozen"), F.col("group_id"))).alias("collisions"),
    )


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``metric, before, after, delta`` of two long tables ``(metric, value)``; a metric that one lacks counts 0."""
    rows = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric", "full_outer").na.fill(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def accuracy_by(rows: DataFrame, key: str) -> DataFrame:
    some = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    return some.withColumn("accuracy", ratio(F.col("right"), F.col("n")))
