"""Coverage, imbalance, quality and readiness of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, ratio, record, sha256_text
from .dataset import ABSTENTION, ACCEPTED


def distributions(examples: DataFrame, keys: list[str]) -> DataFrame:
    """``dimension, key, n`` of each key column, in one pass over the rows."""
    sets = [[F.col(k)] for k in keys]
    rows = examples.groupingSets(sets, *map(F.col, keys)).agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n"))
    number = {k: (1 << len(keys)) - 1 - (1 << len(keys) - 1 - i) for i, k in enumerate(keys)}
    dimension, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        dimension = F.when(F.col("__set") == number[k], F.lit(k)).otherwise(dimension)
        key = F.when(F.col("__set") == number[k], F.col(k).cast("string")).otherwise(key)
    return rows.select(dimension.alias("dimension"), key.alias("key"), "n").filter("key is not null")


def imbalance(counts: DataFrame) -> DataFrame:
    """Largest over smallest class of each dimension; null below two classes."""
    rows = counts.groupBy("dimension").agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return rows.withColumn("imbalance", F.when(F.col("classes") >= 2, ratio(F.col("largest"), F.col("smallest"))))


def duplicate_content(examples: DataFrame, content: list[str]) -> DataFrame:
    """Digests of content that more than one row has."""
    digest = sha256_text(canonical_json(record(**{c: F.col(c) for c in content})))
    return examples.groupBy(digest.alias("content_sha256")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def coverage_matrix(examples: DataFrame, key: str, sets: list[str]) -> DataFrame:
    parts = [F.count_if(F.col("partition") == p).alias(p) for p in ("train", "validation", "test")]
    return examples.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in sets), *parts)


def identity_coverage(examples: DataFrame) -> DataFrame:
    """Distinct groups of each partition; exact."""
    return examples.groupBy("partition").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("n"))


def check(rule: str, offenders: DataFrame, id_: str) -> DataFrame:
    """``rule, passed, detail``; the detail names the first five offenders."""
    first = offenders.select(F.col(id_).cast("string").alias("id")).distinct().orderBy("id").limit(5)
    return first.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("detail")).select(F.lit(rule).alias("rule"), (F.col("n") == 0).alias("passed"), "detail")


def quality_checks(examples: DataFrame) -> DataFrame:
    """Structural checks that fail closed; imbalance is reported elsewhere and changes nothing."""
    accepted, apart = F.col("kind") == ACCEPTED, F.col("partition") == ABSTENTION
    repeated = examples.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    leaking = examples.groupBy("group_id").agg(F.countDistinct("partition").alias("n")).filter("n > 1")
    malformed = examples.filter((accepted & (apart | F.col("fault_family").isNull())) | (~accepted & ~apart))
    evidence = examples.filter(F.col("baseline_evidence").isNull() | (accepted & F.col("onset_evidence").isNull()))
    policies, label_policies = (examples.agg(F.countDistinct(c).alias("n"), F.min(c).alias("id")).filter("n > 1") for c in ("policy_id", "label_policy_id"))
    parts = [
        check("unique_example_ids", repeated, "example_id"), check("no_split_leakage", leaking, "group_id"), check("no_malformed_examples", malformed, "example_id"),
        check("no_missing_evidence", evidence, "example_id"), check("uniform_policy", policies, "id"), check("uniform_label_policy", label_policies, "id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def assess(measures: DataFrame, targets: DataFrame) -> DataFrame:
    """``metric, value, least, mandatory, passed``: measures against thresholds; a metric that isn't measured counts 0."""
    rows = targets.join(measures, "metric", "left").na.fill(0, ["value"])
    return rows.withColumn("passed", F.col("value") >= F.col("least"))


def readiness(assessed: DataFrame) -> DataFrame:
    """One word: mandatory targets decide, advisory ones qualify."""
    rows = assessed.agg(
        F.coalesce(F.bool_and(F.col("passed") | ~F.col("mandatory")), F.lit(True)).alias("mandatory_met"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_met"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric")))), ",").alias("unmet"),
    )
    word = F.when(~F.col("mandatory_met"), "not_ready").when(~F.col("all_met"), "ready_with_advisories").otherwise("ready")
    return rows.select(word.alias("outcome"), "unmet")


def deficits(measures: DataFrame, targets: DataFrame) -> DataFrame:
    return assess(measures, targets).withColumn("missing", F.greatest(F.lit(0), F.col("least") - F.col("value"))).filter("missing > 0")


def long(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.select(*(F.col(m).cast("bigint").alias(m) for m in metrics)).unpivot([], metrics, "metric", "value")


class TargetsUnmet(RuntimeError):
    pass


def bind_expansion(assessed: DataFrame, parent: dict[str, str], policy: dict[str, str]) -> DataFrame:
    """One row ``parent_id, parent_digest, policy_id`` for an expansion of ``parent(id, digest)``; refused while a mandatory target of
    ``assessed`` is unmet, or if ``policy(id, source_id, source_digest)`` was made for another parent."""
    if (policy["source_id"], policy["source_digest"]) != (parent["id"], parent["digest"]):
        raise TargetsUnmet("the policy does not bind this parent")
    unmet = [r["metric"] for r in assessed.filter("mandatory and not passed").select("metric").orderBy("metric").limit(20).collect()]
    if unmet:
        raise TargetsUnmet(f"mandatory targets are unmet: {', '.join(unmet)}")
    return assessed.sparkSession.createDataFrame([(parent["id"], parent["digest"], policy["id"])], "parent_id string, parent_digest string, policy_id string")


def merged_checks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two check tables as one gate; refused if they share a rule, since a shadowed rule would weaken it."""
    shared = sorted(r["rule"] for r in first.select("rule").join(second.select("rule"), "rule", "left_semi").distinct().limit(5).collect())
    if shared:
        raise TargetsUnmet(f"both have the rules {', '.join(shared)}")
    return first.unionByName(second)
