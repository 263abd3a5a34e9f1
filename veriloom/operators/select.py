"""Balanced selections and planners, all by windows over a key that spreads (family, group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_family(examples: DataFrame, quota: int) -> DataFrame:
    """The first ``quota`` of each family by group and example, interleaved: ``position`` counts round by round."""
    rank = F.row_number().over(Window.partitionBy("fault_family").orderBy("group_id", "example_id"))
    rows = examples.withColumn("round", rank).filter(F.col("round") <= quota)
    return rows.withColumn("position", F.row_number().over(Window.orderBy("round", "fault_family")))  # quota x families rows


def group_round_robin(examples: DataFrame, quota: int) -> DataFrame:
    """One example of each group per round, groups in order, until a family has its quota."""
    turn = F.row_number().over(Window.partitionBy("fault_family", "group_id").orderBy("example_id"))
    pick = F.row_number().over(Window.partitionBy("fault_family").orderBy("round", "group_id"))
    return examples.withColumn("round", turn).filter(F.col("round") <= quota).withColumn("pick", pick).filter(F.col("pick") <= quota)


def shortfalls(selected: DataFrame, quota: int, least_groups: int) -> DataFrame:
    """Families whose selection is too small or spread over too few groups; a quota is never given to another family."""
    rows = selected.groupBy("fault_family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"))
    return rows.filter((F.col("n") < quota) | (F.col("groups") < least_groups))


def first_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(key).limit(n)


def unused_candidates(pool: DataFrame, frozen: DataFrame, n: int, partition: str = "train") -> DataFrame:
    """The first ``n`` candidates by id of a predicted partition whose group isn't frozen."""
    return pool.join(frozen.select("group_id").distinct(), "group_id", "left_anti").filter(F.col("partition") == partition).orderBy("group_id").limit(n)


class TooFew(RuntimeError):
    pass


def planned_candidates(pool: DataFrame, frozen: DataFrame, n: int, partition: str = "train") -> DataFrame:
    """``unused_candidates``, refused where there are fewer than ``n``."""
    found = unused_candidates(pool, frozen, n, partition)
    if (there := found.count()) < n:
        raise TooFew(f"{there} of {n} candidates")
    return found


def identity_first(pool: DataFrame, runs: dict[str, int]) -> DataFrame:
    """Candidates in priority: test groups, validation groups, families below the largest, missing topologies, missing cases.

    ``pool(group_id, fault_family, topology_hash, case_id, partition)`` has one row per group.  A family takes candidates in
    order of group while its projected runs are below the largest projection of the first two priorities, which is fixed before.
    """
    each = F.coalesce(*(F.when(F.col("partition") == p, F.lit(n)) for p, n in sorted(runs.items())), F.lit(0))
    rows = pool.withColumn("runs", each).withColumn("rule", F.when(F.col("partition") == "test", 1).when(F.col("partition") == "validation", 2))
    base = F.coalesce(F.sum(F.when(F.col("rule").isNotNull(), F.col("runs"))).over(Window.partitionBy("fault_family")), F.lit(0))
    rows = rows.withColumn("base", base).withColumn("__one", F.lit(1))
    # the largest sum of a family's runs is one row, summed up by family before
    sums = rows.filter("rule is not null").groupBy("fault_family").agg(F.sum("runs").alias("n"))
    rows = rows.join(F.broadcast(sums.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).withColumn("__one", F.lit(1))), "__one").drop("__one")
    open_ = F.col("rule").isNull()
    before = Window.partitionBy("fault_family", open_).orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    projected = F.col("base") + F.coalesce(F.sum("runs").over(before), F.lit(0))
    rows = rows.withColumn("rule", F.coalesce("rule", F.when(projected < F.col("most"), 3)))
    for rule, key in ((4, "topology_hash"), (5, "case_id")):
        covered = F.max(F.col("rule").isNotNull()).over(Window.partitionBy(key))
        nth = F.row_number().over(Window.partitionBy(key, F.col("rule").isNull()).orderBy("group_id"))
        rows = rows.withColumns({"covered": covered, "nth": nth})
        rows = rows.withColumn("rule", F.when(F.col("rule").isNull() & ~F.col("covered") & (F.col("nth") == 1), rule).otherwise(F.col("rule"))).drop("covered", "nth")
    return rows.filter("rule is not null").select("group_id", "fault_family", "topology_hash", "case_id", "partition", "runs", "rule")


def plan_counts(examples: Column, batch: Column, accumulation: Column, epochs: Column) -> dict[str, Column]:
    """Batches and optimizer steps in whole numbers."""
    def up(a: Column, b: Column) -> Column:
        return F.floor((a + b - 1) / b).cast("bigint")

    batches = up(examples, batch)
    steps = up(batches, accumulation)
    return {"batches": batches, "steps_per_epoch": steps, "total_steps": steps * epochs}


def selected_examples(selection: DataFrame, eligible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The eligible examples that a ``selection(example_id, fault_family)`` names, in any order, and findings ``example_id, rule``.

    A selected id that is not eligible, that comes twice, or whose family is another than its label is an error, not a row less.
    """
    chosen = selection.groupBy("example_id").agg(F.count(F.lit(1)).alias("__n"), F.min("fault_family").alias("__low"), F.max("fault_family").alias("__high"))
    both = chosen.join(eligible.withColumn("__there", F.lit(True)), "example_id", "left")
    same = F.col("__low").eqNullSafe(F.col("fault_family")) & F.col("__high").eqNullSafe(F.col("fault_family"))
    rules = F.array_compact(F.array(
        F.when(F.col("__there").isNull(), F.lit("not_eligible")), F.when(F.col("__n") > 1, F.lit("selected_twice")), F.when(F.col("__there").isNotNull() & ~same, F.lit("family_differs")),
    ))
    good = both.filter((F.size(rules) == 0)).select(*eligible.columns)
    return good, both.select("example_id", F.explode(rules).alias("rule"))


def with_features(examples: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples with their features by id, and the ids ``example_id, rule`` whose features are missing or there twice."""
    counts = features.groupBy("example_id").agg(F.count(F.lit(1)).alias("__n"))
    state = examples.select("example_id").join(counts, "example_id", "left")
    rule = F.when(F.col("__n").isNull(), "features_missing").when(F.col("__n") > 1, "features_repeated")
    findings = state.select("example_id", rule.alias("rule")).filter("rule is not null")
    return examples.join(features, "example_id"), findings


def unsorted_or_repeated(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Keys whose stored array isn't in order, or has a value twice: ``key, rule``."""
    distinct = F.array_distinct(values)
    rules = F.array_compact(F.array(F.when(F.array_sort(values) != F.col(values), F.lit("not_sorted")), F.when(F.size(distinct) != F.size(values), F.lit("not_unique"))))
    return rows.select(key, F.explode(rules).alias("rule"))
