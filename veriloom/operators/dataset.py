"""From verified runs to a leakage-safe, label-separated dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import BUCKETS, canonical_json, content_id, digest_bucket, ordered_map, record, sha256_text

ACCEPTED, ABSTENTION = "accepted_fault", "abstention"
PARTITIONS = ("train", "validation", "test", "abstention")


@dataclass(frozen=True)
class SplitPolicy:
    """Whole-number shares of ``BUCKETS`` for train and validation; test has the rest."""

    salt: str
    train: int = 8000
    validation: int = 1000
    version: int = 1

    def __post_init__(self) -> None:
        if not self.salt or min(self.train, self.validation, BUCKETS - self.train - self.validation) <= 0:
            raise ValueError("every partition needs buckets, and the policy a salt")


def group_id(runs: DataFrame) -> Column:
    """Id of what two runs of one scenario share; nothing of the run itself enters."""
    have = set(runs.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")

    return content_id("grp", record(
        template_id=text("template_id"), scenario_id=text("scenario_id"), target_node=text("target_node"), target_session=text("target_session"),
        parameters=ordered_map(F.col("parameters")), topology_hash=text("topology_hash"), backend=text("backend"),
    ))


def example_id(run_id: Column) -> Column:
    return content_id("ex", record(run_id=run_id))


def identified(runs: DataFrame) -> DataFrame:
    return runs.withColumns({"group_id": group_id(runs), "example_id": example_id(F.col("run_id"))})


def bucket(group: Column, policy: SplitPolicy) -> Column:
    payload = record(algorithm_version=policy.version, group_id=group, salt=policy.salt)
    return digest_bucket(sha256_text(canonical_json(payload)))


def partition(kind: Column, group: Column, policy: SplitPolicy) -> Column:
    """Abstentions have a partition of their own; a group's bucket decides the rest."""
    b = bucket(group, policy)
    split = F.when(b < policy.train, "train").when(b < policy.train + policy.validation, "validation").otherwise("test")
    return F.when(kind == ABSTENTION, "abstention").otherwise(split)


def assigned(examples: DataFrame, policy: SplitPolicy) -> DataFrame:
    return examples.withColumn("partition", partition(F.col("kind"), F.col("group_id"), policy))


def project_accepted(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted runs as examples, and findings where one breaks an invariant."""
    rules = {
        "truth_missing": F.col("ground_truth").isNull(),
        "onset_missing": ~F.array_contains("phases", "onset"),
        "recovery_missing": ~F.array_contains("phases", "recovery"),
        "rejection_present": F.col("rejection_code").isNotNull(),
    }
    return _projected(runs.filter("status = 'accepted'"), ACCEPTED, rules)


#: The one phase in which a rejected run may have failed, and the policy under which it is set apart.
PRECONDITION, ABSTENTION_POLICY = "precondition", "abstention-v1"


def assignments(examples: DataFrame, policy: SplitPolicy) -> DataFrame:
    """``example_id, group_id, partition, assignment_id``: abstentions bypass the buckets under a fixed id of their own."""
    made = content_id("assign", record(example_id=F.col("example_id"), group_id=F.col("group_id"), salt=policy.salt, train=policy.train, validation=policy.validation))
    rows = assigned(examples, policy)
    return rows.select("example_id", "group_id", "partition", F.when(F.col("kind") == ABSTENTION, ABSTENTION_POLICY).otherwise(made).alias("assignment_id"))


def project_rejected(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = {
        "truth_present": F.col("ground_truth").isNotNull(),
        "rejection_missing": F.col("rejection_code").isNull(),
        "onset_present": F.array_contains("phases", "onset"),
        "restoration_present": F.array_contains("phases", "restore"),
        "recovery_present": F.array_contains("phases", "recovery"),
        "baseline_missing": ~(F.array_contains("phases", "baseline") | F.array_contains("phases", "precondition")),
        "mutation_present": F.coalesce("mutations", F.lit(0)) > 0,
        "fault_present": F.col("fault").isNotNull(),
        "phase_not_precondition": F.col("failed_phase") != PRECONDITION,
    }
    return _projected(runs.filter("status = 'rejected'"), ABSTENTION, rules)


def _projected(runs: DataFrame, kind: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    broken = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    rows = runs.withColumns({"kind": F.lit(kind), "broken": broken})
    findings = rows.select("run_id", F.explode("broken").alias("rule"))
    return rows.filter(F.size("broken") == 0).drop("broken"), findings


def project(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both kinds together; a run of another status is a finding."""
    good, bad = zip(project_accepted(runs), project_rejected(runs), strict=True)
    unknown = runs.filter(~F.coalesce(F.col("status").isin("accepted", "rejected"), F.lit(False))).select("run_id", F.lit("unknown_status").alias("rule"))
    return good[0].unionByName(good[1]), bad[0].unionByName(bad[1]).unionByName(unknown)


FEATURES = ("topology_hash", "backend", "n_chars", "onset_evidence")
LABELS = ("fault_family", "rejection_code")
TRACE = ("run_id", "group_id", "partition", "kind")


def separate(examples: DataFrame) -> dict[str, DataFrame]:
    """Features, labels and trace as three tables by example_id, each by its own list of columns."""
    layers = {"features": FEATURES, "labels": LABELS, "trace": TRACE}
    return {name: examples.select("example_id", *(c for c in columns if c in examples.columns)) for name, columns in layers.items()}


def rejoin(layers: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The layers together, and the ids that a layer lacks."""
    f, l, t = (layers[k] for k in ("features", "labels", "trace"))  # noqa: E741
    ids = f.select("example_id", F.lit("features").alias("layer"))
    ids = ids.unionByName(l.select("example_id", F.lit("labels").alias("layer"))).unionByName(t.select("example_id", F.lit("trace").alias("layer")))
    incomplete = ids.groupBy("example_id").agg(F.array_sort(F.collect_set("layer")).alias("layers")).filter(F.size("layers") < 3)
    return f.join(l, "example_id").join(t, "example_id"), incomplete


def eligible_for_training(examples: DataFrame) -> DataFrame:
    return examples.filter((F.col("partition") == "train") & (F.col("kind") == ACCEPTED))
