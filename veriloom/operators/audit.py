"""Leakage and integrity audits.  Findings are rows; ``enforce`` is the one action that raises.

Every audit that needs the rows of a key together aggregates by that key, so a hot key shrinks before it is shuffled; example ids
in a finding are collected for keys with a finding only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dataset import ABSTENTION, ACCEPTED, example_id, group_id
from .matcher import tokens_inside

COLUMNS = ("code", "severity", "group_id", "subject", "detail")


class AuditFailure(RuntimeError):
    pass


def _finding(rows: DataFrame, code: str | Column, subject: Column, detail: Column, group: Column | None = None, severity: str = "error") -> DataFrame:
    return rows.select(
        (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"),
        (F.lit(None).cast("string") if group is None else group).alias("group_id"), subject.cast("string").alias("subject"), detail.alias("detail"),
    )


def group_spans(assigned: DataFrame) -> DataFrame:
    some = assigned.groupBy("group_id").agg(F.array_sort(F.collect_set("partition")).alias("parts")).filter(F.size("parts") > 1)
    return _finding(some, "group_spans_partitions", F.col("group_id"), F.array_join("parts", ","), F.col("group_id"))


def duplicates(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Keys of more than one row: they are reported, never dropped."""
    some = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _finding(some, code, F.col(key), F.col("n").cast("string"))


def identity_mismatches(examples: DataFrame) -> DataFrame:
    """Stored ids that differ from what their own row gives."""
    again = examples.withColumns({"__group": group_id(examples), "__example": example_id(F.col("run_id"))})
    group = again.filter(~F.col("group_id").eqNullSafe(F.col("__group")))
    example = again.filter(~F.col("example_id").eqNullSafe(F.col("__example")))
    return _finding(group, "group_id_mismatch", F.col("example_id"), F.col("__group"), F.col("group_id")).unionByName(
        _finding(example, "example_id_mismatch", F.col("example_id"), F.col("__example"), F.col("group_id"))
    )


def kind_partitions(assigned: DataFrame) -> DataFrame:
    """Kinds in partitions that aren't theirs; an accepted row among abstentions breaks two rules and gives two findings."""
    abstains, inside = F.col("kind") == ABSTENTION, F.col("partition") == ABSTENTION
    rules = F.array(
        F.when(abstains & ~inside, F.lit("abstention_outside")),
        F.when(~abstains & inside, F.lit("accepted_among_abstentions")),
        F.when(~abstains & ~F.col("partition").isin("train", "validation", "test"), F.lit("accepted_not_trainable")),
    )
    rows = assigned.withColumn("rule", F.explode(F.array_compact(rules)))
    return _finding(rows, F.col("rule"), F.col("example_id"), F.col("partition"), F.col("group_id"))


def _sibling_keys(examples: DataFrame, orientation: tuple[str, ...]) -> DataFrame:
    """``code, key, group_id``: what groups that differ by orientation only, or by other parameters only, have in common."""
    groups = examples.groupBy("group_id").agg(*(F.first(c).alias(c) for c in ("template_id", "scenario_id", "topology_hash", "backend", *orientation)), F.first(F.to_json("parameters")).alias("parameters"))
    base = ["template_id", "scenario_id", "topology_hash", "backend"]
    rest = F.to_json(F.map_filter(F.from_json("parameters", "map<string,string>"), lambda k, _: ~k.isin(*orientation)))
    keys = F.array(*(
        F.struct(F.lit(code).alias("code"), F.to_json(F.struct(*columns)).alias("key"))
        for code, columns in (("orientation_siblings", [*base, rest.alias("rest")]), ("parameter_siblings", [*base, *orientation]))
    ))
    return groups.select("group_id", F.explode(keys).alias("k")).select("k.code", "k.key", "group_id")


ORIENTATION = ("target_node", "target_session")


def siblings(examples: DataFrame, orientation: tuple[str, ...] = ORIENTATION) -> DataFrame:
    """Keys of more than one group, each with its number of groups and the first of them; they inform and don't fail."""
    some = _sibling_keys(examples, orientation).groupBy("code", "key").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("group_id")).filter("n > 1")
    return _finding(some, F.col("code"), F.col("key"), F.col("n").cast("string"), F.col("group_id"), severity="info")


def sibling_members(examples: DataFrame, orientation: tuple[str, ...] = ORIENTATION) -> DataFrame:
    """``code, first, group_id``: the groups of each such key, which its first group names; one row for each."""
    rows = _sibling_keys(examples, orientation)
    some = rows.groupBy("code", "key").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("first")).filter("n > 1")
    return rows.join(some, ["code", "key"]).select("code", "first", "group_id")


def audit_leakage(assigned: DataFrame) -> DataFrame:
    parts = [
        group_spans(assigned), duplicates(assigned, "example_id", "duplicate_example"), duplicates(assigned, "run_id", "duplicate_run"),
        identity_mismatches(assigned), kind_partitions(assigned), siblings(assigned),
    ]
    return reduce(DataFrame.unionByName, parts)


def enforce(findings: DataFrame) -> None:
    """Raise if there is an error; the first five are named."""
    rows = findings.filter("severity = 'error'").orderBy("code", "subject").limit(5).collect()
    if rows:
        raise AuditFailure("; ".join(f"{r['code']}: {r['subject']} ({r['detail']})" for r in rows))


# Names that a model-facing payload must not have at any depth, and their prefix.
FORBIDDEN = (
    "example_id", "group_id", "run_id", "run_digest", "source_index_digest", "incident_reference", "ledger_reference", "transcript_reference",
    "recovery_reference", "ground_truth_reference", "rejection_code", "failed_phase", "template_id", "scenario_id", "fault_family", "partition",
    "split", "split_policy_id", "dataset_digest", "dataset_version", "dataset_group_id", "dataset_split", "acceptance_status", "stable_identity",
    "expected_outcome", "oracle_version", "code_commit", "example_kind", "label_policy_id", "kind",
)
FORBIDDEN_PREFIX = "dataset_"


def _walk(text: str, banned: set[str]) -> Iterator[tuple[str, str]]:
    """(rule, path) of every forbidden name or value of a JSON text, at any depth and in arrays."""
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        yield "unreadable", ""
        return
    if isinstance(whole, str) and whole in banned:
        yield "forbidden_value", ""
    stack = [("", whole)] if isinstance(whole, dict | list) else []
    while stack:
        path, node = stack.pop()
        named = isinstance(node, dict)
        for name, value in node.items() if named else enumerate(node):
            at = f"{path}[{name}]" if not named else f"{path}.{name}" if path else name
            if named and (name in FORBIDDEN or name.startswith(FORBIDDEN_PREFIX)):
                yield ("forbidden_key" if name in FORBIDDEN else "forbidden_prefix"), at
            if isinstance(value, str) and value in banned:
                yield "forbidden_value", at
            elif isinstance(value, dict | list):
                stack.append((at, value))


def feature_payload_findings(rows: DataFrame, id_: str, payload: str, sensitive: str) -> DataFrame:
    """``id, rule, path``: keys and values of JSON ``payload`` texts that give something away.

    Objects and arrays are walked to any depth.  ``sensitive`` is an array column of values that must not appear verbatim.  A text
    that is no JSON is a finding; null is no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rules, paths = [], [], []
            for k, (text, banned) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                if text.is_valid:
                    node = text.as_py()
                    for rule, path in _walk(node, set(banned.as_py() or ())):
                        at.append(k)
                        rules.append(rule)
                        paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rules, pa.string()), pa.array(paths, pa.string())], names=[id_, "rule", "path"])

    kind = rows.schema[id_].dataType.simpleString()
    return rows.select(id_, payload, sensitive).mapInArrow(run, f"`{id_}` {kind}, rule string, path string")


#: Parts of a value that look like a path of an artifact, and fields in which they may be.
PATH_MARKERS, PATH_EXEMPT = ("/", ".json", "run-", "evidence"), ("feature_policy_id", "topology_hash")
#: Fields that say what a payload is and are no features.
PAYLOAD_HEAD = ("schema_version", "feature_policy_id")


def observable_payload_findings(rows: DataFrame, id_: str, payload: str, sensitive: str, categories: dict[str, str], families: tuple[str, ...]) -> DataFrame:
    """``feature_payload_findings`` and more rules for payloads of observable features, ``id, rule, path``.

    Only fields of ``categories`` (context, raw_state or state_delta by name) are allowed; no value may be a fault family at any
    depth, or look like an artifact's path.
    """
    banned = F.array_union(F.coalesce(F.col(sensitive), F.array().cast("array<string>")), F.array(*map(F.lit, families)))
    deep = feature_payload_findings(rows.select(id_, payload, banned.alias("__banned")), id_, payload, "__banned")
    value = F.try_parse_json(F.col(payload))
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string, variant>"))
    fields = rows.select(id_, F.explode(entries).alias("e")).select(id_, F.col("e.key").alias("path"), F.when(F.schema_of_variant("e.value") == "STRING", F.try_variant_get("e.value", "$", "string")).alias("value"))
    known = [k for k, c in categories.items() if c in ("context", "raw_state", "state_delta")]
    path_like = ~F.col("path").isin(*PATH_EXEMPT) & F.coalesce(reduce(Column.__or__, (F.contains("value", F.lit(m)) for m in PATH_MARKERS)), F.lit(False))
    rules = F.array_compact(F.array(
        F.when(~F.col("path").isin(*PAYLOAD_HEAD, *categories), F.lit("outside_allowlist")), F.when(~F.col("path").isin(*PAYLOAD_HEAD, *known), F.lit("uncategorised")), F.when(path_like, F.lit("path_like_value")),
    ))
    return deep.unionByName(fields.select(id_, F.explode(rules).alias("rule"), "path"))


# Names that the input text of a training example must not contain.
INPUT_TOKENS = (
    "example_id", "group_id", "run_id", "run_digest", "source_index_digest", "prepared_digest", "dataset_digest", "evaluation_id", "benchmark_id",
    "split_policy_id", "rejection_code", "failed_phase", "outcome_category", "correctness", "ranking", "dataset_",
)
TARGET_KEYS = ("fault_family", "prediction_type")


def training_example_findings(rows: DataFrame, id_: str, text: str, target: str, own: str) -> DataFrame:
    """``id, rule, detail`` of training examples: forbidden names in the input, own ids (array ``own``) in it verbatim, and targets
    that are not an object of exactly the two keys with a diagnosis."""
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.filter(F.array(*map(F.lit, INPUT_TOKENS)), lambda t: F.contains(body, t))
    ids = F.filter(F.array_distinct(F.coalesce(F.col(own), F.array().cast("array<string>"))), lambda t: (t != "") & F.contains(body, t))
    value = F.try_parse_json(F.col(target))
    keys, wanted = F.json_object_keys(F.col(target)), F.array(*map(F.lit, TARGET_KEYS))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    shape = F.array_compact(F.array(
        F.when(value.isNull(), F.struct(F.lit("malformed_target").alias("rule"), F.lit("not JSON").alias("detail"))),
        F.when(value.isNotNull() & ~is_object, F.struct(F.lit("malformed_target").alias("rule"), F.lit("not an object").alias("detail"))),
        F.when(is_object & (F.try_variant_get(value, "$.prediction_type", "string") != "diagnosis"), F.struct(F.lit("malformed_target").alias("rule"), F.lit("not a diagnosis").alias("detail"))),
        F.when(is_object & (F.size(F.array_except(wanted, keys)) > 0), F.struct(F.lit("missing_field").alias("rule"), F.array_join(F.array_sort(F.array_except(wanted, keys)), ",").alias("detail"))),
        F.when(is_object & (F.size(F.array_except(keys, wanted)) > 0), F.struct(F.lit("unauthorized_field").alias("rule"), F.array_join(F.array_sort(F.array_except(keys, wanted)), ",").alias("detail"))),
    ))
    found = F.flatten(F.array(
        F.transform(tokens, lambda t: F.struct(F.lit("forbidden_token").alias("rule"), t.alias("detail"))), F.transform(ids, lambda t: F.struct(F.lit("own_id").alias("rule"), t.alias("detail"))), shape,
    ))
    return rows.select(id_, F.explode(found).alias("f")).select(id_, "f.rule", "f.detail")


def firewall(payloads: DataFrame, id_: str, text: str, held_out: DataFrame, token: str) -> DataFrame:
    """``id, token``: held-out tokens that stand anywhere in a payload, also inside a longer word.  An empty token is in no payload."""
    return tokens_inside(payloads, id_, text, held_out, token)


def _checks(rows: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rule, passed, detail`` of several rules in one scan of the rows: each names the condition that breaks it, and the id to report."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(rule).alias("rule"), F.col(id_).cast("string").alias("id"))) for rule, (bad, id_) in rules.items())))
    found = rows.select(F.explode(broken).alias("b")).select("b.rule", "b.id").distinct()
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("rule").orderBy("id"))).filter("nth <= 5")
    listed = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("detail"))
    names = rows.sparkSession.createDataFrame([(rule,) for rule in rules], "rule string")
    return names.join(listed, "rule", "left").select("rule", F.col("detail").isNull().alias("passed"), F.coalesce("detail", F.lit("")).alias("detail"))


def _marked(rows: DataFrame, known: DataFrame, key: str, mark: str) -> DataFrame:
    """The rows with ``mark`` true where ``known`` has their key, else null."""
    return rows.join(known.select(key).distinct().withColumn(mark, F.lit(True)), key, "left")


def held_out_firewall(examples: DataFrame, corpus: DataFrame, payloads: DataFrame) -> DataFrame:
    """Checks ``rule, passed, detail`` that nothing held out reaches training.

    ``examples(example_id, group_id, run_id, partition, kind, prepared_digest)``, ``corpus(source_example_id, partition, kind,
    prepared_digest)`` and ``payloads(name, text)``: the corpus binds these examples, its sources are accepted training examples and
    say so, and no payload has an example, group or run id of any other example.
    """
    train = (F.col("partition") == "train") & (F.col("kind") == ACCEPTED)
    held = examples.filter(~F.coalesce(train, F.lit(False))).select(F.explode(F.array("example_id", "group_id", "run_id")).alias("token"))
    digests = examples.select("prepared_digest").distinct()
    found = firewall(payloads, "name", "text", held, "token")
    leaks = payloads.select("name").distinct().join(found.groupBy("name").agg(F.array_join(F.slice(F.array_sort(F.collect_set("token")), 1, 5), ",").alias("detail")), "name", "left")
    by_name = leaks.select(F.concat(F.lit("no_held_out_identifier_in_"), "name").alias("rule"), F.col("detail").isNull().alias("passed"), F.coalesce("detail", F.lit("")).alias("detail"))
    bound = _marked(_marked(corpus, digests, "prepared_digest", "__bound"), examples.filter(train).select(F.col("example_id").alias("source_example_id")), "source_example_id", "__train")
    checks = _checks(bound, {
        "corpus_binds_this_prepared_corpus": (F.col("__bound").isNull(), "prepared_digest"), "training_sources_are_train_accepted_only": (F.col("__train").isNull(), "source_example_id"),
        "training_traces_literal_train": (~F.coalesce(train, F.lit(False)), "source_example_id"),
    })
    return checks.unionByName(by_name)


def expansion_firewall(planned: DataFrame, frozen: DataFrame, cases: DataFrame, topologies: DataFrame, groups: int, examples: int, least_groups: int, least_examples: int, spec_id: str) -> DataFrame:
    """Checks ``rule, passed, detail`` that a planned expansion is leakage-safe and large enough.

    ``planned`` has the identity columns, ``group_id, case_id, topology_id, assigned_partition, planned_examples, spec_id``;
    ``frozen(group_id, partition)``; ``cases(case_id)`` and ``topologies(topology_id)`` are what is approved.
    """
    again = planned.withColumn("__group", group_id(planned))
    repeated = planned.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sums = planned.agg(F.countDistinct("group_id").alias("distinct"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("planned_examples"), F.lit(0)).alias("examples"))
    check = lambda rule, test, detail: sums.select(F.lit(rule).alias("rule"), test.alias("passed"), detail.cast("string").alias("detail"))
    marked = again
    for known, key, mark in ((repeated, "group_id", "__repeated"), (frozen, "group_id", "__frozen"), (cases, "case_id", "__case"), (topologies, "topology_id", "__topology")):
        marked = _marked(marked, known, key, mark)
    rows = _checks(marked, {
        "planned_groups_unique": (F.col("__repeated").isNotNull(), "group_id"), "planned_disjoint_from_frozen": (F.col("__frozen").isNotNull(), "group_id"),
        "planned_identities_canonical": (~F.col("group_id").eqNullSafe(F.col("__group")), "group_id"), "all_assigned_train": (~F.col("assigned_partition").eqNullSafe(F.lit("train")), "group_id"),
        "cases_in_approved_set": (F.col("__case").isNull(), "group_id"), "topologies_in_approved_set": (F.col("__topology").isNull(), "group_id"), "spec_binding": (~F.col("spec_id").eqNullSafe(F.lit(spec_id)), "group_id"),
    })
    parts = [
        rows, _checks(frozen, {"no_heldout_reassigned": (~F.coalesce(F.col("partition").isin("train", "validation", "test", "abstention"), F.lit(False)), "group_id")}),
        check("meets_group_target", (F.col("rows") >= groups) & F.lit(groups >= least_groups), F.col("rows")),
        check("meets_example_target", (F.col("examples") >= examples) & F.lit(examples >= least_examples), F.col("examples")),
        check("coverage_by_independent_groups", F.col("distinct") == F.col("rows"), F.col("distinct")),
    ]
    return reduce(DataFrame.unionByName, parts)


def passages_inside(texts: DataFrame, id_: str, text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """``(id, item)``, each once, where a text contains a passage verbatim; an empty passage is in no text."""
    named = passages.select(item, F.col(passage).alias("__token"))
    return tokens_inside(texts, id_, text, named, "__token").join(named, "__token").select(id_, item).distinct()


# Programs that dump an environment, and what a credential's name has in it (in either case).
ENV_DUMPS = ("env", "printenv", "set", "export")
SECRETISH = ("SECRET", "TOKEN", "PASSWORD", "PASSWD", "APIKEY", "API_KEY", "PRIVATE_KEY")


def secret_arguments(transcript: DataFrame, id_: str, argv: str) -> DataFrame:
    """``id, rule``: commands of which an argument dumps an environment or names a credential, in whatever form."""
    dumps = F.exists(F.col(argv), lambda t: F.substring_index(t, "/", -1).isin(*ENV_DUMPS))
    leaks = F.exists(F.col(argv), lambda t: reduce(Column.__or__, (F.contains(F.upper(t), F.lit(w)) for w in SECRETISH)))
    rules = F.array_compact(F.array(F.when(dumps, F.lit("environment_dump")), F.when(leaks, F.lit("credential"))))
    return transcript.select(id_, F.explode(rules).alias("rule"))


def path_leaks(files: DataFrame, root: str) -> DataFrame:
    return files.filter(F.contains("content", F.lit(root))).select("path")


def missing_references(rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference resolves to nothing."""
    ids = target.select(F.col(target_key).alias("__key"))
    return rows.filter(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("__key"), "left_anti")
