"""Queries of run folders, stores, training-side audits, device parsing and catalogs, over rows planted in the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import audit, coverage, dataset, eventlog, evidence, evaluate, policy, select
from ..sources import jsonl, merkle, runs as folders, store
from ..sources.shared import fresh_folder
from ..functions.canonical import ratio_sql
from .domain import EX, REC, examples, records, table
from .registry import _ASSESS, _assessed, query

_TRAIN = f"{EX}, tr AS (SELECT * FROM ex WHERE partition = 'train')"


# --- training side


@query(f"""WITH {EX} SELECT doc_id, 'outside_allowlist' AS rule, 'extra' AS path FROM ex WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'uncategorised', 'extra' FROM ex WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'uncategorised', 'conclusion' FROM ex
  UNION ALL SELECT doc_id, 'forbidden_value', 'state' FROM ex WHERE doc_id % 19 = 0 UNION ALL SELECT doc_id, 'path_like_value', 'backend' FROM ex WHERE doc_id % 23 = 0 UNION ALL SELECT doc_id, 'forbidden_key', 'state.list[0].kind' FROM ex WHERE doc_id % 19 <> 0 AND doc_id % 13 = 0""")
def observable_payload_audit(spark, d):
    id_ = F.col("doc_id")
    payload = F.concat(
        F.lit('{"schema_version":2,"feature_policy_id":"a/b","topology_hash":"x/y","conclusion":1,"backend":"'), F.when(id_ % 23 == 0, F.concat(F.lit("out/"), "source")).otherwise(F.lit("lab")), F.lit('"'),
        F.when(id_ % 17 == 0, ',"extra":true').otherwise(""), F.when(id_ % 19 == 0, ',"state":"q1t0"').when(id_ % 13 == 0, ',"state":{"list":[{"kind":2}]}').otherwise(',"state":"idle"'), F.lit("}"),
    )
    rows = table(spark, d, "documents").select("doc_id", payload.alias("payload"), F.array().cast("array<string>").alias("none"))
    categories = {"topology_hash": "context", "backend": "context", "state": "raw_state", "conclusion": "conclusion"}
    return audit.observable_payload_findings(rows, "doc_id", "payload", "none", categories, ("q0t0", "q0t1", "q1t0", "q1t1"))


@query(f"""WITH {_TRAIN} SELECT example_id, 'forbidden_token' AS rule, 'run_id' AS detail FROM tr WHERE doc_id % 5 = 0 UNION ALL SELECT example_id, 'forbidden_token', 'dataset_' FROM tr WHERE doc_id % 7 = 0 UNION ALL SELECT example_id, 'own_id', group_id FROM tr WHERE doc_id % 3 = 0
  UNION ALL SELECT example_id, 'malformed_target', 'not JSON' FROM tr WHERE doc_id % 4 = 0 UNION ALL SELECT example_id, 'malformed_target', 'not an object' FROM tr WHERE doc_id % 4 = 1 UNION ALL SELECT example_id, 'missing_field', 'fault_family' FROM tr WHERE doc_id % 4 = 2
  UNION ALL SELECT example_id, 'unauthorized_field', 'note,why' FROM tr WHERE doc_id % 4 = 2 UNION ALL SELECT example_id, 'malformed_target', 'not a diagnosis' FROM tr WHERE doc_id % 4 = 2""")
def training_audit(spark, d):
    id_ = F.col("doc_id")
    text = F.concat(F.lit("state="), "lang", F.when(id_ % 5 == 0, " run_id=1").otherwise(""), F.when(id_ % 7 == 0, " dataset_x").otherwise(""), F.when(id_ % 3 == 0, F.concat(F.lit(" ("), "group_id", F.lit("x)"))).otherwise(""))
    good = F.concat(F.lit('{"fault_family":"'), "fault_family", F.lit('","prediction_type":"diagnosis"}'))
    target = F.when(id_ % 4 == 0, '{"fault_family"').when(id_ % 4 == 1, "[1]").when(id_ % 4 == 2, '{"note":1,"prediction_type":"abstention","why":2}').otherwise(good)
    rows = dataset.eligible_for_training(examples(spark, d)).withColumns({"input_text": text, "target_text": target, "own": F.array("example_id", "group_id")})
    return audit.training_example_findings(rows, "example_id", "input_text", "target_text", "own")


@query(f"""WITH {EX}, held AS (SELECT unnest([example_id, group_id, run_id]) AS token FROM ex WHERE partition <> 'train'), p AS (SELECT 'plan' AS name, 'uses ' || example_id || 'z' AS text FROM ex WHERE doc_id % 9 = 0 UNION ALL SELECT 'clean', 'nothing' FROM ex),
  leak AS (SELECT DISTINCT name, token FROM p JOIN held ON contains(text, token)), src AS (SELECT * FROM ex WHERE (partition = 'train' AND doc_id % 2 = 0) OR doc_id % 41 = 1),
  first AS (SELECT 'corpus_binds_this_prepared_corpus' AS rule, CASE WHEN count(*) > 0 THEN 'other' ELSE '' END AS detail FROM src WHERE doc_id % 41 = 1 UNION ALL SELECT 'training_sources_are_train_accepted_only', coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT example_id AS x FROM src WHERE partition <> 'train' ORDER BY 1 LIMIT 5)), '')
    UNION ALL SELECT 'training_traces_literal_train', coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT example_id AS x FROM src WHERE partition <> 'train' ORDER BY 1 LIMIT 5)), '')
    UNION ALL SELECT 'no_held_out_identifier_in_' || n, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT token AS x FROM leak WHERE name = n ORDER BY 1 LIMIT 5)), '') FROM (VALUES ('plan'), ('clean')) t(n))
  SELECT rule, detail = '' AS passed, detail FROM first""")
def held_out_firewall(spark, d):
    rows = examples(spark, d).withColumn("prepared_digest", F.lit("digest-1"))
    source = rows.filter("(partition = 'train' and doc_id % 2 = 0) or doc_id % 41 = 1")
    corpus = source.select(F.col("example_id").alias("source_example_id"), "partition", "kind", F.when(F.col("doc_id") % 41 == 1, "other").otherwise(F.col("prepared_digest")).alias("prepared_digest"))
    plan = rows.filter("doc_id % 9 = 0").select(F.lit("plan").alias("name"), F.concat(F.lit("uses "), "example_id", F.lit("z")).alias("text"))
    return audit.held_out_firewall(rows, corpus, plan.unionByName(rows.select(F.lit("clean").alias("name"), F.lit("nothing").alias("text"))))


@query(f"""WITH {EX}, g AS (SELECT group_id, min(lang) AS lang, min(source) AS source, min(partition) AS partition, min(kind) AS kind FROM ex GROUP BY 1), p AS (SELECT CASE WHEN source = 'src3' THEN 'grp-0' ELSE group_id END AS gid, * FROM g WHERE kind = 'accepted_fault'), f AS (SELECT * FROM g WHERE partition = 'test'),
  t AS (SELECT 'planned_groups_unique' AS rule, (SELECT string_agg(gid, ',' ORDER BY gid) FROM (SELECT gid FROM p GROUP BY 1 HAVING count(*) > 1)) AS detail UNION ALL SELECT 'planned_disjoint_from_frozen', (SELECT string_agg(gid, ',' ORDER BY gid) FROM (SELECT DISTINCT gid FROM p WHERE gid IN (SELECT group_id FROM f) ORDER BY 1 LIMIT 5))
  UNION ALL SELECT 'planned_identities_canonical', (SELECT string_agg(DISTINCT gid, ',') FROM p WHERE gid = 'grp-0') UNION ALL SELECT 'all_assigned_train', (SELECT string_agg(gid, ',' ORDER BY gid) FROM (SELECT DISTINCT gid FROM p WHERE lang = 'de' ORDER BY 1 LIMIT 5)) UNION ALL SELECT 'no_heldout_reassigned', NULL
  UNION ALL SELECT 'cases_in_approved_set', (SELECT string_agg(gid, ',' ORDER BY gid) FROM (SELECT DISTINCT gid FROM p WHERE source = 'src1' ORDER BY 1 LIMIT 5)) UNION ALL SELECT 'topologies_in_approved_set', NULL UNION ALL SELECT 'spec_binding', NULL)
  SELECT rule, detail IS NULL AS passed, coalesce(detail, '') AS detail FROM t UNION ALL SELECT 'meets_group_target', count(*) >= 12, count(*)::VARCHAR FROM p UNION ALL SELECT 'meets_example_target', sum(2) >= 100000, sum(2)::VARCHAR FROM p
  UNION ALL SELECT 'coverage_by_independent_groups', count(DISTINCT gid) = count(*), count(DISTINCT gid)::VARCHAR FROM p""")
def expansion_firewall(spark, d):
    rows = examples(spark, d)
    names = ("template_id", "scenario_id", "topology_hash", "backend", "target_node", "target_session")
    groups = rows.groupBy("group_id").agg(*(F.min(c).alias(c) for c in names), F.min("partition").alias("partition"), F.min("kind").alias("kind"))
    plan = groups.filter("kind = 'accepted_fault'").withColumns({
        "parameters": F.create_map(F.lit("kind"), "kind"), "case_id": F.col("scenario_id"), "topology_id": F.col("template_id"), "planned_examples": F.lit(2), "spec_id": F.lit("spec-1"),
        "assigned_partition": F.when(F.col("template_id") == "de", "test").otherwise("train"), "group_id": F.when(F.col("scenario_id") == "src3", "grp-0").otherwise(F.col("group_id")),
    })
    cases, topologies = (groups.select(F.col(c).alias(n)).distinct() for c, n in (("scenario_id", "case_id"), ("template_id", "topology_id")))
    return audit.expansion_firewall(plan, groups.filter("partition = 'test'"), cases.filter("case_id <> 'src1'"), topologies, 12, 100_000, 10, 1000, "spec-1")


@query(f"""WITH {_TRAIN}, s AS (SELECT example_id, CASE WHEN doc_id % 10 = 0 THEN 'zz' ELSE fault_family END AS fault_family FROM tr WHERE doc_id % 3 = 0 UNION ALL SELECT example_id, fault_family FROM tr WHERE doc_id % 12 = 0 UNION ALL SELECT example_id, fault_family FROM ex WHERE partition = 'test' AND doc_id % 3 = 0),
  c AS (SELECT example_id, count(*) AS n, bool_or(fault_family = 'zz') AS odd FROM s GROUP BY 1), r AS (SELECT c.*, tr.example_id IS NULL AS gone FROM c LEFT JOIN tr USING (example_id)), f AS (SELECT example_id, 'not_eligible' AS rule FROM r WHERE gone UNION ALL SELECT example_id, 'selected_twice' FROM r WHERE n > 1 UNION ALL SELECT example_id, 'family_differs' FROM r WHERE NOT gone AND odd)
  SELECT * FROM f UNION ALL SELECT example_id, 'selected' FROM r WHERE example_id NOT IN (SELECT example_id FROM f)""")
def selected_training_examples(spark, d):
    rows = examples(spark, d)
    eligible, third = dataset.eligible_for_training(rows), F.col("doc_id") % 3 == 0
    chosen = eligible.filter(third).select("example_id", F.when(F.col("doc_id") % 10 == 0, "zz").otherwise(F.col("fault_family")).alias("fault_family"))
    chosen = chosen.unionByName(eligible.filter("doc_id % 12 = 0").select("example_id", "fault_family")).unionByName(rows.filter((F.col("partition") == "test") & third).select("example_id", "fault_family"))
    good, findings = select.selected_examples(chosen, eligible)
    return findings.unionByName(good.select("example_id", F.lit("selected").alias("rule")))


@query(f"WITH {EX} SELECT example_id, 'features_missing' AS rule FROM ex WHERE doc_id % 14 = 0 UNION ALL SELECT example_id, 'features_repeated' FROM ex WHERE doc_id % 15 = 1 AND doc_id % 14 <> 0")
def missing_features(spark, d):
    rows = examples(spark, d)
    features = rows.filter("doc_id % 14 <> 0").select("example_id", "n_chars")
    return select.with_features(rows.select("example_id"), features.unionByName(rows.filter("doc_id % 15 = 1 and doc_id % 14 <> 0").select("example_id", "n_chars")))[1]


@query("""SELECT conv_id, CASE r WHEN 1 THEN 'not_sorted' ELSE 'not_unique' END AS rule FROM (SELECT conv_id, list(role ORDER BY turn) AS a FROM conversations GROUP BY 1), range(1, 3) t(r) WHERE CASE r WHEN 1 THEN a <> list_sort(a) ELSE len(a) <> len(list_distinct(a)) END""")
def unsorted_arrays(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    return select.unsorted_or_repeated(rows.select("conv_id", F.col("a.role").alias("roles")), "conv_id", "roles")


@query(f"WITH {_ASSESS} SELECT bool_and(passed OR NOT mandatory) AS bound FROM a")
def expansion_binding(spark, d):
    assessed = coverage.assess(*_assessed(spark, d))
    parent, plan = {"id": "corpus-1", "digest": "d"}, {"id": "policy-1", "source_id": "corpus-1", "source_digest": "d"}
    try:
        return coverage.bind_expansion(assessed, parent, plan).select(F.lit(True).alias("bound"))
    except coverage.TargetsUnmet:
        return spark.range(1).select(F.lit(False).alias("bound"))


@query("""SELECT event_id, regexp_matches(v, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$') AS finite FROM (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '' WHEN 3 THEN value::VARCHAR ELSE '1e-4' END AS v FROM events)""")
def finite_losses(spark, d):
    k = F.col("user_id") % 5
    text = F.when(k == 0, "NaN").when(k == 1, "Infinity").when(k == 2, "").when(k == 3, F.col("value").cast("string")).otherwise("1e-4")
    return table(spark, d, "events").select("event_id", policy.finite_decimal(text).alias("finite"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'status_unknown' WHEN l.doc_id IS NOT NULL THEN CASE WHEN doc_id % 7 = 1 THEN 'label_missing' WHEN doc_id % 7 = 2 THEN 'label_has_white_space' WHEN doc_id % 7 = 3 THEN 'verdict_missing' WHEN doc_id % 7 = 4 THEN 'recovery_missing' WHEN doc_id % 7 = 5 THEN 'rejection_present' END
  WHEN doc_id % 7 = 1 THEN 'truth_present' WHEN doc_id % 7 = 2 THEN 'rejection_missing' END AS violation FROM documents d LEFT JOIN labels l USING (doc_id)""")
def incident_assembly(spark, d):
    k = F.col("doc_id") % 7
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    accepted = F.col("labelled").isNotNull()
    status = F.when(F.col("doc_id") % 10 == 0, "pending").when(accepted, "accepted").otherwise("rejected")
    label = F.when(accepted, F.when(k == 1, "").when(k == 2, "a b").otherwise("q1t0")).when(k == 1, "q")
    violation = policy.incident_violation(status, label, F.when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("pass"))), k != 4, F.when(accepted, F.when(k == 5, "x")).when(k != 2, "no_label"))
    return rows.select("doc_id", violation.alias("violation"))


# --- run folders and stores


_FILES = """f AS (SELECT 'run-' || doc_id AS run_id, doc_id, 'text.txt' AS path, text AS content FROM documents UNION ALL SELECT 'run-' || doc_id, doc_id, 'lang.txt', lang FROM documents)"""


def _folders(spark, d):
    docs = table(spark, d, "documents").withColumn("run_id", F.concat(F.lit("run-"), "doc_id"))
    part = lambda path, c: docs.select("run_id", "doc_id", F.lit(path).alias("path"), F.col(c).cast("binary").alias("content"))
    whole = part("text.txt", "text").unionByName(part("lang.txt", "lang"))
    index = whole.select("run_id", "path", F.sha2("content", 256).alias("sha256"), F.when(F.col("doc_id") % 31 == 0, 9).otherwise(1).alias("schema_version"), "doc_id")
    index = index.filter("not (doc_id % 17 = 0 and path = 'lang.txt')").unionByName(index.filter("doc_id % 37 = 1 and path = 'text.txt'"))
    files = whole.filter("not (doc_id % 19 = 0 and path = 'lang.txt')").withColumn("content", F.when(F.col("doc_id") % 23 == 0, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")))
    marks = docs.filter("doc_id % 29 = 0").select("run_id", "doc_id", F.lit(folders.INCOMPLETE).alias("path"), F.lit("").cast("binary").alias("content"))
    return index.drop("doc_id"), files.unionByName(marks).drop("doc_id")


_SCAN = """SELECT 'run-' || doc_id AS run_id, rule FROM documents, (VALUES ('file_missing'), ('file_not_listed'), ('file_changed'), ('unfinished'), ('listed_twice'), ('schema_not_supported')) t(rule) WHERE CASE rule WHEN 'file_missing' THEN doc_id % 19 = 0 AND doc_id % 17 <> 0
  WHEN 'file_not_listed' THEN doc_id % 17 = 0 AND doc_id % 19 <> 0 WHEN 'file_changed' THEN doc_id % 23 = 0 WHEN 'unfinished' THEN doc_id % 29 = 0 WHEN 'listed_twice' THEN doc_id % 37 = 1 ELSE doc_id % 31 = 0 END"""


@query(_SCAN)
def run_scan(spark, d):
    return folders.scan_findings(*_folders(spark, d))


@query(f"""WITH s AS ({_SCAN}) SELECT 'run-' || doc_id AS run_id, CASE k WHEN 1 THEN 'text.txt' ELSE 'lang.txt' END AS path FROM documents, range(1, 3) t(k) WHERE 'run-' || doc_id NOT IN (SELECT run_id FROM s) AND NOT (k = 2 AND doc_id % 19 = 0)""")
def verified_run_files(spark, d):
    return folders.verified_runs(*_folders(spark, d)).select("run_id", "path")


@query("SELECT 'lang.txt' AS path, lang AS text FROM documents WHERE doc_id = 1 UNION ALL SELECT 'text.txt', text FROM documents WHERE doc_id = 1")
def one_run(spark, d):
    index, files = _folders(spark, d)
    return folders.load_run(index.filter("run_id <> 'run-1'").unionByName(index.filter("run_id = 'run-1'").distinct()), files, "run-1")


@query("""WITH r AS (SELECT 'run-' || doc_id AS run_id, sha256(text) AS run_digest FROM documents UNION ALL SELECT 'run-' || doc_id, sha256(text) FROM documents WHERE doc_id % 50 = 3)
  SELECT run_id, 'run_id_repeated' AS rule FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT run_id, 'run_digest_repeated' FROM r WHERE run_digest IN (SELECT run_digest FROM r GROUP BY 1 HAVING count(DISTINCT run_id) > 1)""")
def repeated_run_digests(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("run-"), "doc_id").alias("run_id"), F.sha2("text", 256).alias("run_digest"))
    return folders.repeated_digests(rows.unionByName(rows.filter("doc_id % 50 = 3")))


@query("""SELECT 'text' || doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 6 = 1 THEN 'not_listed' ELSE 'changed' END AS rule FROM documents WHERE doc_id % 6 < 3""")
def index_against_files(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("text"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    k = F.col("doc_id") % 6
    index = rows.filter(k != 1).select("path", F.sha2(F.when(k == 2, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")), 256).alias("sha256"))
    return store.file_findings(index, rows.filter(k != 0))


@query("SELECT 'run-' || doc_id AS path FROM documents WHERE doc_id % 8 = 0")
def host_path_leaks(spark, d):
    text = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("at /srv/run/"), "lang")).otherwise(F.lit("at run/"))
    return audit.path_leaks(table(spark, d, "documents").select(F.concat(F.lit("run-"), "doc_id").alias("path"), text.alias("content")), "/srv/run")


@query("SELECT n_nationkey AS key, n_name AS name, 'kept' AS state FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, n_name, 'new' FROM nation WHERE n_nationkey % 2 = 1")
def appended_index(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    old, new = (rows.filter(f"key % 2 = {k}").withColumn("state", F.lit(s)) for k, s in ((0, "kept"), (1, "new")))
    return store.append_to_index(old, new, "key")


@query("""SELECT 'digest' AS rule, false AS passed, 'nation' AS detail UNION ALL SELECT 'row_count', false, 'nation' UNION ALL SELECT 'table_present', true, 'nation' UNION ALL SELECT r, true, 'region' FROM (VALUES ('digest'), ('row_count'), ('table_present')) t(r)""")
def store_verification(spark, d):
    """An artifact of two tables is written, one table is tampered with, and verification tells which."""
    home = store.ArtifactStore(spark, fresh_folder(spark, "artifacts"))
    home.write("a1", {name: table(spark, d, name) for name in ("nation", "region")})
    table(spark, d, "nation").limit(1).write.mode("append").parquet(f"{home.root}/a1/nation")
    return home.verify("a1")


def _versions(spark, d):
    """The documents without every tenth, and all with some texts edited, stored as versions."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    root = fresh_folder(spark, "versions")
    old = merkle.Version(spark, f"{root}/v3", "doc_id").write(docs.filter("doc_id % 10 <> 0"))
    return old, merkle.Version(spark, f"{root}/v4", "doc_id").write(edited.filter("doc_id % 89 <> 1"), old.depth)


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 89 = 1 THEN 'removed' ELSE 'modified' END AS change FROM documents
  WHERE (doc_id % 10 = 0 AND doc_id % 89 <> 1) OR (doc_id % 10 <> 0 AND (doc_id % 97 = 0 OR doc_id % 89 = 1))""")
def version_difference(spark, d):
    return merkle.difference(*_versions(spark, d))


@query("""SELECT 'nothing_modified' AS rule, count(*) = 0 AS passed, count(*)::VARCHAR AS detail FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 97 = 0 AND doc_id % 89 <> 1
  UNION ALL SELECT 'nothing_removed', count(*) = 0, count(*)::VARCHAR FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 89 = 1""")
def append_only_checks(spark, d):
    return merkle.append_only(*_versions(spark, d))


@query(f"WITH {EX} SELECT partition, count(*) AS n FROM ex GROUP BY 1 UNION ALL SELECT 'wrong', count(*) FROM ex WHERE doc_id % 100 = 5 AND partition <> 'test'")
def placement_recomputed(spark, d):
    """Stored placements and counts against what the examples themselves give."""
    from .domain import POLICY

    rows = examples(spark, d)
    stored = rows.withColumn("partition", F.when(F.col("doc_id") % 100 == 5, "test").otherwise(F.col("partition")))
    again = dataset.partition(F.col("kind"), F.col("group_id"), POLICY)
    wrong = stored.filter(~F.col("partition").eqNullSafe(again)).agg(F.lit("wrong").alias("partition"), F.count(F.lit(1)).alias("n"))
    return stored.groupBy(again.alias("partition")).agg(F.count(F.lit(1)).alias("n")).unionByName(wrong)


# --- logs


@query("""SELECT conv_id, status, final, wanted FROM (SELECT conv_id, CASE WHEN conv_id % 9 = 4 THEN 'mystery' WHEN conv_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status, coalesce(max_by(role, turn), 'start') AS final,
  CASE WHEN conv_id % 9 = 4 THEN NULL WHEN conv_id % 2 = 0 THEN 'assistant' ELSE 'start' END AS wanted FROM conversations GROUP BY conv_id) WHERE wanted IS NULL OR final <> wanted""")
def final_phase_by_status(spark, d):
    rows = table(spark, d, "conversations")
    incidents = rows.select("conv_id").distinct().withColumn("status", F.when(F.col("conv_id") % 9 == 4, "mystery").when(F.col("conv_id") % 2 == 0, "accepted").otherwise("rejected"))
    return eventlog.final_phase_findings(rows, incidents, "conv_id", "turn", "role", {"accepted": "assistant", "rejected": "start"})


_SEQ = "CASE WHEN (conv_id + turn) % 11 = 0 THEN turn - 3 WHEN (conv_id + turn) % 7 = 0 THEN turn ELSE turn + 1 END"


@query(f"""WITH s AS (SELECT conv_id, turn AS position, {_SEQ} AS seq FROM conversations), l AS (SELECT *, lag(seq) OVER (PARTITION BY conv_id ORDER BY position) AS before FROM s)
  SELECT conv_id, position, seq, before, CASE WHEN seq < 1 THEN 'below_one' ELSE 'decreasing' END AS fault FROM l WHERE seq < 1 OR seq < before""")
def seq_order(spark, d):
    rows = table(spark, d, "conversations").withColumn("seq", F.expr(_SEQ))
    return eventlog.sequence_faults(rows, "conv_id", "turn", "seq")


@query("""SELECT event_id, rule FROM events, (VALUES ('environment_dump'), ('credential')) t(rule) WHERE CASE rule WHEN 'environment_dump' THEN event_type = 'error' ELSE event_type = 'click' OR user_id % 13 = 0 END""")
def transcript_guard(spark, d):
    kind = F.col("event_type")
    argv = F.array(
        F.when(kind == "error", F.when(F.col("user_id") % 2 == 0, "/usr/bin/export").otherwise("printenv")).otherwise("show"), F.when(kind == "click", F.when(F.col("user_id") % 2 == 0, "--token").otherwise("my_Api_Key")).otherwise("settings"),
        F.when(F.col("user_id") % 13 == 0, "x").otherwise("y"), F.when(F.col("user_id") % 13 == 0, "PRIVATE_KEY_FILE").otherwise("z"),
    )
    return audit.secret_arguments(table(spark, d, "events").select("event_id", argv.alias("argv")), "event_id", "argv")


_TORN = "CASE WHEN turn = (max(turn) OVER (PARTITION BY conv_id)) AND conv_id % 3 = 0 THEN '{\"role\":' WHEN (conv_id + turn) % 10 = 0 THEN 'torn' ELSE '{\"role\":\"' || role || '\"}' END"


@query(f"""WITH l AS (SELECT conv_id, turn, role, {_TORN} AS line, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, role, 'row' AS what FROM l WHERE line LIKE '%}}' UNION ALL SELECT conv_id, turn, NULL, 'torn_before_end' FROM l WHERE line NOT LIKE '%}}' AND turn <> last""")
def torn_logs(spark, d):
    last = F.expr("max(turn) over (partition by conv_id)")
    line = F.when((F.col("turn") == last) & (F.col("conv_id") % 3 == 0), '{"role":').when((F.col("conv_id") + F.col("turn")) % 10 == 0, "torn").otherwise(F.concat(F.lit('{"role":"'), "role", F.lit('"}')))
    rows = table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    good, findings = jsonl.read_torn_log(rows, "conv_id", "turn", "line", "role string")
    return good.withColumn("what", F.lit("row")).unionByName(findings.withColumn("role", F.lit(None).cast("string")).withColumnRenamed("rule", "what"))


# --- device output


@query("""SELECT user_id, 'bgp.peer.10.0.0.' || user_id || '.' || k AS metric, CASE k WHEN 'present' THEN 'true' WHEN 'remote_as' THEN (65000 + n)::VARCHAR ELSE CASE WHEN user_id % 2 = 0 THEN 'established' ELSE 'idle' END END AS value
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (VALUES ('present'), ('remote_as'), ('state')) t(k) WHERE user_id % 5 <> 0""")
def bgp_metrics(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("user_id") % 2 == 0, '"state":"Established"').otherwise('"peerState":"IDLE"')
    text = F.concat(F.lit('{"ipv4Unicast":{"peers":{"10.0.0.'), "user_id", F.lit('":{'), state, F.lit(',"remoteAs":'), 65000 + F.col("n"), F.lit("}}}}"))
    text = F.when(F.col("user_id") % 5 == 0, "{}").otherwise(text)
    return rows.select("user_id", F.explode(evidence.bgp_metrics(text)).alias("metric", "value"))


@query("""SELECT n_nationkey, 'iface.eth' || n_regionkey || '.' || k AS metric, CASE WHEN n_nationkey % 3 = 0 THEN 'down' WHEN k = 'admin' THEN 'up' WHEN n_nationkey % 2 = 0 THEN 'up' ELSE 'down' END AS value FROM nation, (VALUES ('admin'), ('oper')) t(k)""")
def interface_metrics(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(
        F.lit('{"eth'), "n_regionkey", F.lit('":{"'), F.when(k % 4 == 0, "adminStatus").otherwise("administrativeStatus"), F.lit('":"'), F.when(k % 3 == 0, "Down").otherwise("Up"),
        F.lit('","operStatus":"'), F.when(k % 2 == 0, "UP").otherwise("down"), F.lit('"}}'),
    )
    return table(spark, d, "nation").select("n_nationkey", F.explode(evidence.interface_metrics(text)).alias("metric", "value"))


@query("""SELECT n_nationkey, 'route.' || p || '.' || k AS metric, CASE k WHEN 'present' THEN (p = '10.1.0.0/24' AND n_nationkey % 3 <> 0)::VARCHAR ELSE CASE WHEN p = '10.1.0.0/24' AND n_nationkey % 3 <> 0 THEN 'bgp,static' ELSE '' END END AS value
  FROM nation, (VALUES ('10.1.0.0/24'), ('10.2.0.0/24')) a(p), (VALUES ('present'), ('protocols')) t(k)""")
def route_metrics(spark, d):
    text = F.when(F.col("n_nationkey") % 3 == 0, "{}").otherwise('{"10.1.0.0/24":[{"protocol":"static"},{"protocol":"bgp"},{"protocol":"static"}],"10.9.0.0/24":[{"protocol":"x"}]}')
    return table(spark, d, "nation").select("n_nationkey", F.explode(evidence.route_metrics(text, ["10.2.0.0/24", "10.1.0.0/24"])).alias("metric", "value"))


@query("SELECT user_id, bool_and(event_type <> 'error') AS all_ok FROM events GROUP BY 1")
def ping_success(spark, d):
    probes = F.collect_list(F.struct((F.col("event_type") != "error").alias("ok")))
    return table(spark, d, "events").groupBy("user_id").agg(probes.alias("p")).select("user_id", evidence.ping_success(F.col("p")).alias("all_ok"))


_CONFIG_TEXT = "CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 5 = 0 THEN repeat(coalesce(text, ''), 40) ELSE text END"


@query(f"""WITH c AS (SELECT doc_id, {_CONFIG_TEXT} AS c FROM documents), b AS (SELECT doc_id, c, strlen(c) AS n FROM c),
  w AS (SELECT doc_id, c, CASE WHEN n <= 65536 THEN c ELSE coalesce(try(decode(encode(c)[1:65536])), try(decode(encode(c)[1:65535])), try(decode(encode(c)[1:65534])), try(decode(encode(c)[1:65533]))) END AS kept FROM b)
  SELECT doc_id, CASE WHEN length(trim(c)) > 0 THEN sha256(kept) END AS digest FROM w""")
def config_digests(spark, d):
    """Whole texts as configurations: some are blank, and some are repeated beyond the bound, where they are cut."""
    return table(spark, d, "documents").select("doc_id", evidence.config_digest(F.expr(_CONFIG_TEXT)).alias("digest"))


@query("""SELECT n_nationkey, 'ev-' || left(sha256('{"node":"' || n_name || '","normalized":{"a":"1","name":"' || n_name || '"},"status":"ok"}'), 16) AS evidence_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS output FROM nation""")
def evidence_records(spark, d):
    seen = F.create_map(F.lit("name"), "n_name", F.lit("a"), F.lit("1"))
    made = evidence.evidence_record(seen, node=F.col("n_name"), status=F.lit("ok"))
    status = F.when(F.col("n_nationkey") % 2 == 0, "ok").otherwise("timeout")
    return table(spark, d, "nation").select("n_nationkey", made["evidence_id"].alias("evidence_id"), evidence.usable_output(status, F.col("n_name")).alias("output"))


@query("""SELECT 'n1:' || n AS check_id, CASE n WHEN 'config_unchanged' THEN 'pass' WHEN 'iface_admin_up' THEN 'pass' WHEN 'bgp_established' THEN 'fail' WHEN 'bgp_not_established' THEN 'pass' WHEN 'remote_as_equals' THEN 'fail' WHEN 'remote_as_differs' THEN 'pass' WHEN 'bgp_peer_present' THEN 'pass' WHEN 'bgp_peer_absent' THEN 'fail'
    WHEN 'iface_admin_down' THEN 'fail' ELSE 'insufficient' END AS verdict FROM (VALUES ('iface_operational'), ('iface_admin_up'), ('iface_admin_down'), ('iface_oper_down'), ('reachability_ok'), ('reachability_fails'), ('bgp_peer_present'), ('bgp_peer_absent'), ('bgp_established'), ('bgp_not_established'), ('remote_as_equals'), ('remote_as_differs'),
    ('config_unchanged'), ('route_present'), ('route_absent')) t(n)""")
def standard_checks(spark, d):
    """The standard checks of a target against observations that come from the nations."""
    rows = table(spark, d, "nation")
    one = lambda metric, value: rows.select(F.lit(metric).alias("metric"), value.alias("value"), F.lit(True).alias("trusted"))
    seen = one("config.sha256", F.sha2("n_name", 256)).unionByName(one("iface.eth1.admin", F.lit("up"))).unionByName(one("bgp.peer.p.state", F.lit("idle"))).unionByName(one("bgp.peer.p.remote_as", (F.col("n_nationkey") + 1000).cast("string"))).unionByName(one("bgp.peer.p.present", F.lit("true")))
    return evidence.verify_claims(evidence.checks_for(spark, "n1", "p", "eth1", "10.0.0.0/24", "7"), seen).select("check_id", "verdict")


# --- names, numbers, ids


@query("""SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE rtrim(rtrim((value::DECIMAL(18,4))::VARCHAR, '0'), '.') END AS text FROM events""")
def canonical_decimals(spark, d):
    return table(spark, d, "events").select("event_id", canonical.canonical_decimal(F.col("value").cast("decimal(18,4)").cast("string")).alias("text"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 600 THEN text END AS short, CASE WHEN text IS NOT NULL THEN true END AS bounded FROM documents")
def byte_bounds(spark, d):
    """Whole texts cut at 600 bytes: unchanged where they are short, else a true prefix of 597 to 600 bytes."""
    text = F.col("text")
    cut = canonical.truncated_bytes(text, 600)
    short = F.octet_length(text) <= 600
    good = F.when(short, cut == text).otherwise(text.startswith(cut) & F.octet_length(cut).between(597, 600))
    return table(spark, d, "documents").select("doc_id", F.when(short, cut).alias("short"), good.alias("bounded"))


@query("SELECT page_id, regexp_matches(n, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT contains(n, '..') AS safe FROM (SELECT page_id, split_part(url, '/', 3) || CASE page_id % 4 WHEN 0 THEN '..' WHEN 1 THEN '/x' ELSE '' END AS n FROM pages)")
def safe_names(spark, d):
    k = F.col("page_id") % 4
    name = F.concat(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.when(k == 0, "..").when(k == 1, "/x").otherwise(""))
    return table(spark, d, "pages").select("page_id", canonical.safe_name(name).alias("safe"))


@query("SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) >= 6 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS id FROM customer")
def sequence_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", canonical.sequence_id(F.col("c_custkey")).alias("id"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unsupported' WHEN p_size % 3 = 0 THEN 'nondeterministic' WHEN p_size % 2 = 0 THEN 'deterministic_supported' ELSE 'best_effort' END AS category FROM part""")
def determinism_categories(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", policy.determinism(n % 5 != 0, n % 3 != 0, F.when(n % 2 == 0, "cpu").otherwise("gpu")).alias("category"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'target_missing' WHEN c_custkey % 11 = 1 THEN 'expected_target_differs' WHEN c_custkey % 11 = 2 THEN 'session_unknown' WHEN c_custkey % 4 = 3 THEN 'template_unknown' WHEN c_custkey % 4 = 1 THEN CASE WHEN c_nationkey > 15 THEN 'interface_not_allowed' END
  WHEN c_custkey % 4 = 2 THEN CASE WHEN c_nationkey > 15 THEN 'prefix_malformed' WHEN c_nationkey > 5 THEN 'prefix_not_announced' END WHEN c_nationkey = 0 THEN 'number_missing' WHEN c_nationkey = 1 THEN 'number_malformed' WHEN c_nationkey = 2 THEN 'number_out_of_range' WHEN c_nationkey = 3 THEN 'number_is_local' WHEN c_nationkey = 4 THEN 'number_is_peer' END AS violation FROM customer""")
def case_violations(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    template = F.when(k % 4 == 0, "remote_as").when(k % 4 == 1, "interface").when(k % 4 == 2, "prefix").otherwise("other")
    number = F.when(n == 0, None).when(n == 1, "12x").when(n == 2, "4294967296").when(n == 3, "100").when(n == 4, "200").otherwise("300")
    violation = policy.case_violation(
        template, F.when(k % 11 == 0, "").otherwise("n1"), F.when(k % 11 == 1, "n2").when(k % 11 == 0, "").otherwise("n1"), number, F.lit(100), F.when(k % 11 == 2, None).otherwise(F.lit(200)),
        F.when(n > 15, "lo").otherwise(F.concat(F.lit("eth"), n)), F.when(n > 15, "10.0.0.0").when(n > 5, "10.0.1.0/24").otherwise("10.0.0.0/24"), F.lit("10.0.0.0/24"),
    )
    return table(spark, d, "customer").select("c_custkey", violation.alias("violation"))


@query("""SELECT n_nationkey AS case_id, CASE WHEN n_nationkey % 5 = 0 THEN 'session_unknown' WHEN n_nationkey % 5 = 1 THEN 'target_is_no_end' WHEN n_regionkey = 4 THEN 'no_link_faces_the_peer' END AS rule,
  CASE WHEN n_nationkey % 5 > 1 THEN 100 + n_regionkey END AS peer_asn, CASE WHEN n_nationkey % 5 > 1 AND n_regionkey < 4 THEN 'eth' || n_regionkey END AS interface FROM nation""")
def case_endpoints(spark, d):
    """A hub with a session to each region's node and a link to the first four."""
    r = F.col("r_regionkey")
    region = table(spark, d, "region")
    ip = lambda n: F.concat(F.lit("10.0."), r, F.lit(f".{n}/30"))
    ends = lambda *a: region.select(*(x.alias(n) for x, n in zip(a, ("session", "side", "node", "asn", "ip"), strict=True)))
    name = F.concat(F.lit("s"), r)
    sessions = ends(name, F.lit("a"), F.lit("hub"), F.lit(99).cast("bigint"), ip(1)).unionByName(ends(name, F.lit("b"), F.concat(F.lit("r"), r), (r + 100).cast("bigint"), ip(2)))
    few = region.filter(r < 4)
    links = few.select(r.alias("link"), F.lit("a").alias("side"), F.lit("hub").alias("node"), F.concat(F.lit("eth"), r).alias("iface"), ip(1).alias("ip")).unionByName(few.select(r.alias("link"), F.lit("b").alias("side"), F.concat(F.lit("r"), r).alias("node"), F.lit("eth0").alias("iface"), ip(2).alias("ip")))
    k = F.col("n_nationkey")
    cases = table(spark, d, "nation").select(k.alias("case_id"), F.when(k % 5 == 1, "nobody").otherwise("hub").alias("target"), F.when(k % 5 == 0, "s99").otherwise(F.concat(F.lit("s"), "n_regionkey")).alias("session"))
    return policy.session_endpoints(cases, sessions, links).select("case_id", "rule", F.col("peer_asn").cast("int").alias("peer_asn"), "interface")


@query("""SELECT c_custkey AS plan, f AS field, CASE f WHEN 'segment' THEN true WHEN 'nation' THEN c_custkey % 7 <> 0 ELSE c_custkey % 5 <> 0 END AS equal FROM customer, (VALUES ('segment'), ('nation'), ('balance')) t(f)""")
def plan_fields(spark, d):
    """Field by field, recorded plans of all customers against what was planned."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").cast("string").alias("balance"))
    run = base.withColumns({"nation": F.when(F.col("plan") % 7 == 0, "x").otherwise(F.col("nation")), "balance": F.when(F.col("plan") % 5 == 0, None).otherwise(F.col("balance"))})
    long = lambda df, name: df.unpivot(["plan"], ["segment", "nation", "balance"], "field", name)
    return long(base, "base").join(long(run, "run"), ["plan", "field"]).select("plan", "field", F.col("base").eqNullSafe(F.col("run")).alias("equal"))


_REPLAY = """b AS (SELECT o_orderkey AS plan_id, l_linenumber AS batch FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT plan_id, count(*)::INT AS batches FROM b GROUP BY 1), x AS (SELECT plan_id, batches, e AS epoch, k AS batch FROM n, range(1, 3) r(e), range(1, 200) s(k) WHERE k <= batches),
f AS (SELECT plan_id, epoch, batch, 'batch' AS event, 0 AS o FROM x UNION ALL SELECT plan_id, epoch, batch, 'step', 1 FROM x WHERE batch % 2 = 0 OR batch = batches UNION ALL SELECT plan_id, epoch, batch, 'epoch_end', 2 FROM x WHERE batch = batches UNION ALL SELECT plan_id, 0, 0, 'started', 0 FROM n UNION ALL SELECT plan_id, 2, batches, 'finished', 3 FROM n),
fr AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY epoch, batch, o) - 1 AS seq, epoch, batch, event FROM f)"""


@query(f"WITH {_REPLAY} SELECT plan_id, seq, event AS expected, CASE WHEN plan_id % 10 = 3 AND seq = 3 THEN 'forged' END AS recorded FROM fr WHERE (plan_id % 10 = 3 AND seq = 3) OR (plan_id % 10 = 4 AND seq = 2)")
def replay_of_orders(spark, d):
    """Every order is a plan whose batches are its lines; recorded logs are the expected ones with two kinds of damage."""
    plans = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.count(F.lit(1)).cast("int").alias("batches"))
    frames = eventlog.expected_frames(plans.select("plan_id", F.lit(2).alias("epochs"), "batches", F.lit(2).alias("accumulation")))
    damaged = frames.filter("not (plan_id % 10 = 4 and seq = 2)").withColumn("event", F.when((F.col("plan_id") % 10 == 3) & (F.col("seq") == 3), "forged").otherwise(F.col("event")))
    return eventlog.replay_differences(frames, damaged)


@query(f"WITH {_REPLAY} SELECT plan_id, seq, epoch, sum(CASE WHEN event = 'epoch_end' THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY seq)::BIGINT AS completed FROM fr QUALIFY event = 'step'")
def epochs_of_orders(spark, d):
    plans = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.count(F.lit(1)).cast("int").alias("batches"))
    return eventlog.epochs_completed(eventlog.expected_frames(plans.select("plan_id", F.lit(2).alias("epochs"), "batches", F.lit(2).alias("accumulation"))))


@query(f"""WITH {EX} SELECT 'unchanged' AS state, count(*) AS n FROM ex WHERE doc_id % 10 > 1 UNION ALL SELECT 'removed', count(*) FROM ex WHERE doc_id % 10 = 1 UNION ALL SELECT 'repartitioned', count(*) FROM ex WHERE doc_id % 10 = 2 AND partition <> 'test' UNION ALL SELECT 'added', count(*) FROM ex WHERE doc_id % 10 = 0""")
def append_only_faults(spark, d):
    """Version differences with rows planted for every state."""
    from ..operators import compare

    rows = examples(spark, d)
    old = rows.filter("doc_id % 10 <> 0")
    new = rows.filter("doc_id % 10 <> 1").withColumn("partition", F.when(F.col("doc_id") % 10 == 2, "test").otherwise(F.col("partition")))
    diff = compare.version_diff(old, new, "example_id", ["backend", "fault_family", "n_chars"], "partition")
    return diff.unpivot([], ["unchanged", "removed", "repartitioned", "added"], "state", "n")


@query("SELECT predictor, count(*) AS n FROM (SELECT unnest(['evidence_rule', 'fixed_prior', 'length_rule', 'responses']) AS predictor, doc_id FROM documents) WHERE doc_id % 25 = 4 GROUP BY 1")
def planted_recategorised(spark, d):
    """Stored categories that their own predictions don't give: planted for every 25th document."""
    rows = records(spark, d)
    bad = rows.withColumn("outcome_category", F.when(F.col("doc_id") % 25 == 4, "forged").otherwise(F.col("outcome_category")))
    return bad.filter(~evaluate.outcome_again(bad).eqNullSafe(F.col("outcome_category"))).groupBy("predictor").agg(F.count(F.lit(1)).alias("n"))


# --- versions, assignments, polling


@query(f"""WITH {EX}, a AS (SELECT * FROM ex WHERE doc_id % 10 = 0) SELECT count(*) FILTER (WHERE kind = 'accepted_fault') AS appended_accepted, count(*) FILTER (WHERE kind <> 'accepted_fault') AS appended_rejected, count(DISTINCT group_id) AS new_groups,
  count(DISTINCT CASE WHEN group_id IN (SELECT group_id FROM ex WHERE source = 'src1') THEN group_id END) AS collisions FROM a""")
def appended_groups(spark, d):
    from ..operators import compare

    rows = examples(spark, d)
    return compare.appended_groups(rows.filter("doc_id % 10 <> 0"), rows, rows.filter("scenario_id = 'src1'"))


@query(f"""WITH {EX} SELECT example_id, partition, CASE WHEN kind = 'abstention' THEN 'abstention-v1' ELSE 'assign-' || left(sha256('{{"example_id":"' || example_id || '","group_id":"' || group_id || '","salt":"gate6","train":8000,"validation":1000}}'), 16) END AS assignment_id FROM ex""")
def split_assignment_ids(spark, d):
    from .domain import POLICY, runs

    return dataset.assignments(dataset.identified(runs(spark, d)), POLICY).select("example_id", "partition", "assignment_id")


@query("""WITH o AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
  s AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY user_id, island, ok ORDER BY attempt) ELSE 0 END AS streak FROM o), c AS (SELECT user_id, min(CASE WHEN streak >= 6 AND attempt <= 12 THEN attempt END) AS confirmed_at, count(*) AS n FROM s GROUP BY 1)
  SELECT user_id, confirmed_at, least(coalesce(confirmed_at, n), 12) AS attempts, CASE WHEN confirmed_at IS NOT NULL THEN 'confirmed' WHEN n >= 12 THEN 'timed_out' ELSE 'unfinished' END AS outcome FROM c""")
def polling_outcomes(spark, d):
    return eventlog.polled(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error", 6, 12)


@query(f"""WITH {EX}, said AS (SELECT 'fixed_prior' AS predictor, example_id FROM ex WHERE doc_id % 30 = 7 UNION ALL SELECT 'responses', example_id FROM ex WHERE doc_id % 30 = 7) SELECT predictor, example_id FROM said""")
def prediction_ids_checked(spark, d):
    rows = records(spark, d).filter(F.col("predictor").isin("fixed_prior", "responses"))
    made = evaluate.prediction_id(F.col("prediction"), F.col("predictor"), F.col("example_id"))
    return evaluate.prediction_id_mismatches(rows.withColumn("prediction_id", F.when(F.col("doc_id") % 30 == 7, "pred-0").otherwise(made)))


@query("SELECT page_id, r NOT IN ('main', 'latest', '') AS immutable FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'latest' WHEN 2 THEN '' ELSE 'c0ffee' END AS r FROM pages)")
def revisions(spark, d):
    k = F.col("page_id") % 5
    name = F.when(k == 0, " Main").when(k == 1, "LATEST").when(k == 2, " ").otherwise("c0ffee")
    return table(spark, d, "pages").select("page_id", canonical.immutable_revision(name).alias("immutable"))


@query(f"WITH {_ASSESS} SELECT metric AS rule, passed, 'first' AS detail FROM a UNION ALL SELECT 'second_' || metric, passed, 'second' FROM a")
def merged_gates(spark, d):
    rows = coverage.assess(*_assessed(spark, d))
    first = rows.select(F.col("metric").alias("rule"), "passed", F.lit("first").alias("detail"))
    return coverage.merged_checks(first, rows.select(F.concat(F.lit("second_"), "metric").alias("rule"), "passed", F.lit("second").alias("detail")))


@query(f"""WITH {REC}, c AS (SELECT predictor, count(*) AS n, count(*) FILTER (WHERE correct) AS r FROM rec GROUP BY 1) SELECT predictor, r AS "right", {ratio_sql("r", "n")} AS overall_accuracy FROM c""")
def overall_metrics(spark, d):
    return evaluate.overall(records(spark, d)).select("predictor", "right", "overall_accuracy")


_COMMAND = "CASE WHEN doc_id % 2 = 0 THEN 'show ' ELSE '' END || text || CASE WHEN doc_id % 6 = 0 THEN ' no' WHEN doc_id % 10 = 0 THEN '; x' ELSE '' END"


@query(f"""WITH c AS (SELECT doc_id, {_COMMAND} AS cmd FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(lower(cmd), '[^a-z0-9_]+'), lambda x: x <> '') AS words FROM c)
  SELECT doc_id, CASE WHEN regexp_matches(cmd, '[|;&$><`]') THEN 'metacharacter' WHEN coalesce(words[1] <> 'show', true) THEN 'not_a_show_command' WHEN list_has_any(words, [{", ".join(map(repr, policy.FORBIDDEN_WORDS))}]) THEN 'forbidden_word' END AS violation FROM w""")
def command_texts(spark, d):
    """Every document's beginning as a command of the shell."""
    argv = F.array(F.lit("vtysh"), F.lit("-c"), F.expr(_COMMAND))
    return table(spark, d, "documents").select("doc_id", policy.read_command_violation(argv, ("vtysh", "ping")).alias("violation"))


@query(f"""WITH {REC}, c AS (SELECT count(*) AS total, count(DISTINCT group_id) AS groups FROM ex), r AS (SELECT count(*) AS total, count(DISTINCT group_id) + 1 AS groups FROM rec WHERE predictor = 'fixed_prior')
  SELECT 'report.total=corpus.total' AS rule, r.total = c.total AS passed FROM c, r UNION ALL SELECT 'report.groups=corpus.groups', r.groups = c.groups FROM c, r UNION ALL SELECT 'report.missing=corpus.total', false""")
def corpus_bindings(spark, d):
    """What a report says of its corpus, against the corpus."""
    corpus = examples(spark, d).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("group_id").alias("groups"))
    report = records(spark, d).filter("predictor = 'fixed_prior'").agg(F.count(F.lit(1)).alias("total"), (F.countDistinct("group_id") + 1).alias("groups"))
    return policy.binding_findings({"corpus": corpus, "report": report}, [("report", "total", "corpus", "total"), ("report", "groups", "corpus", "groups"), ("report", "missing", "corpus", "total")])


# --- streams, as batch over the same operators


@query("""WITH p AS (SELECT user_id AS command_id, ts AS asked FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts AS done FROM events WHERE event_type = 'click')
  SELECT command_id, asked::TIMESTAMP AS asked, done::TIMESTAMP AS done FROM p LEFT JOIN c ON command_id = user_id AND done >= asked AND done <= asked + INTERVAL 1 HOUR""")
def completed_pairs(spark, d):
    from ..streaming.logs import completed_pairs as pairs

    rows = table(spark, d, "events").select("event_type", F.col("user_id").alias("command_id"), F.col("ts").cast("timestamp").alias("ts"))
    found = pairs(rows.filter("event_type = 'view'"), rows.filter("event_type = 'click'"))
    return found.select("command_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("asked", "done")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value::DECIMAL(20,4))::DOUBLE AS total FROM events GROUP BY 1, 2")
def event_window_totals(spark, d):
    from ..streaming.logs import event_windows as windows

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query(f"""WITH {REC}, c AS (SELECT fault_family, count(*) AS n, count(*) FILTER (WHERE correct) AS r FROM rec WHERE predictor = 'length_rule' GROUP BY 1) SELECT fault_family, n, r AS "right", {ratio_sql("r", "n")} AS accuracy FROM c""")
def accuracy_by_family(spark, d):
    from ..operators import compare

    return compare.accuracy_by(records(spark, d).filter("predictor = 'length_rule'"), "fault_family")
