"""Queries over planted rows against their SQL, and the operators behind them on small cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veriloom.operators import audit, matcher, coverage, eventlog, select
from veriloom.plans import integrity, registry
from veriloom.sources import runs, store

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in registry.QUERIES.items() if f.__module__ == integrity.__name__] + [
    "claim_verdicts", "feature_payload_audit", "heldout_id_firewall", "heldout_firewall", "partition_digest", "export_digest", "sibling_members", "quality_checks", "chain_build", "identity_first_plan", "structured_output_report",
]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(int(value)) if isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, tables, name):
    found = registry.QUERIES[name](spark, SF)
    want = tables.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in found.collect())
    assert rows == sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in want.fetchall())


def test_tokens_inside_words_are_found(spark):
    payloads = spark.createDataFrame([(1, "see ex-abcdef"), (2, "run-2024-01_x"), (3, "case_7"), (4, "ex-abc"), (5, "ex-ab"), (6, None), (7, "")], "i int, t string")
    held = spark.createDataFrame([("ex-abc",), ("run-2024-01",), ("case_",), ("",), (None,)], "token string")
    got = {tuple(r) for r in audit.firewall(payloads, "i", "t", held, "token").collect()}
    assert got == {(1, "ex-abc"), (2, "run-2024-01"), (3, "case_"), (4, "ex-abc")}
    assert audit.firewall(payloads, "i", "t", held.limit(0), "token").count() == 0


def test_payloads_are_walked_to_any_depth(spark):
    deep = '{"a":' * 40 + '{"split":1}' + "}" * 40
    rows = [(1, deep), (2, '[[["secret"]]]'), (3, '{"a":[{"run_id":1}]}'), (4, '"secret"'), (5, "{"), (6, "[" * 100_000), (None, '{"kind":1}')]
    df = spark.createDataFrame(rows, "i int, p string").withColumn("s", F.array(F.lit("secret")))
    got = {(r["i"], r["rule"], r["path"][-12:]) for r in audit.feature_payload_findings(df, "i", "p", "s").collect()}
    assert got == {(1, "forbidden_key", ".a.a.a.split"), (2, "forbidden_value", "[0][0][0]"), (3, "forbidden_key", "a[0].run_id"), (4, "forbidden_value", ""), (5, "unreadable", ""), (6, "unreadable", ""), (None, "forbidden_key", "kind")}


@pytest.mark.parametrize("few", [200_000, 0])
def test_passages_joined_or_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(matcher, "FEW_TOKENS", few)
    common = "the common words that all of them have"
    texts = spark.createDataFrame([(1, f"x {common} alpha beta gamma delta end"), (None, f"y {common} one two three four end"), (None, f"z {common} nothing"), (4, ""), (5, None)], "i int, t string")
    passages = spark.createDataFrame([(10, f"{common} alpha beta gamma"), (11, f"{common} one two three"), (12, "not there at all in any text here"), (13, "delta"), (14, "")], "item int, p string")
    got = sorted(map(str, (tuple(r) for r in audit.passages_inside(texts, "i", "t", passages, "item", "p").collect())))
    assert got == ["(1, 10)", "(1, 13)", "(None, 11)"]


@pytest.mark.parametrize("argv, rules", [
    (["sh", "/bin/export"], {"environment_dump"}), (["--token", "x"], {"credential"}), (["MY_passwd_FILE"], {"credential"}), (["private_key.pem"], {"credential"}), (["show", "settings"], set()), ([], set()),
])
def test_credentials_in_any_form(spark, argv, rules):
    df = spark.createDataFrame([(1, argv)], "i int, argv array<string>")
    assert {r["rule"] for r in audit.secret_arguments(df, "i", "argv").collect()} == rules


def test_disorder_is_seen_by_position(spark):
    log = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("b", 1, 5), ("b", 2, 4), ("b", 3, None)], "s string, p int, n int")
    got = {(r["s"], r["position"], r["fault"]) for r in eventlog.sequence_faults(log, "s", "p", "n").collect()}
    assert got == {("a", 1, "below_one"), ("b", 2, "decreasing"), ("b", 3, "below_one")}


def test_an_expansion_with_unmet_targets_is_refused(spark):
    assessed = spark.createDataFrame([("a", True, True), ("b", False, False)], "metric string, mandatory boolean, passed boolean")
    parent, policy = {"id": "c", "digest": "d"}, {"id": "p", "source_id": "c", "source_digest": "d"}
    assert coverage.bind_expansion(assessed, parent, policy).count() == 1
    with pytest.raises(coverage.TargetsUnmet):
        coverage.bind_expansion(assessed.withColumn("mandatory", F.lit(True)), parent, policy)
    with pytest.raises(coverage.TargetsUnmet):
        coverage.bind_expansion(assessed, parent, policy | {"source_digest": "e"})


def test_runs_that_do_not_verify_are_refused(spark):
    files = spark.createDataFrame([("r1", "a", b"x"), ("r2", "a", b"y"), ("r2", ".INCOMPLETE", b"")], "run_id string, path string, content binary")
    index = files.filter("path = 'a'").select("run_id", "path", F.sha2("content", 256).alias("sha256"), F.lit(1).alias("schema_version"))
    assert [tuple(r) for r in runs.load_run(index, files, "r1").collect()] == [("a", "x")]
    for bad in ("r2", "r3"):
        with pytest.raises(store.ArtifactError):
            runs.load_run(index, files, bad)
    assert {r["run_id"] for r in runs.verified_runs(index, files).collect()} == {"r1"}


def test_listing_passes_over_what_does_not_verify(spark, tmp_path):
    home = store.ArtifactStore(spark, str(tmp_path))
    for name in ("a2", "a1"):
        home.write(name, {"t": spark.range(3)})
    registered = spark.createDataFrame([("a2", 2), ("a1", 1), ("a0", 0)], "artifact string, version int")
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/a2/t")
    assert [r["artifact"] for r in home.listing(registered, ["version"]).collect()] == ["a1"]


def test_large_exports_have_no_bytes_digest(spark, monkeypatch):
    monkeypatch.setattr(store, "EXPORT_LINES", 5)
    rows = spark.range(6).withColumn("g", F.col("id") % 2)
    assert store.ordered_digest(rows, "id", F.col("id").cast("string"), "g").count() == 2
    with pytest.raises(store.ArtifactError):
        store.ordered_digest(rows, "id", F.col("id").cast("string"))
    digest = {r["g"]: r["digest"] for r in store.table_digest(rows, "g").collect()}
    assert digest[0] == store.table_digest(rows.filter("g = 0").drop("g")).first()["digest"]


def test_selection_errors_are_no_missing_rows(spark):
    eligible = spark.createDataFrame([("e1", "f"), ("e2", "f"), ("e3", "g")], "example_id string, fault_family string")
    chosen = spark.createDataFrame([("e1", "f"), ("e2", "x"), ("e3", "g"), ("e3", "g"), ("e4", "f")], "example_id string, fault_family string")
    good, findings = select.selected_examples(chosen, eligible)
    assert [r["example_id"] for r in good.collect()] == ["e1"]
    assert {tuple(r) for r in findings.collect()} == {("e2", "family_differs"), ("e3", "selected_twice"), ("e4", "not_eligible")}
