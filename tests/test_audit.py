import pytest
from pyspark.sql import functions as F

from veriloom.operators import audit as A
from veriloom.operators import compare, coverage
from veriloom.operators import dataset as D


@pytest.fixture(scope="module")
def clean(spark):
    rows = [(f"run-{i}", "accepted_fault" if i % 3 else "abstention", f"t{i % 4}", f"s{i % 5}", "topo", "b", "n1" if i % 2 else "n2", "", {"k": str(i % 3)}) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id string, kind string, template_id string, scenario_id string, topology_hash string, backend string, target_node string, target_session string, parameters map<string,string>")
    df = df.withColumn("parameters", F.map_concat("parameters", F.create_map(F.lit("kind"), "kind")))
    return D.assigned(D.identified(df), D.SplitPolicy("x")).cache()


def codes(df):
    return sorted(r["code"] for r in df.filter("severity = 'error'").collect())


def test_clean_corpus_passes(clean):
    findings = A.audit_leakage(clean)
    A.enforce(findings)
    assert {r["code"] for r in findings.collect()} <= {"orientation_siblings", "parameter_siblings"}


@pytest.mark.parametrize("column, value, expected", [
    ("partition", "abstention", {"accepted_among_abstentions", "accepted_not_trainable", "group_spans_partitions"}), ("group_id", "grp-1", {"group_id_mismatch"}),
    ("example_id", "ex-1", {"example_id_mismatch"}), ("partition", "elsewhere", {"accepted_not_trainable", "group_spans_partitions"}),
])
def test_one_changed_field(clean, column, value, expected):
    victim = clean.filter("kind = 'accepted_fault'").orderBy("run_id").first()["run_id"]
    bad = clean.withColumn(column, F.when(F.col("run_id") == victim, value).otherwise(F.col(column)))
    found = set(codes(A.audit_leakage(bad)))
    assert found <= expected and found & expected
    with pytest.raises(A.AuditFailure):
        A.enforce(A.audit_leakage(bad))


def test_repeated_row(clean):
    bad = clean.unionByName(clean.limit(1))
    assert codes(A.audit_leakage(bad)) == ["duplicate_example", "duplicate_run"]


def test_payload_walk(spark):
    rows = [(1, '{"a":{"b":{"group_id":3}},"dataset_x":1}'), (2, '{"a":"secret"}'), (3, "{}"), (4, None)]
    df = spark.createDataFrame(rows, "i int, p string").withColumn("s", F.array(F.lit("secret")))
    got = {(r["i"], r["rule"], r["path"]) for r in A.feature_payload_findings(df, "i", "p", "s").collect()}
    assert got == {(1, "forbidden_key", "a.b.group_id"), (1, "forbidden_prefix", "dataset_x"), (2, "forbidden_value", "a")}


def test_passages(spark):
    texts = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one two three"), (3, "prefixone two three four five six"), (4, "")], "i int, t string")
    passages = spark.createDataFrame([(10, "one two three four five six"), (11, "two three"), (12, "zzz")], "item int, p string")
    got = {tuple(r) for r in A.passages_inside(texts, "i", "t", passages, "item", "p").collect()}
    assert got == {(1, 10), (3, 10), (1, 11), (2, 11), (3, 11)}


def test_transcript(spark):
    df = spark.createDataFrame([(1, ["/usr/bin/env"]), (2, ["run", "TOKEN=abc"]), (3, ["show", "ip"])], "i int, argv array<string>")
    assert {tuple(r) for r in A.secret_arguments(df, "i", "argv").collect()} == {(1, "environment_dump"), (2, "credential")}


def test_layers(clean):
    layers = D.separate(clean.withColumns({"n_chars": F.lit(1), "onset_evidence": F.lit("x"), "fault_family": F.lit("f")}))
    assert "fault_family" not in layers["features"].columns and "run_id" not in layers["features"].columns
    whole, missing = D.rejoin(layers)
    assert whole.count() == clean.count() and missing.count() == 0


def test_version_diff_and_deltas(spark):
    old = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (3, "c", "train")], "k int, v string, p string")
    new = spark.createDataFrame([(1, "a", "train"), (2, "x", "test"), (4, "d", "train")], "k int, v string, p string")
    assert tuple(compare.version_diff(old, new, "k", ["v"], "p").first()) == (1, 1, 1, 1, 0, 1)
    counts = coverage.distributions(old, ["v", "p"])
    assert {tuple(r) for r in counts.collect()} == {("v", "a", 1), ("v", "b", 1), ("v", "c", 1), ("p", "train", 2), ("p", "test", 1)}
    assert {r["dimension"]: r["imbalance"] for r in coverage.imbalance(counts).collect()} == {"v": "1.000000", "p": "2.000000"}
