import itertools

import pytest
from pyspark.sql import functions as F

from veriloom.functions import responses as R
from veriloom.operators import compare as C
from veriloom.operators import evaluate as E

FAMILIES = ("fam_a", "fam_b")


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(f"ex-{i}", "accepted_fault" if i < 8 else "abstention", FAMILIES[i % 2] if i < 8 else None, ["train", "validation", "test"][i % 3] if i < 8 else "abstention", "onset" if i < 8 else None) for i in range(12)]
    return spark.createDataFrame(rows, "example_id string, kind string, fault_family string, partition string, onset_evidence string")


CASES = [
    ('{"prediction_type":"diagnosis","fault_family":" FAM_A "}', "diagnosis", None, "compliant"), ('{"prediction_type":"abstention"}', "abstention", "model_abstained", "compliant"),
    ('{"prediction_type":"diagnosis","fault_family":"x"}', "invalid", "unknown_fault_family", "out_of_schema_value"), ('{"prediction_type":"diagnosis","fault_family":3}', "invalid", "missing_fault_family", "missing_required_field"),
    ('{"prediction_type":"diagnosis"}', "invalid", "missing_fault_family", "missing_required_field"), ('{"a":1}', "invalid", "unsupported_prediction_type", "unsupported_prediction_type"),
    ("[1]", "invalid", "not_an_object", "non_object_json"), ('{"a":1} x', "invalid", "malformed_json", "malformed_other"), ('{"a":1}{"b":2}', "invalid", "malformed_json", "malformed_other"),
    ('{"a":', "invalid", "malformed_json", "truncated_json"), ("ababababababababab", "invalid", "malformed_json", "degenerate_repetition"), ("here: {}", "invalid", "malformed_json", "prose_wrapped_json"),
    ("  ", "invalid", "malformed_json", "empty_output"), ("nope", "invalid", "malformed_json", "malformed_other"), (None, "invalid", "malformed_json", "empty_output"),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").withColumn("p", R.parse_response(F.col("t"), FAMILIES))
    df = df.withColumns({"c": R.invalid_category(F.col("p.reason"), F.col("p.excerpt")), "s": R.response_schema(F.col("t"), FAMILIES)})
    for r in df.collect():
        text, outcome, reason, category = CASES[r["i"]]
        assert (r["p"]["outcome"], r["p"]["reason"]) == (outcome, reason), text
        assert r["s"]["compliant"] == (outcome != "invalid"), text
        if outcome == "invalid":
            assert r["c"] == category, text


def test_metrics_and_ranking(examples):
    rows = E.score(E.predict_all(examples, {"fixed": E.fixed_prior("FAM_A"), "rule": E.evidence_rule("fam_a"), "shy": E.abstention("always")}))
    table = {r["predictor"]: r for r in E.comparison(rows).collect()}
    assert (table["fixed"]["accuracy"], table["fixed"]["abstention_accuracy"]) == ("0.500000", "0.000000")
    assert [r["predictor"] for r in E.ranking(E.comparison(rows)).orderBy("place").collect()] == ["rule", "fixed", "shy"]
    assert rows.filter(~E.outcome_again(rows).eqNullSafe(F.col("outcome_category"))).count() == 0
    assert E.audit_metrics(E.comparison(rows), rows).count() == 0
    assert {r["predicted"] for r in E.confusion(rows).filter("predictor = 'shy'").collect()} == {"<abstain>"}


def test_ratio_of_nothing_ranks_lowest(spark):
    rows = spark.createDataFrame([("a", None, None, 0), ("b", "0.000000", None, 5)], "predictor string, accuracy string, abstention_accuracy string, invalid_count int")
    assert [r["predictor"] for r in E.ranking(rows).orderBy("place").collect()] == ["b", "a"]


def test_backend_failures_are_rows(examples):
    def broken():
        def answer(frame):
            assert list(frame.columns) == ["onset_evidence"]
            raise ValueError("no")
        return answer

    assert {r["failure"] for r in E.predict_with(examples, broken, ("onset_evidence",)).collect()} == {"backend_ValueError"}
    assert E.predict_with(examples, lambda: lambda f: ["x"] * len(f), ("onset_evidence",)).filter("response = 'x'").count() == 12


def test_transitions_and_alignment(examples):
    run = lambda p: E.score(E.predict_all(examples, {"x": p}))
    base, trained = run(E.fixed_prior("fam_a")), run(E.evidence_rule("fam_b"))
    pairs, bad = C.paired(base, trained)
    assert bad.count() == 0
    counts = C.paired_counts(C.transitions(pairs)).first()
    assert (counts["total"], counts["improved"], counts["regressed"]) == (12, 8, 4)
    assert C.paired(base, trained.limit(11))[1].count() == 1


def test_verdict_is_total(spark):
    names = ["trained_correct", "trained_invalid", "trained_abstained", "wins"]
    rows = [(*v, 5, 1, 1, 1, 10) for v in itertools.product((0, 1, 2), repeat=4)]
    df = spark.createDataFrame(rows, [*names, "base_correct0", "base_invalid", "base_abstained", "losses", "test_evaluated"]).withColumn("base_correct", F.lit(1))
    for r in C.experiment_outcome(df, F.lit(True), 5, 0).collect():
        d = {n: (r[n] > 1) - (r[n] < 1) for n in names}
        up = d["trained_correct"] > 0 and d["wins"] > 0 and d["trained_invalid"] <= 0 and d["trained_abstained"] >= 0
        worse = d["trained_correct"] < 0 or d["trained_invalid"] > 0 or d["trained_abstained"] < 0 or d["wins"] < 0
        better = d["trained_correct"] > 0 or d["trained_invalid"] < 0 or d["trained_abstained"] > 0 or d["wins"] > 0
        assert r["verdict"] == ("improved" if up else "mixed" if worse and better else "regressed" if worse else "mixed" if better else "unchanged")
    assert {r["verdict"] for r in C.experiment_outcome(df, F.lit(False), 5, 0).collect()} == {"experiment_failed"}
    assert {r["verdict"] for r in C.experiment_outcome(df, F.lit(True), 50, 0).collect()} == {"inconclusive"}
