import hashlib
import re

import pytest

from veriloom.llm import fill_in_middle as fim

TEXTS = ["", None, "\n", "one", "one\n", "a\nb\nc", "\n\n\nx\n\n", "has <P> inside", "ends with <\n<S", "<M>", "é日😀\n\r\nz\x00y\n", "line\n" * 5000, "w" * 200_000 + "\nlast", "same\ntext\n", "same\ntext\n", "it's\n'quoted'\n"]
SCHEMA = "doc_id bigint, text string, form string, N int"


def expected(doc_id, text, rates):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in (rates.prefix, rates.suffix, rates.middle)) or h3 % 100 >= rates.transformed:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < rates.suffix_first:
        return doc_id, len(units), "spm", len(p), len(m), rates.suffix + s + rates.prefix + p + rates.middle + m
    return doc_id, len(units), "psm", len(p), len(m), rates.prefix + p + rates.suffix + s + rates.middle + m


def frame(spark):
    rows = [(i * 3, x, "f", i) for i, x in enumerate(TEXTS)] + [(None, "a\nb\nc\n", "f", 1), (3, "", "f", 2), (-5, "a\nb\n", "f", 2), (2**63 - 1, "a\nb\n", "f", 2)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("rates", [fim.Rates(), fim.Rates(seed=1, transformed=50, suffix_first=0), fim.Rates(suffix_first=100, prefix="<|it's|>", suffix="<|s|>", middle="<|m|>")])
def test_texts_against_loops(spark, rates):
    rows, docs = frame(spark)
    got = fim.fill_in_middle(docs, rates)
    assert got.columns == ["doc_id", "text", "form", "N", "_n", "_form", "prefix_chars", "middle_chars", "output"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    want = sorted(((i, t, f, n, *expected(i, t, rates)[1:]) for i, t, f, n in rows), key=repr)
    assert found == want


def test_report_and_round_trip(spark):
    rows, docs = frame(spark)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for rates in (fim.Rates(), fim.Rates(suffix_first=100)):
        found = sorted((tuple(r) for r in fim.fim_report(docs, rates).collect()), key=repr)
        want = sorted(((*(e := expected(i, t, rates))[:5], sha(e[5]), sha(t or "")) for i, t, _, _ in rows), key=repr)
        assert found == want


def test_restoring_reads_output_and_form_only(spark):
    import duckdb

    rates = fim.Rates()
    with duckdb.connect() as con:
        con.execute("CREATE TABLE made AS SELECT * FROM (VALUES ('psm', '<P>ab<S>ef<M>cd'), ('spm', '<S>ef<P>ab<M>cd'), ('psm', '<P><S><M>'), ('plain', '<M>x'), ('psm', '<P>a<<S>b<S<M><P')) t(form, output)")
        assert [r[0] for r in con.execute(f"SELECT restored FROM ({fim.restore_sql(rates, 'FROM made')})").fetchall()] == ["abcdef", "abcdef", "", "<M>x", "a<<Pb<S"]


def test_nothing_is_shuffled_and_empty_tables(spark):
    plan = fim.fim_report(spark.createDataFrame([], SCHEMA))
    assert plan.collect() == [] and plan.columns[0] == "doc_id"
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    assert "Exchange" not in fim.fim_report(spark.range(3).selectExpr("id AS doc_id", "'a' AS text"))._jdf.queryExecution().executedPlan().toString()
