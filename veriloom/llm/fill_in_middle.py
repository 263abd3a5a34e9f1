"""Fill-in-middle transformation, by DuckDB inside ``mapInArrow``.

Each Arrow batch is registered with a DuckDB connection of the task and transformed there by one SQL statement: a text is cut into
units, two cut points come from a digest of the document's id, and prefix, middle and suffix are put together again in one of two
orders.  No row is touched in Python, nothing is shuffled, and a task that is run again gives the same rows.

Defined results: null text is empty; an empty text, or one that contains a marker, stays as it is (form ``plain``); a null id has
the digest of the seed alone, and rows that repeat an id and text repeat the result; a very long text is cut whole (a batch is
bounded by bytes, so it is alone in its batch); columns of the input, whatever their names, are kept where ``fill_in_middle`` is
used (its own columns are told apart by leading underscores if a name is taken); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, spare_names

#: A unit of a text: a line with its line feed.
LINES = r"[^\n]*\n|[^\n]+"
#: What a task's DuckDB may use.
MEMORY = "1GB"


@dataclass(frozen=True)
class Rates:
    """How texts are cut: the seed, percent of texts that are transformed, percent of those whose suffix comes first."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50
    unit: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(rates: Rates, table: str) -> str:
    """DuckDB SQL: ``n, form, prefix, middle, suffix, output`` beside the columns ``id`` and ``text`` of a table."""
    p, s, m = map(literal, (rates.prefix, rates.suffix, rates.middle))
    draws = ", ".join(f"('0x' || substr(digest, {1 + 8 * i}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH texts AS (
  SELECT * REPLACE (coalesce(text, '') AS text), sha256('{rates.seed}:' || coalesce(id::VARCHAR, '')) AS digest FROM {table}
), units AS (
  SELECT *, {draws}, regexp_extract_all(text, {literal(rates.unit)}) AS units FROM texts
), cuts AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS high,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {rates.transformed} THEN 'plain'
      WHEN h4 % 100 < {rates.suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT * EXCLUDE (units), array_to_string(list_slice(units, 1, low), '') AS prefix, array_to_string(list_slice(units, low + 1, high), '') AS middle,
    array_to_string(list_slice(units, high + 1, n), '') AS suffix
  FROM cuts
)
SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
FROM parts"""


def restore_sql(rates: Rates, table: str) -> str:
    """DuckDB SQL: ``restored``, the text rebuilt from ``form`` and ``output`` alone, beside the other columns of a table."""
    p, s, m = map(literal, (rates.prefix, rates.suffix, rates.middle))
    np, ns, nm = (len(x) for x in (rates.prefix, rates.suffix, rates.middle))
    return f"""
SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN substr(output, {np} + 1, strpos(output, {s}) - {np} - 1) || substr(output, strpos(output, {m}) + {nm}) || substr(output, strpos(output, {s}) + {ns}, strpos(output, {m}) - strpos(output, {s}) - {ns})
  ELSE substr(output, strpos(output, {p}) + {np}, strpos(output, {m}) - strpos(output, {p}) - {np}) || substr(output, strpos(output, {m}) + {nm}) || substr(output, {ns} + 1, strpos(output, {p}) - {ns} - 1) END AS restored
FROM ({table})"""


def report_sql(rates: Rates, table: str) -> str:
    """DuckDB SQL: the digest of the transformation, a row for each row of a table with ``id`` and ``text``."""
    return f"""
SELECT id AS doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM ({restore_sql(rates, transform_sql(rates, table))})"""


def in_duckdb(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run one SELECT over the table ``batch`` on each Arrow batch of the rows."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:  # it never spills to a folder of its own
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """The documents with ``n, form, prefix_chars, middle_chars, output``: units, form, and the transformed text."""
    names = spare_names(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", F.struct(*docs.columns).alias("others"))
    sql = f"""SELECT others, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, output
FROM ({transform_sql(rates, "batch")})"""
    kinds = f"others {rows.schema['others'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    made = in_duckdb(rows, sql, kinds)
    return made.select("others.*", *(F.col(own).alias(name) for own, name in zip(("n", "form", "prefix_chars", "middle_chars", "output"), names, strict=True)))


def fim_report(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, texts not returned."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return in_duckdb(rows, report_sql(rates, "batch"), "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


#: The contract's result from the texts alone, written without the operator's statements.
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM t
), c AS (
  SELECT *, len(u) AS n, (('0x' || h[1:8])::BIGINT % (len(u) + 1)) AS x, (('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS y, ('0x' || h[25:32])::BIGINT % 100 AS z FROM u
), f AS (
  SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""
