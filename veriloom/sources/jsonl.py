"""Strict JSON lines, logs with a torn tail, and binary headers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class FormatError(ValueError):
    pass


def read_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines by a fixed schema: a malformed line fails the query, nothing is coerced or inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def framing_findings(spark: SparkSession, path: str) -> DataFrame:
    """Files that don't end in one line feed or have blank lines: ``path, rule``.

    Whole files are read, as the artifacts of an export are small; large tables are Parquet.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    rules = F.array_compact(F.array(
        F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), F.lit("no_final_line_feed")),
        F.when(F.col("text").rlike(r"(^|\n)[\t \r]*\n"), F.lit("blank_line")),
    ))
    return files.select("path", F.explode(rules).alias("rule"))


def read_torn_log(lines: DataFrame, stream: str, position: str, line: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of an append-only log, and findings.

    A crash can tear the last line of a stream: it is left out.  A bad line before the last is a finding.
    """
    parsed = lines.withColumn("__row", F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"})).withColumn("__bad", F.try_parse_json(line).isNull())
    last = F.max(position).over(Window.partitionBy(stream))
    parsed = parsed.withColumn("__last", F.col(position) == last)
    findings = parsed.filter("__bad and not __last").select(stream, position, F.lit("torn_before_end").alias("rule"))
    return parsed.filter("not __bad").select(stream, position, "__row.*"), findings


def tensor_headers(files: DataFrame) -> DataFrame:
    """``path, tensor, dtype, shape, parameters`` of ``files(path, content)``: an 8-byte little-endian length, then a JSON header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = content.as_buffer()
                n = int.from_bytes(view[:8].to_pybytes(), "little")
                if not 2 <= n <= view.size - 8:
                    raise FormatError(f"{path}: header of {n} bytes in a file of {view.size}")
                for name, tensor in json.loads(view[8 : 8 + n].to_pybytes()).items():
                    if name != "__metadata__":
                        count = 1
                        for side in tensor["shape"]:
                            count *= side
                        rows.append((path, name, tensor["dtype"], tensor["shape"], count))
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "tensor", "dtype", "shape", "parameters"])

    return files.select("path", "content").mapInArrow(run, "path string, tensor string, dtype string, shape array<bigint>, parameters bigint")
