"""Whether files are in order, without sorting them again.

A task reads its blocks of files as they lie and reports one row for each: first key, last key, and the first place where the order
breaks.  Only these rows, as many as there are blocks, are put in order of file and place to compare neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "file string, block bigint, rows bigint, first {0}, last {0}, nulls bigint, descents bigint, repeats bigint, at bigint"


def block_orders(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``file, block, rows, first, last, nulls, descents, repeats, at`` of every block of the Parquet files below ``path``: ``at`` is the
    first row within the block (from 0) that is below the one before."""
    rows = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_block_start", key)
    kind = rows.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def told(kind_: pa.DataType) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), kind_, kind_, *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now, types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, keys = batch.columns
            same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):  # noqa: B905
                name, start, all_ = file[low].as_py(), block[low].as_py(), keys[low:high]
                if now is None or now[:2] != [name, start]:
                    if now is not None:
                        yield told(keys.type)
                    now = [name, start, 0, None, None, 0, 0, 0, None]
                there = all_.drop_null()
                now[5] += len(all_) - len(there)
                if len(there):
                    line = there if now[4] is None else pa.concat_arrays([pa.array([now[4]], there.type), there])
                    below, equal = (f(line[1:], line[:-1]).to_numpy(zero_copy_only=False) for f in (pc.less, pc.equal))
                    if now[8] is None and below.any():
                        where = np.flatnonzero(all_.is_valid().to_numpy(zero_copy_only=False))
                        now[8] = now[2] + int(where[int(np.argmax(below)) + (0 if now[4] is not None else 1)])
                    now[6] += int(below.sum())
                    now[7] += int(equal.sum())
                    now[3], now[4] = there[0].as_py() if now[3] is None else now[3], there[-1].as_py()
                now[2] += len(all_)
        if now is not None:
            yield told(batch.columns[2].type)

    return rows.mapInArrow(run, BLOCKS.format(kind))


def order_faults(blocks: DataFrame, unique: bool = False) -> DataFrame:
    """``file, block, fault, detail`` of ``block_orders``: null keys, descents within a block, and a block that begins below (or, where
    keys are ``unique``, at) the last key of those before it; repeated keys are faults only then."""
    before = F.max("last").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    seen = blocks.withColumn("before", before)
    over = F.col("first") <= F.col("before") if unique else F.col("first") < F.col("before")
    faults = F.array_compact(F.array(
        F.when(F.col("nulls") > 0, F.struct(F.lit("null_key").alias("fault"), F.col("nulls").cast("string").alias("detail"))),
        F.when(F.col("descents") > 0, F.struct(F.lit("descent").alias("fault"), F.col("at").cast("string").alias("detail"))),
        F.when(F.lit(unique) & (F.col("repeats") > 0), F.struct(F.lit("repeated").alias("fault"), F.col("repeats").cast("string").alias("detail"))),
        F.when(over, F.struct(F.lit("out_of_place").alias("fault"), F.concat_ws(" after ", F.col("first").cast("string"), F.col("before").cast("string")).alias("detail"))),
    ))
    return seen.select("file", "block", F.explode(faults).alias("f")).select("file", "block", "f.*")
