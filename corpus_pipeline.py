"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes the documents that its predecessor kept.  All but the last return the columns of ``documents``; the last returns
where each piece of each document goes.  A stage's result is written to the shared folder and read again by the next one.

Every stage tells rows apart by id and text, so rows without an id, or with one id and several texts, are documents of their own;
null and empty texts have no letter and leave at the first stage; very long texts are handled whole; columns of any name are kept; an
empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import exact_dedup, language_id, mixing, packing, simhash
from veriloom.llm.storage import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds 40 % of their letters, go."""
    return language_id.keep_identified(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the smallest doc_id stays."""
    return exact_dedup.keep_first_copies(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, directly or through others, the smallest doc_id stays; of
    several rows with that id and text all stay."""
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's target has them; a second pass over a source repeats doc_ids."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix cut into pieces, and the sequence and offset of each."""
    return packing.packing_digest(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", first_copies),
    ("simhash_near_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Models, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
