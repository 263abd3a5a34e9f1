"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text.  A new batch is reduced to one row per digest
(map-side combine, so a text that fills a third of the batch shrinks before it is shuffled), a sort-merge anti-join against the
index finds digests never seen before, and those are appended.  Only digests and ids travel; texts never do.

Defined results: null text equals empty text; rows that repeat a doc_id and text share one decision; among equal texts of one
batch the smallest doc_id stays, and nulls among ids lose to any id; a very long text is hashed whole and only its digest travels;
other columns, whatever their names, are kept as they are; an empty table gives an empty result and an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import SPACES, BucketedTable, StoreMeta, fresh_path, spare_names, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A persistent set of digests: ``digest, keep_id, batch``, in buckets, sorted by digest.

    ``path`` may hold an index of an earlier session; it opens with the bucket count that it was made with, which is kept beside it,
    whatever the session's shuffle setting is.  Appending is safe to repeat: the anti-join leaves out whatever an attempt that was
    cut short has written.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = StoreMeta(spark, self.path, buckets).buckets
        self.table = BucketedTable(spark, self.path, "digest", "digest BINARY, keep_id BIGINT, batch INT", self.buckets)

    def rows(self) -> DataFrame:
        return self.table.rows()

    def close(self) -> None:
        """Forget the table's name; the index's files stay."""
        self.table.close()

    def append_new(self, digests: DataFrame, batch: int) -> None:
        """Add the digests of ``digests(doc_id, digest)`` that the index lacks, each with its smallest doc_id."""
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        unseen = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        rows = written(unseen.withColumn("batch", F.lit(batch)), "digest-batch")
        self.table.append(rows.repartition(self.buckets, "digest"))


def dedup_with_index(digests: DataFrame, index: DigestIndex, batches: list[Column]) -> DataFrame:
    """Ingest ``digests(doc_id, digest)`` batch after batch and decide every row.

    ``batches`` are disjoint predicates that cover all rows, in order of arrival.  Returns the rows with ``keep_id``,
    ``group_size`` (rows of this call with that digest) and ``kept``.
    """
    for number, batch in enumerate(batches):
        index.append_new(digests.filter(batch), number)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = written(sizes.join(index.rows().select("digest", "keep_id").hint("merge"), "digest"), "digest-groups")
    # one row per digest meets the rows of that digest; the hot side is split by adaptive skew handling
    return digests.join(groups, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Documents arrive in two batches, lower ids first, so that the second is deduplicated against what the first left in the index.
    """
    index = index or DigestIndex(docs.sparkSession)
    digests = written(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    middle = digests.agg(F.expr("cast(min(doc_id) as bigint) div 2 + cast(max(doc_id) as bigint) div 2").alias("middle")).first()["middle"]  # a sum of ids may pass 64 bits
    first = F.col("doc_id") <= F.lit(middle if middle is not None else 0)
    batches = [F.coalesce(first, F.lit(False)), ~F.coalesce(first, F.lit(False))]
    return dedup_with_index(digests, index, batches).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns; a text repeated under one doc_id, or under none, stays once."""
    id_, digest_, copy = spare_names(docs, "id", "digest", "copy")
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    kept = exact_dedup(docs).filter("kept").select(known.alias(id_), F.unhex("text_sha256").alias(digest_)).distinct()
    # join and window have one key, so texts are shuffled once
    joined = docs.withColumns({id_: known, digest_: digest(F.col("text"))}).join(kept, [id_, digest_], "left_semi")
    one = Window.partitionBy(id_, digest_).orderBy(id_)
    return joined.withColumn(copy, F.row_number().over(one)).filter(F.col(copy) == 1).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
