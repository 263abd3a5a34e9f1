"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in the order of a hash of their ids, are one stream of words that is packed into blocks of
``BLOCK_WORDS``.  The mix is a list of output shards of ``SHARD_SLOTS`` block slots.  For every shard the numbers of slots by
source are a multinomial draw; the totals are then set right (slots that a source drew beyond its target go to sources that
drew too few), so each source gives exactly its target.  The j-th slot of a source takes block ``permutation(j)``; the
pseudorandom permutation of block indices is a swap-or-not network, which is a bijection for any number of blocks, with other
keys in each pass over the source.  Slots and blocks meet in an equi-join on (source, block index).

Slots are made where they are needed: the counts by shard and source are cut into ranges of at most ``RANGE_SLOTS`` slots, the
ranges are dealt over all tasks, and only then is a range expanded, so a source with nine tenths of the mix is spread like any other.

Streams are summed up in two steps (4096 hash ranges of a source, then rows within one), so a source with a third of all rows
is spread over as many tasks as any other; the order doesn't depend on the number of partitions.

Targets: weights 3, 1, 2 repeat over the sources by code point, null last; they share 150 % of all words, a target stops at twice
its source, and what is above is shared again by weight.

Bounds: the tables with one row per source (targets, quotas, spans) are sorted in one task, so sources are to be few (up to some
millions); a source has one row per shard in one task, a 65,536th of its slots at most.

Defined results: null and empty text have size 0 and give nothing; null is a source of its own; repeated rows are documents of
their own (those equal in id, text and source meet in one task, which spills); a null doc_id takes its place by its text; a very
long text is split over as many blocks as it needs; columns of any name are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import WORD, shuffle_partitions, spare_names, written

BLOCK_WORDS = 256
SHARD_SLOTS = 65_536
#: Slots that one row is expanded into, and that a task holds on average at most.
RANGE_SLOTS, TASK_SLOTS = 256, 2_000_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROUNDS = 12
SEED = 20_240_229
RANGES_BITS = 12
#: Cells into which the range of a draw is cut, so that finding its source is an equi-join.
CELLS = 4096
NO_ID = (1 << 63) - 1


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(text).alias("text_hash"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``s`` (its number by code point), ``source, source_size, weight, target``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("s"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = totals.withColumn("s", (F.row_number().over(by_name) - 1).cast("bigint")).withColumn("weight", weight.cast("bigint"))
    # sources by the level at which they are full; below the water line all are full, above it they share by weight
    by_level = Window.orderBy(F.lit(MOST) * F.col("source_size") / F.col("weight"), "s")
    rows = rows.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("full", F.lit(MOST) * (F.sum("source_size").over(by_level) - F.col("source_size")))
    rows = rows.withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(by_level) + F.col("weight"))
    room = F.lit(SHARE) * F.col("all") - F.col("full")
    fits = room * F.col("weight") <= F.lit(float(MOST)) * F.col("source_size") * F.col("open")
    first = F.min(F.when(fits, F.struct((F.lit(MOST) * F.col("source_size") / F.col("weight")).alias("level"), "s", room.alias("room"), "open")))
    rows = rows.withColumn("line", first.over(Window.partitionBy()))
    share = F.col("line.room") * F.col("weight") / F.col("line.open")
    return rows.select("s", "source", "source_size", "weight", F.least(F.lit(float(MOST)) * F.col("source_size"), share).alias("target"))


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Place of ``index`` in the pseudorandom permutation of 0..n-1 that ``key`` names (a swap-or-not network)."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r.cast("bigint")), n) - x, n)
        return F.when(F.xxhash64(key, r.cast("bigint"), F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(rounds, index.cast("bigint"), step)


def pass_key(source: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED).cast("bigint"), source, epoch.cast("bigint"))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks and slots of each source: ``n`` blocks, the last of ``tail`` words; ``passes`` whole passes and ``rest`` words of one
    more, in ``slots`` slots; ``tail_at`` is where the last block comes in that pass."""
    b = F.lit(block_words).cast("bigint")
    rows = sources.filter("source_size > 0").withColumn("n", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    rows = rows.withColumn("words", F.round("target").cast("bigint")).withColumn("tail", F.col("source_size") - (F.col("n") - 1) * b)
    rows = rows.withColumn("passes", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size"))
    rows = rows.withColumn("tail_at", permuted(F.col("n") - 1, F.col("n"), pass_key(F.col("s"), F.col("passes")), inverse=True))
    rows = rows.withColumn("m", F.expr(f"(rest + {block_words - 1}) div {block_words}"))
    short = (F.col("tail_at") < F.col("m")) & (F.col("m") * b - (b - F.col("tail")) < F.col("rest"))
    return rows.withColumn("slots", F.col("passes") * F.col("n") + F.col("m") + short.cast("bigint")).drop("m", "words")


def draw(quota: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, s, j``: every slot of the mix; a source's slots are numbered from 0 to its number of slots."""
    spark = quota.sparkSession
    spans = quota.select("s", "slots", (F.sum("slots").over(Window.orderBy("s")) - F.col("slots")).alias("low")).withColumn("high", F.col("low") + F.col("slots"))
    spans = written(spans.filter("slots > 0"), "mix-spans")
    total = spans.agg(F.max("high").alias("n")).first()["n"] or 0
    width = max(1, -(-total // CELLS))
    cells = spans.select("s", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("cell"))
    # multinomial: each slot of a shard draws a source with probability in proportion to its slots; only counts are kept
    drawn = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 1).cast("bigint"), "id"), F.lit(max(total, 1))).alias("u"))
    drawn = drawn.withColumn("cell", F.expr(f"u div {width}")).join(cells, "cell").filter("u >= low and u < high")
    counts = written(drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("k")), "mix-counts")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)
    # totals: what a source drew beyond its slots goes to sources that drew too few
    drew = spans.join(counts.groupBy("s").agg(F.sum("k").alias("drew")), "s", "left").na.fill(0, ["drew"])
    over, under = F.greatest(F.lit(0), F.col("drew") - F.col("slots")), F.greatest(F.lit(0), F.col("slots") - F.col("drew"))
    ordered = Window.orderBy("s")
    drew = drew.withColumn("over_before", F.sum(over).over(ordered) - over).withColumn("under_before", F.sum(under).over(ordered) - under)
    drew = written(drew.select("s", "slots", "drew", "over_before", "under_before"), "mix-drew")
    # short ranges, dealt over the tasks before they are expanded
    ranges = counts.join(drew.select("s", "slots", "over_before"), "s").withColumn("first", F.explode(F.expr(f"sequence(before, before + k - 1, {RANGE_SLOTS})")))
    ranges = ranges.withColumn("last", F.expr(f"least(first + {RANGE_SLOTS}, before + k) - 1"))
    ranges = ranges.repartition(max(shuffle_partitions(spark), total // TASK_SLOTS + 1), "shard", "s", "first")
    kept = ranges.filter("first < slots").select("shard", "s", F.explode(F.expr("sequence(first, least(last, slots - 1))")).alias("j"))
    moved = ranges.filter("last >= slots").select("shard", "slots", "over_before", F.explode(F.expr("sequence(greatest(first, slots), last)")).alias("j"))
    moved = moved.select("shard", (F.col("over_before") + F.col("j") - F.col("slots")).alias("e"))
    gaps = drew.filter("drew < slots").select("s", "drew", "under_before", F.explode(F.expr("sequence(drew, slots - 1)")).alias("j"))
    gaps = gaps.select("s", "j", (F.col("under_before") + F.col("j") - F.col("drew")).alias("e"))
    return kept.unionByName(moved.join(gaps, "e").select("shard", "s", "j"))


def block_slots(slots: DataFrame, quota: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``shard, s, epoch, block, words``: the block that each slot takes, and how many of its first words."""
    b = block_words
    rows = slots.join(quota.select("s", "n", "tail", "passes", "rest", "tail_at"), "s")
    rows = rows.withColumn("epoch", F.expr("j div n")).withColumn("i", F.expr("j % n"))
    rows = rows.withColumn("block", permuted(F.col("i"), F.col("n"), pass_key(F.col("s"), F.col("epoch"))))
    rows = rows.withColumn("length", F.expr(f"if(block = n - 1, tail, {b})"))
    left = F.expr(f"rest - ({b} * i - if(tail_at < i, {b} - tail, 0))")
    words = F.when(F.col("epoch") < F.col("passes"), F.col("length")).otherwise(F.greatest(F.lit(0), F.least("length", left)))
    return rows.select("shard", "s", "epoch", "block", words.alias("words"))


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with ``s, source_size, target`` and ``start``, the words of its source before the document."""
    named = sources.select("s", F.col("source").alias("__source"), "source_size", "target")
    rows = sizes.join(named, sizes["source"].eqNullSafe(named["__source"])).drop("__source")
    rows = rows.withColumn("h", F.xxhash64(F.lit(SEED + 2).cast("bigint"), F.coalesce("doc_id", "text_hash")))
    rows = written(rows.withColumn("range", F.shiftrightunsigned("h", 64 - RANGES_BITS).cast("int")), "mix-rows")
    sums = rows.groupBy("s", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("s", "range").orderBy("h", F.coalesce("doc_id", F.lit(NO_ID)), "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(sums, ["s", "range"]).withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner", "h", "range")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The parts of documents that lie in one block: words ``low`` to ``high`` of block ``block``."""
    b = block_words
    parts = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    return parts.withColumn("low", F.expr(f"greatest(0, start - block * {b})")).withColumn("high", F.expr(f"least({b}, start + size - block * {b})"))


class Mix:
    """The mix of ``docs(doc_id, text, source)``; its parts are DataFrames."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS):
        sizes = written(sized(docs), "mix-sizes")
        self.sources = written(targets(sizes), "mix-sources")
        quota = written(quotas(self.sources, block_words), "mix-quotas")
        self.rows = written(streams(sizes, self.sources), "mix-streams")
        self.slots = written(block_slots(draw(quota, shard_slots), quota, block_words), "mix-slots")
        uses = self.slots.select("shard", "s", "epoch", "block", "words")
        #: Parts of documents in the mix: shard, epoch, and words ``low`` to ``high`` of the block.
        self.parts = pieces(self.rows, block_words).join(uses, ["s", "block"]).filter("low < words").withColumn("high", F.least("high", "words"))
        self.parts = self.parts.withColumn("at", F.col("block") * block_words + F.col("low") - F.col("start"))

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``."""
        keys = ["doc_id", "size", "source_size", "target"]
        some = self.parts.select("s", "start", *keys, (F.col("high") - F.col("low")).alias("taken"))
        none = self.rows.filter("size > 0").select("s", "start", *keys, F.lit(0).cast("bigint").alias("taken"))
        used = some.unionByName(none).groupBy("s", "start", *keys).agg(F.sum("taken").alias("taken"))
        empty = self.rows.filter("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
        return used.select(*keys, "taken").unionByName(empty)


def mix_report(docs: DataFrame) -> DataFrame:
    return Mix(docs).taken()


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with all columns of ``docs``: one row for each pass in which the mix takes words of a document.

    The text is unchanged where a pass takes all its words, else the words taken, joined by one space; ``n_chars`` follows it.
    """
    mix = Mix(docs)
    id_, hash_, name, copy, uses, use = spare_names(docs, "id", "hash", "name", "copy", "uses", "use")
    # rows are told apart by id, text and source; those equal in all three are numbered
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    copies = Window.partitionBy(id_, hash_, name)
    numbered = mix.rows.select("s", F.col("start").alias("__start"), "size", F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.col("text_hash").alias(hash_), named.alias(name))
    numbered = numbered.withColumn(copy, F.row_number().over(copies.orderBy("__start"))).filter("size > 0").withColumnsRenamed({"__start": "start"}).drop("size")
    taken = mix.parts.groupBy("s", "start", "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("high") - F.col("low")).alias("n")))).alias("ranges"))
    taken = taken.join(numbered, ["s", "start"]).groupBy(id_, hash_, name).agg(F.collect_list(F.struct(copy, "size", "ranges")).alias(uses))
    # window and join have one key, so texts are shuffled once
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), hash_: F.xxhash64(F.coalesce("text", F.lit(""))), name: named})
    rows = rows.withColumn(copy, F.row_number().over(copies.orderBy(id_))).join(taken, [id_, hash_, name])
    rows = rows.withColumn(use, F.explode(F.filter(uses, lambda u: u[copy] == F.col(copy))))
    ranges = F.col(f"{use}.ranges")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # bound by a lambda, so a text is cut into words once and not for each range
    part = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(ranges, lambda r: F.slice(w, (r["at"] + 1).cast("int"), r["n"].cast("int")))), " ")), 1)
    total = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, r: n + r["n"])
    rows = rows.withColumn("text", F.when(total == F.col(f"{use}.size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
