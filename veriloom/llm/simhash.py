"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Equal fingerprints are one node.  Two fingerprints that differ in at most three bits agree on one of four 16-bit bands, so every
node meets those of its four band groups (bits that differ are counted over all 64).  All comparing is done in tiles: numpy
exclusive-or and bit counts on tile against tile, rows sorted by population count, and tile pairs whose population counts differ by
more than the radius are skipped.  Small groups share tiles; a group of more than ``UNIT_ROWS`` nodes is dealt out as pairs of tiles
to many tasks.  A unit reports the links as a spanning forest, at most one link per node, so hot groups give no quadratic output; the
forest connects exactly what the links connect.  Components come from alternating large-star and small-star steps.

The pipeline's stage (``keep_one_of_each``) links texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.
No radius finds these without comparing nearly all pairs, so a prefix join, which is exact, adds candidates to the SimHash links.
It goes in rounds, so that a cluster of near copies costs what its size is and not its square: first every text meets two others at
most for each shingle of its prefix, which joins most of a cluster; then what is left of it meets other neighbours; and at last only
pairs that are not joined yet are compared, all of them.

Defined results: null, empty and blank text have fingerprint zero; of one or two words the whole sequence is the shingle; rows
that repeat a doc_id are one document if their texts agree; a null doc_id counts as larger than any; a very long text is read whole
and only its fingerprint, or a fifth of its shingles' hashes, travels; other columns, whatever their names, are kept as they are by
the stage and not looked at by the query; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import bound_batches, shuffle_partitions, spare_names, written

RADIUS = 3
BANDS = 4
SHINGLE = 3
SEED = 42
#: Nodes of a band group that one unit of work compares; larger groups are split into tiles of that size.
UNIT_ROWS = 32_768
#: Rows of a tile within a unit.
TILE = 1024
#: Rows that small units share, and the rows of their tiles.
SHARED_ROWS, SHARED_TILE = 4096, 256
#: Words of a shingle in the pipeline's stage, which links texts that have four fifths of their shingles in common.
STAGE_SHINGLE = 5
#: About as many documents are sampled for shingles that several texts have, that many make one common, and that many are known.
SAMPLE, OFTEN, COMMON = 20_000, 2, 200_000
#: A shingle that one in so many sampled documents has is dealt over tasks of about so many of all documents each.
HOT_SHARE, HOT_ROWS = 100, 500_000
#: A shingle that more prefixes have is put last in the order of shingles, in so many rounds at most.
CROWD, CROWD_ROUNDS = 10_000, 3
#: Least bits of a set's sketch; it has as many as the set has shingles, rounded up to a power of two.
SKETCH = 512
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's runs of ``shingle`` words, in order; a shorter text is one run, a blank one has none."""
    data = (text or "").encode().lower()  # bytes: A-Z only, and split at ASCII white space only
    words = data.split()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()
    h = xxhash.xxh64_intdigest
    k = max(1, min(shingle, len(words)))
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, stops[k - 1 :])], dtype="<u8")  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        some = hashes[at : at + 16_384].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingles(text, shingle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long."""

    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def forest(fp: np.ndarray, node: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS, tile: int = TILE, tally: Counter | None = None) -> np.ndarray:
    """Links (node, node) that connect what fingerprints within the radius connect, at most one for each node.

    Rows are sorted by population count and compared tile against tile; tile pairs whose counts differ by more than the radius are
    skipped.  With ``side`` (0 or 1) only pairs across the sides are linked.  ``tally`` counts the tile pairs ``compared`` and ``skipped``.
    """
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, node = fp[order], node[order]
    count = np.bitwise_count(fp).astype(np.int16)
    side = None if side is None else side[order]
    label = np.arange(len(fp))  # smallest row that is linked
    edges, tiles = [], -(-len(fp) // tile)
    for x in range(tiles):
        a = x * tile
        for y in range(x, tiles):
            b = y * tile
            if count[b] - count[min(a + tile, len(fp)) - 1] > radius:
                if tally is not None:
                    tally["skipped"] += tiles - y
                break
            if tally is not None:
                tally["compared"] += 1
            near = np.bitwise_count(fp[a : a + tile, None] ^ fp[None, b : b + tile]) <= radius
            if side is not None:
                near &= side[a : a + tile, None] != side[None, b : b + tile]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            while True:  # rows that are linked already drop out; one link joins each pair of classes
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                some = low != high
                if not some.any():
                    break
                i, j, low, high = i[some], j[some], low[some], high[some]
                _, first = np.unique(high, return_index=True)  # each class is joined to one lower class
                edges.append(np.stack([node[i[first]], node[j[first]]]))
                parent = np.arange(len(fp))
                parent[high[first]] = low[first]
                while True:
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
                label = parent[label]
    return np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)


def unit_links(batches: Iterator[pa.RecordBatch], tally: Counter | None = None) -> Iterator[pa.RecordBatch]:
    """Links of units; a unit's rows (``key, a, b, side, fp, node``) follow one another.

    Small whole units are put together until they fill ``SHARED_ROWS``; links across units are links too.
    """
    rest: list[np.ndarray] | None = None

    def record(edges: np.ndarray) -> pa.RecordBatch:
        edges = edges[:, edges[0] != edges[1]]
        return pa.RecordBatch.from_arrays([pa.array(edges.max(axis=0, initial=-(1 << 63))), pa.array(edges.min(axis=0, initial=(1 << 63) - 1))], names=["u", "v"])

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, a, b, side, fp, node = columns
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
        plain, first = (a == b)[starts], 0
        for k in range(len(starts)):
            # a unit of two different tiles stands alone, others are gathered
            last = k + 1 == len(starts) or not plain[k] or not plain[k + 1] or ends[k + 1] - starts[first] > SHARED_ROWS
            if last:
                rows = slice(starts[first], ends[k])
                yield record(forest(fp[rows], node[rows], None if plain[k] else side[rows], tile=TILE if first == k else SHARED_TILE, tally=tally))
                first = k + 1

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns[4] = columns[4].astype(np.int64).view(np.uint64)
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = [c[cut:] for c in columns]
        if cut:
            yield from compare([c[:cut] for c in columns])
    if rest is not None and len(rest[0]):
        yield from compare(rest)


def links(nodes: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``u, v`` (u > v) between nodes of ``nodes(fp, node)``, a spanning forest of the links."""
    band = F.explode(F.array(*(F.struct((F.lit(k * 65536) + F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535))).cast("int").alias("key")) for k in range(BANDS))))
    rows = nodes.select("fp", "node", F.bit_count("fp").alias("count"), band.alias("band")).select("band.key", "fp", "node", "count")
    # at most 4 x 65,536 keys, whatever the number of nodes, and 65 population counts for each that is split
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > unit_rows).select("key")
    tiles = rows.join(F.broadcast(large), "key", "left_semi").groupBy("key", "count").agg(F.ceil(F.count(F.lit(1)) / unit_rows).cast("int").alias("tiles"))
    tiles = tiles.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("count", "tiles"))).alias("tiles"))
    rows = rows.join(F.broadcast(tiles), "key", "left")
    whole = rows.filter("tiles is null").select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp", "node")
    # a tile is (population count, part); it meets itself and the tiles whose counts are within the radius
    number = "(c * 1000000 + p)"
    mine = F.expr("count * 1000000 + cast(pmod(xxhash64(fp), tiles[count]) as int)")
    others = F.expr(
        f"flatten(transform(filter(sequence(count - {RADIUS}, count + {RADIUS}), c -> tiles[c] is not null),"
        f" c -> transform(sequence(0, tiles[c] - 1), p -> {number})))"
    )
    split = rows.filter("tiles is not null").select("key", "fp", "node", mine.alias("mine"), F.explode(others).alias("other"))
    split = split.select(
        "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp", "node"
    )
    units = whole.unionByName(split).repartition(shuffle_partitions(nodes.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return units.mapInArrow(lambda batches: unit_links(batches), "u bigint, v bigint")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``edges(u, v)``; the component is the smallest node that is reachable.

    Large-star joins a node's larger neighbours to its smallest neighbour, small-star does it for smaller ones; both shrink the
    graph to stars in a number of rounds that grows with the logarithm of its size.  Each round is written to the shared folder.
    """

    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table.union(table.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else table
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m"))
        return moved.filter("u <> v").distinct()

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.filter("u <> v").distinct(), "links", "none")  # hashes don't compress
    before = mark(edges)
    while before[0]:
        edges = written(star(star(edges, large=True), large=False), "links", "none")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    spark = docs.sparkSession
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")  # null only where no row has an id
    # the fingerprint is the node, so fingerprints without an id stay apart
    found = components(spark, links(nodes.select("fp", F.col("fp").alias("node")), unit_rows))
    classes = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(least, "class").select("fp", "component_id"), "fingerprint-classes")
    # one row per fingerprint meets its documents; the hot side is split by adaptive skew handling
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct five-word shingles, sorted; a blank text has the one shingle 0."""
    found = np.unique(shingles(text, STAGE_SHINGLE)).astype(np.uint64)
    return found if len(found) else np.zeros(1, np.uint64)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of several texts of a sample, at most ``COMMON``, rare ones first; those of them that are hot; and among how many tasks
    to deal these.

    Common ones only order the prefixes, and hot ones are only dealt otherwise: any choice gives the same pairs.
    """

    total = docs.count()
    parts = max(1, total // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text").mapInArrow(all_shingles, "h bigint")
    often = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    known, count = (often.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    return known[::-1].view(np.uint64), known[count * parts * HOT_SHARE > total], max(16, total // HOT_ROWS)


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``doc_id, body, node, fp, n, prefix, sketch, brief``: the shingle set's digest and size, the SimHash of the shingles, the prefix.

    In one order of all shingles, ``common`` ones last as they are listed, two sets of which at least four fifths are shared have a shingle in common
    among the first ``n - ceil(4 n / 5) + 1`` of each.  The sketch has the parity of the shingles that fall on each bit: two sketches
    of one length differ in no more bits than the sets differ in shingles, and a longer one folds to a shorter one; ``brief`` is the
    one of ``SKETCH`` bits.
    """
    bound_batches(docs.sparkSession)
    rank = np.argsort(common)
    listed = common[rank]

    def mark(text: str | None) -> tuple[int, int, int, np.ndarray, bytes, bytes]:
        found = shingles(text, STAGE_SHINGLE)
        some = np.unique(found).astype(np.uint64) if len(found) else np.zeros(1, np.uint64)
        size = max(SKETCH, 1 << (len(some) - 1).bit_length())
        bits = np.bincount((some >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size) & 1
        node, n = xxhash.xxh64_intdigest(some.tobytes(), SEED), len(some)
        if len(listed):
            at = np.minimum(np.searchsorted(listed, some), len(listed) - 1)
            last = listed[at] == some
            late = some[last]
            some = np.concatenate([some[~last], late[np.argsort(rank[at[last]])]])
        sketch = np.packbits(bits.astype(np.uint8))
        brief = np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH // 8), axis=0)
        return node, majority(found), n, some[: n - (4 * n + 4) // 5 + 1].view(np.int64), sketch.tobytes(), brief.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [mark(t.as_py()) for t in batch.column(2)]
            node, fp = (pa.array(np.array([m[k] for m in marks], np.uint64).view(np.int64), pa.int64()) for k in (0, 1))
            lists = pa.array([m[3] for m in marks], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), node, fp, pa.array([m[2] for m in marks], pa.int32()), lists, *(pa.array([m[k] for m in marks], pa.binary()) for k in (4, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "body", "node", "fp", "n", "prefix", "sketch", "brief"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    return rows.mapInArrow(run, "doc_id bigint, body bigint, node bigint, fp bigint, n int, prefix array<bigint>, sketch binary, brief binary")


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``h, n, place, node, hot`` (sorted by h, salt, n, node) of shingles that several nodes have, or that are hot, each with two
    partners ``prev, rep``: the node before it, and the first node of about its size.  Memory holds one batch, however many rows a
    shingle has."""
    tail: list[np.ndarray] | None = None  # the last row, which waits for the next: its values, partners, and whether it has any

    def emit(columns: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["h", "n", "place", "node", "hot", "prev", "rep"])

    for batch in batches:
        rows = _numbers(batch)
        if tail is not None:
            rows = [np.concatenate([t[:1], r]) for t, r in zip(tail, rows, strict=False)]
        if not len(rows[0]):
            continue
        new = np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[3]) != 0)])  # copies of a set follow one another
        h, n, place, node, hot = (r[new] for r in rows)
        size = np.floor(np.log(n) / np.log(1.25)).astype(np.int64)
        same = np.concatenate([[False], np.diff(h) == 0])
        start = np.where(~same | np.concatenate([[True], np.diff(size) != 0]), np.arange(len(h)), 0)
        first = np.maximum.accumulate(start)
        rep, prev = node[first], np.where(same, np.concatenate([node[:1], node[:-1]]), node)
        linked = same.copy()
        if tail is not None:
            rep[first == 0], prev[0], linked[0] = tail[6][0], tail[5][0], bool(tail[7][0])
        keep = linked | np.concatenate([same[1:], [False]]) | (hot > 0)
        keep[-1] = False
        columns = [h, n, place, node, hot, prev, rep]
        if keep.any():
            yield emit(columns, keep)
        tail = [c[-1:] for c in (*columns, linked)]
    if tail is not None and (tail[7][0] or tail[4][0]):
        yield emit(tail[:7], np.array([True]))


def prefix_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different classes with a shingle ``h`` whose sizes and places (``h, salt, n, place, node, part, brief``,
    sorted), and whose brief sketches, leave four fifths possible.  Each row outside a shingle's largest class is compared with the shingle's other rows."""
    rest: list[np.ndarray] | None = None

    def group(n: np.ndarray, place: np.ndarray, node: np.ndarray, part: np.ndarray, brief: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, which, count = np.unique(part, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        minor = np.flatnonzero(which != np.argmax(count))
        # each pair once: minor rows with the major class, and with later minor rows
        rank = np.full(len(part), -1)
        rank[minor] = np.arange(len(minor))
        for i in minor.tolist():
            most = np.minimum(n[i] - place[i], n - place)
            hit = (part != part[i]) & (9 * most >= 4 * (n[i] + n)) & ((rank < 0) | (rank > rank[i])) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
            hit = np.flatnonzero(hit)
            hit = hit[9 * np.bitwise_count(brief[hit] ^ brief[i]).sum(axis=1, dtype=np.int64) <= n[hit] + n[i]]
            if len(hit):
                other = node[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(other, node[i])), pa.array(np.minimum(other, node[i]))], names=["u", "v"])

    def small(unit: np.ndarray, n: np.ndarray, place: np.ndarray, node: np.ndarray, part: np.ndarray, brief: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, shift = np.arange(len(unit)), 0
        while len(first):
            shift += 1
            first = first[first + shift < len(unit)]
            # sizes ascend within a unit: a row that is done stays done
            first = first[(unit[first] == unit[first + shift]) & (5 * n[first] >= 4 * n[first + shift])]
            other = first + shift
            most = np.minimum(n[first] - place[first], n[other] - place[other])
            hit = np.flatnonzero((9 * most >= 4 * (n[first] + n[other])) & (part[first] != part[other]))
            i, j = first[hit], other[hit]
            near = 9 * np.bitwise_count(brief[i] ^ brief[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
            if near.any():
                a, b = node[i[near]], node[j[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(columns[0])]])
        large = ends - starts > 64
        few = ~np.repeat(large, ends - starts)
        yield from small(np.repeat(np.arange(len(starts)), ends - starts)[few], *(c[few] for c in columns[2:]))
        for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            yield from group(*(c[s:e] for c in columns[2:]))

    for batch in batches:
        columns = _numbers(batch.select(range(6)))
        columns.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, SKETCH // 64))
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = len(last) - int(last.sum())  # rows are sorted, so the last unit is at the end
        rest = [c[cut:] for c in columns]
        if cut:
            yield from compare([c[:cut] for c in columns])
    if rest is not None and len(rest[0]):
        yield from compare(rest)


def sketches_apart(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Bits in which pairs of sketches differ, the longer one folded to the length of the shorter."""
    out = np.empty(len(first), np.int64)
    kinds = np.array([(len(x), len(y)) for x, y in zip(first, second, strict=True)], np.int64).reshape(-1, 2)
    for m, n in np.unique(kinds, axis=0).tolist():
        rows = np.flatnonzero((kinds[:, 0] == m) & (kinds[:, 1] == n))
        short = min(m, n)
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[k] for k in rows), np.uint64).reshape(len(rows), -1, short // 8), axis=1) for side in (first, second))
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets have a Jaccard similarity of at least 0.8: sketches prune, the sets themselves decide."""
    first, second = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = sketches_apart(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield batch.select(["u", "v"]).filter(pa.array(9 * apart <= batch.column(4).to_numpy()))

    joined = pairs.join(first, "u").join(second, "v").select("u", "v", "sketch_u", "sketch_v", (F.col("n_u") + F.col("n_v")).cast("bigint").alias("n"))
    pairs = written(joined.mapInArrow(alike, "u bigint, v bigint"), "near-pairs", "none")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = written(wanted.join(nodes.select("node", "body"), "node"), "near-wanted", "none")
    texts = docs.select("text", F.xxhash64("text").alias("body")).join(wanted, "body").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within the task; Spark does the rest
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    keys.append(key)
                    sets.append(shingle_set(text.as_py()).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    # both joins read one shuffle of the sets
    sets = texts.mapInArrow(run, "node bigint, set array<bigint>").dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def shared_shingles(marks: DataFrame, hot: np.ndarray, salts: int) -> DataFrame:
    """The rows of ``shared_rows`` of all prefixes."""
    spark = marks.sparkSession
    rows = marks.select("node", "n", F.posexplode("prefix").alias("place", "h")).select("h", "n", "place", "node")
    # at most COMMON shingles of a sample
    known = F.broadcast(spark.createDataFrame([(int(h), 1) for h in hot], "h bigint, hot int"))
    rows = rows.join(known, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    rows = rows.withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("node"), F.lit(salts))).otherwise(0))
    rows = rows.repartition(shuffle_partitions(spark), "h", "salt").sortWithinPartitions("h", "salt", "n", "node").select("h", "n", "place", "node", "hot")
    return written(rows.mapInArrow(shared_rows, "h bigint, n bigint, place bigint, node bigint, hot bigint, prev bigint, rep bigint"), "shared-shingles")


def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["h"])


def _unknown(counts: DataFrame, common: np.ndarray) -> np.ndarray:
    """Shingles of ``counts(h, n)`` above ``CROWD`` that aren't in ``common``, rare ones first, at most ``COMMON``."""
    found = counts.filter(F.col("n") > CROWD).orderBy(F.desc("n"), "h").limit(COMMON).toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)[::-1]
    return found[~np.isin(found, common)]


def marked_prefixes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The marks of all documents, the rows of their shared shingles, and among how many tasks hot ones are dealt.

    A sample misses shingles that only some in a million documents have, which are many documents in a large corpus.  Prefixes tell them
    all: where more than ``CROWD`` of them have one that wasn't known for common, all shingles of these documents are counted, those of
    more than ``CROWD`` documents are put last in the order, and the prefixes are made anew.
    """
    spark = docs.sparkSession
    common, hot, salts = common_shingles(docs)
    for _ in range(CROWD_ROUNDS):
        marks = written(prefixes(docs, common), "shingle-marks")
        shared = shared_shingles(marks, hot, salts)
        crowd = _unknown(shared.groupBy("h").agg(F.count(F.lit(1)).alias("n")), common)
        if not len(crowd):
            break
        few = F.broadcast(spark.createDataFrame([(int(h),) for h in crowd.view(np.int64)], "h bigint"))  # at most COMMON
        bodies = shared.join(few, "h", "left_semi").select("node").distinct().join(marks.select("node", "body"), "node").select("body").distinct()
        texts = docs.select("text", F.xxhash64("text").alias("body")).join(bodies, "body", "left_semi").dropDuplicates(["body"])
        counted = texts.select("text").mapInArrow(all_shingles, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        common = np.concatenate([common, _unknown(counted, common)])  # more frequent than what the sample knew by chance
    return marks, shared, salts


def near_classes(docs: DataFrame, marks: DataFrame, shared: DataFrame, salts: int) -> DataFrame:
    """``node, class`` of the shingle sets that pairs with a Jaccard similarity of at least 0.8 connect to others.

    Candidates are the pairs that share a shingle of their prefixes, which misses none, and the links of the SimHash bands.  Rows of
    a hot shingle are dealt over ``salts`` units.  In the first round units are joined by the pairs of their partners; in the second the
    rows of the shingle's largest class are dealt, and the others go to every unit.
    """
    spark = docs.sparkSession
    nodes = written(marks.groupBy("node").agg(F.min("body").alias("body"), F.max("n").cast("int").alias("n"), F.max("sketch").alias("sketch"), F.max("brief").alias("brief")), "shingle-nodes")
    unit = F.pmod(F.xxhash64("node"), F.lit(salts))
    before = F.lag("rep").over(Window.partitionBy("h").orderBy("rep"))
    across = shared.filter("hot = 1").select("h", "rep").distinct().select("rep", before.alias("other")).filter("other is not null")  # a few for each unit
    prints = marks.groupBy("fp").agg(F.min("node").alias("least"))
    same = marks.select("fp", "node").join(prints, "fp").filter("node <> least").select(F.greatest("node", "least").alias("u"), F.least("node", "least").alias("v"))
    banded = links(prints.select("fp", F.col("least").alias("node")))
    partner = shared.select("node", F.explode(F.array("prev", "rep")).alias("other")).filter("node <> other")
    partner = partner.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"))
    across = across.select(F.greatest("rep", "other").alias("u"), F.least("rep", "other").alias("v"))
    tried = written(partner.unionByName(across).unionByName(same).unionByName(banded).distinct(), "near-candidates", "none")
    classes = written(components(spark, confirmed(tried, nodes, docs)).withColumnRenamed("component", "class"), "near-classes", "none")
    for everyone in (False, True):
        # what is not joined yet: shingles that more than one class has
        parted = shared.select("h", "n", "place", "node", "hot").join(classes, "node", "left").withColumn("part", F.coalesce("class", "node")).drop("class")
        open_ = parted.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("h")
        parted = written(parted.join(open_, "h", "left_semi"), "open-shingles")
        shared = parted.drop("part")  # what is closed stays closed
        if everyone:
            sizes = parted.filter("hot = 1").groupBy("h", "part").agg(F.count(F.lit(1)).alias("size")).groupBy("h").agg(F.max_by("part", "size").alias("major"))
            parted = parted.join(F.broadcast(sizes), "h", "left")  # one row for each hot shingle
            own, each = F.array(F.when(F.col("hot") == 1, unit).otherwise(0)), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
            units = F.when((F.col("hot") == 0) | (F.col("part") == F.col("major")), own).otherwise(each)
            rows = parted.select("h", F.explode(units).alias("salt"), "n", "place", "node", "part").join(nodes.select("node", "brief"), "node").select("h", "salt", "n", "place", "node", "part", "brief")
            rows = rows.repartition(shuffle_partitions(spark), "h", "salt").sortWithinPartitions("h", "salt", "n", "node")
            pairs = rows.mapInArrow(prefix_pairs, "u bigint, v bigint")
        else:  # a neighbour of about its size for each shingle, another one each time
            order = Window.partitionBy("h", "salt").orderBy(F.floor(F.log("n") / F.log(F.lit(1.25))), F.xxhash64("node", "h"))
            rows = parted.withColumn("salt", F.when(F.col("hot") == 1, unit).otherwise(0))
            rows = rows.select("node", "part", F.lag("node").over(order).alias("other"), F.lag("part").over(order).alias("its")).filter("part <> its")
            pairs = rows.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"))
        pairs = written(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "near-candidates", "none")
        classes = written(extended(classes, confirmed(pairs, nodes, docs)), "near-classes", "none")
        tried = tried.unionByName(pairs)
    return classes


def extended(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``classes(node, class)`` with the classes joined whose nodes ``pairs(u, v)`` join; a node that isn't there is its own class."""
    a, b = (classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")) for x in "uv")
    ends = pairs.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("class_u", "u").alias("a"), F.coalesce("class_v", "v").alias("b"))
    merged = components(classes.sparkSession, ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).toDF("class", "whole")
    moved = classes.join(merged, "class", "left").select("node", F.coalesce("whole", "class").alias("class"))
    return moved.unionByName(merged.join(classes.select(F.col("node").alias("class")), "class", "left_anti").select(F.col("class").alias("node"), F.col("whole").alias("class")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of documents that pairs of four fifths connect the smallest doc_id, with all columns; its rows stay as often as they come."""
    marks, shared, salts = marked_prefixes(docs)
    found = near_classes(docs, marks, shared, salts)
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("body").alias("body"))
    kept = marks.select("node", key.alias("key")).join(found, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("key").alias("key"))
    id_, body = spare_names(docs, "id", "body")
    rows = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), body: F.xxhash64("text")})
    kept = kept.select(F.col("key.id").alias(id_), F.col("key.body").alias(body)).distinct()
    return rows.join(kept, [id_, body], "left_semi").select(*docs.columns)
