import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from test_mixing import brute_targets
from test_simhash import five
from veriloom.llm.storage import written
from veriloom.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"


def near_survivors(rows):
    """The smallest id of each group that pairs with four fifths of their five-word shingles in common connect."""
    sets = {r["doc_id"]: five("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {root(i) for i in ids}


def test_run_as_a_whole(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) > 100 and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_with_null_and_repeated_ids_and_other_columns(spark, tmp_path):
    words = [" ".join(f"{c}{i}x" for i in range(30)) for c in "abcdef"]
    rows = [(None, words[0], "en", "s", 1, "k", 0), (None, words[1], "en", "s", 1, "k", 1), (None, None, "en", None, 0, "k", 2), (5, words[2], "en", "s", 1, "k", 3), (5, words[3], "en", None, 1, "k", 4), (6, words[2], "en", "s", 1, "k", 5), (7, words[4] * 400, "en", "t", 1, "k", 6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, copy int").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
    assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == sorted((str(i), t) for i, t, *_ in (rows[0], rows[1], rows[3], rows[4], rows[6]))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 5, 7}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    extra = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, " 12 ", "en", None, 4), (10_002, docs.first()["text"], "fr", "src9", 1)], docs.schema)
    docs = written(docs.unionByName(extra), "test")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(written(stage(spark, results[-1], SF), name))
    start, known, once, near, mix, packs = ({} if r is results[-1] else r.collect() for r in results)
    assert all(r.columns == names for r in results[:-1])

    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in known} == {10_000, 10_001}
    assert {r["doc_id"]: r for r in start}.items() >= {r["doc_id"]: r for r in known}.items()

    least = {}
    for r in known:
        text = " ".join(x for x in r["text"].encode().decode().replace("\n", " ").split(" "))
        least[text] = min(least.get(text, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in once) == sorted(least.values())

    assert {r["doc_id"] for r in near} == near_survivors(once)

    sizes, taken, by_source = {r["doc_id"]: len(r["text"].split()) for r in near}, Counter(), Counter()
    for r in near:
        by_source[r["source"]] += sizes[r["doc_id"]]
    got = Counter()
    for r in mix:
        taken[r["doc_id"]] += len(r["text"].split())
        got[r["source"]] += len(r["text"].split())
    _, target = brute_targets(by_source)
    assert all(abs(got[s] - target[s]) <= 0.5 for s in by_source)
    assert all(n <= 2 * sizes[i] for i, n in taken.items())

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    want = Counter()
    for r in mix:
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):  # noqa: B905
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = results[-1].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1
