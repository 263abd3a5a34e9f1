import json

import pytest

from veriloom.sources import folders


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    home = tmp_path_factory.mktemp("runs")
    files = {
        "run-1/meta.json": '{"b":1,"a":[1,2]}', "run-1/log.jsonl": '{"a":1}\n{"a":2}\n{"a":', "run-1/notes/read.txt": "free text\nin lines", "run-1/evidence/show.json": '{"peers":{}}',
        "run-2/meta.json": '{"a":1,"a":2}', "run-2/log.jsonl": '{"a":NaN}\nnot json\n{"a":1}\n', "run-3/.INCOMPLETE": "", "run-3/meta.json": "{}", "run-4/lines.json": '{"a":1}\n{"a":2}\n', "run-5/empty.jsonl": "",
    }
    for path, text in files.items():
        (home / path).parent.mkdir(parents=True, exist_ok=True)
        (home / path).write_text(text)
    (home / "run-5/binary.txt").write_bytes(b"\xff\xfe")
    return str(home)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_records_of_all_runs(spark, root):
    folders.register(spark)
    got = rows(spark.read.format("run_folders").load(root))
    assert got == sorted([
        ("run-1", "meta.json", "json", 1, '{"a":[1,2],"b":1}', None, None), ("run-1", "log.jsonl", "json_lines", 1, '{"a":1}', None, None), ("run-1", "log.jsonl", "json_lines", 2, '{"a":2}', None, None),
        ("run-1", "log.jsonl", "json_lines", 3, None, '{"a":', "torn"), ("run-1", "notes/read.txt", "text", 1, None, "free text\nin lines", None), ("run-1", "evidence/show.json", "evidence", 1, '{"peers":{}}', None, None),
        ("run-2", "meta.json", "json", 1, None, '{"a":1,"a":2}', "duplicate key"), ("run-2", "log.jsonl", "json_lines", 1, None, '{"a":NaN}', "NaN is no JSON"), ("run-2", "log.jsonl", "json_lines", 2, None, "not json", "not JSON"),
        ("run-2", "log.jsonl", "json_lines", 3, '{"a":1}', None, None), ("run-3", ".INCOMPLETE", "marker", None, None, None, "unfinished"),
        ("run-4", "lines.json", "json", 1, '{"a":1}', None, None), ("run-4", "lines.json", "json", 2, '{"a":2}', None, None), ("run-5", "binary.txt", "text", 0, None, None, "not UTF-8"),
    ], key=repr)


def test_filters_choose_folders_and_files(spark, root):
    folders.register(spark)
    one = spark.read.format("run_folders").load(root).filter("run_id = 'run-1' and kind in ('json', 'text')")
    assert one.rdd.getNumPartitions() == 1
    assert {(r["run_id"], r["kind"]) for r in one.collect()} == {("run-1", "json"), ("run-1", "text")}
    assert spark.read.format("run_folders").load(root).filter("run_id = 'nobody'").count() == 0
    assert spark.read.format("run_folders").load(root).filter("run_id in ('run-2', 'run-4', '../run-1')").select("run_id").distinct().count() == 2
    # a filter that the source doesn't know is Spark's
    assert spark.read.format("run_folders").load(root).filter("line > 1").count() == 5


def test_unfinished_runs_can_fail_the_query(spark, root):
    folders.register(spark)
    strict = spark.read.format("run_folders").option("unfinished", "fail").load(root)
    with pytest.raises(Exception, match="was not finished"):
        strict.collect()
    assert strict.filter("run_id = 'run-1'").count() == 6
    with pytest.raises(Exception, match="binaryFile"):
        spark.read.format("run_folders").load("s3a://bucket/runs").collect()


def test_deep_values_are_errors_not_crashes():
    assert list(folders.records("x.json", "json", b"[" * 200_000))[0][3] in ("nested too deeply", "not JSON")
    assert json.loads(folders.strict_json('{"é": "\\u00e9"}')) == {"é": "é"}
