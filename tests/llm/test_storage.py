import os
from types import SimpleNamespace

import pytest

from veriloom.llm import storage


def session(master, conf=None):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name: conf), getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        storage.shared_root(session("spark://host:7077"))
    assert storage.shared_root(session("spark://host:7077", "hdfs://shared/")) == "hdfs://shared"
    assert os.path.isdir(storage.shared_root(session("local[2]")))


def test_names_that_no_column_has(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ID int, _id int, copy int")
    assert storage.spare_names(df, "id", "copy", "other", "other") == ["__id", "_copy", "other", "_other"]


def test_discard(spark):
    path = storage.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    storage.discard(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
