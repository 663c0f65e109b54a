import os
from types import SimpleNamespace

import numpy as np
import pytest

from choralis.llm import common as C
from choralis.sources import stages as S


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(session(master))
    assert S.shared_folder(session(master, "hdfs://x/y")) == "hdfs://x/y"


def test_stages_are_written_and_deleted(spark):
    df = C.stored(spark.range(10))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
    folder = S.run_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    C.clear_stages(spark)
    assert not os.path.exists(folder)
    assert C.stored(spark.range(3)).count() == 3


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter_loses_nothing(spark, n):
    df = spark.range(n).selectExpr("xxhash64(id) as h")
    bits = C.Bits.of(df)
    mine = np.array([r[0] for r in df.collect()], np.int64)
    assert len(bits.among(mine)) == n
    others = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200_000)
    assert len(bits.among(others)) < 50
