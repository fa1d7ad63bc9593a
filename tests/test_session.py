from types import SimpleNamespace

import pytest

from secframe.session import materialize, shared_dir


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder or d),
                           sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_shared_folder_comes_from_the_session():
    assert shared_dir(fake("yarn", "hdfs://x/ck")) == "hdfs://x/ck"
    local = shared_dir(fake("local[2]"))
    assert local == shared_dir(fake("local[2]")) and "secframe-" in local
    with pytest.raises(RuntimeError):
        shared_dir(fake("yarn"))


def test_materialize(spark):
    df = spark.range(10).repartition(1)
    assert sorted(r.id for r in materialize(df, "t").collect()) == list(range(10))
