import os

import pytest

from chunkloom.runtime import Scratch, shared_dir


def test_scratch_tables(spark):
    scratch = Scratch(spark, "test")
    df = scratch.write(spark.range(5).selectExpr("id", "id % 2 as part"), "t", partition_by=("part",))
    assert sorted(df.select("id", "part").collect()) == [(i, i % 2) for i in range(5)]
    assert scratch.path.startswith(shared_dir(spark)) and "rdd" not in df._jdf.queryExecution().logical().toString()
    scratch.close()
    assert not os.path.exists(scratch.path.removeprefix("file://"))


class _Fake:
    def __init__(self, master, said=None):
        self.sparkContext = self
        self.master, self.said, self.conf = master, said, self

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.said or default


def test_a_cluster_must_name_its_folder():
    assert shared_dir(_Fake("spark://host", "hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        shared_dir(_Fake("spark://host"))
    with pytest.raises(RuntimeError):
        shared_dir(_Fake("local-cluster[2,1,1024]"))
