import os

import pytest

from lodestone import session


def test_scratch_ends_with_its_block(spark):
    with session.scratch(spark):
        df = session.materialize(spark.range(5), "five")
        path = df._lodestone_path.removeprefix("file://")
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
    kept = session.materialize(spark.range(3), "three")
    assert kept.count() == 3
    session.discard(kept)
    assert not os.path.exists(kept._lodestone_path.removeprefix("file://"))


def test_parts_are_read_apart(spark):
    df = session.materialize_parts(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "run int, x string"), "parts", "run")
    assert sorted(r.x for r in df.where("run = 2").collect()) == ["b", "c"] and df.columns == ["run", "x"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
