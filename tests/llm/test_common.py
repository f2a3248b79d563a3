import pytest

from idveil.llm import common


class Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)


class Table:
    sparkSession = Cluster


def test_no_local_folder_on_a_cluster(spark):
    df = spark.range(3).toDF("doc_id")
    assert sorted(r["doc_id"] for r in common.written(df).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        common.written(Table)
