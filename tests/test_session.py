"""Lineage helpers: the cluster's checkpoint folder is used, never replaced."""

from pyspark.sql import functions as F

from pondlake.session import cut_lineage, ensure_checkpoint_dir


def test_checkpoint_folder_comes_from_the_session(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == before or before is None
    assert spark.sparkContext.getCheckpointDir() == ensure_checkpoint_dir(spark)


def test_cut_lineage_keeps_rows_in_both_modes(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 7).alias("g"))
    for small in (False, True):
        out = cut_lineage(df.groupBy("g").count() if small else df, small=small)
        assert out.count() == (7 if small else 1000)


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch, tmp_path):
    import pytest

    from pondlake import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, d):
            self.folder = d

    class Spark:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())
    Spark.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())
    Spark.sparkContext.master = "local[2]"
    assert session.ensure_checkpoint_dir(Spark())
