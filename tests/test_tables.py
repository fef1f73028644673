import pytest

from tribune import tables


class Unset:
    """A session without spark.checkpoint.dir."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        applicationId, master = "app-1", "local[2]"


class Cluster(Unset):
    class sparkContext:
        applicationId, master = "app-2", "spark://host:7077"


def test_own_folder_only_on_a_local_master(spark):
    assert tables.shared_dir(Unset) == tables.shared_dir(Unset)
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster)


def test_cut_and_drop(spark):
    df = tables.cut(spark.range(5), "five")
    assert df.count() == 5 and "five-" in df.inputFiles()[0]
    tables.drop_scratch(df)


def test_cut_bucketed(spark):
    left, right = (tables.cut_bucketed(spark.range(n).withColumnRenamed("id", "k"), "side", "k", 3) for n in (50, 20))
    joined = left.hint("merge").join(right, "k")
    assert joined.count() == 20 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    name = tables._table_of(left.inputFiles()[0].rsplit("/", 1)[0])
    assert spark.catalog.tableExists(name)
    tables.drop_scratch(left, right)
    assert not spark.catalog.tableExists(name)
