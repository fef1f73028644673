"""Tables that jobs write on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, only on a local master without spark.checkpoint.dir (as in tests).
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master; a cluster must set it, as its
    executors do not see each other's temporary folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_dirs[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tribune-")
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a job has shuffled is deleted as soon as the job ends, not once the driver has collected its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: How tables that hold whole texts are packed; they are smaller than by default.
TEXTS = "zstd"


def cut(df: DataFrame, what: str = "cut", packed: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and nothing above runs twice."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path, compression=packed)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, what: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """As cut(), bucketed by a key: tables with equal buckets join on the key without a shuffle. dealt: df comes from such tables, so that a task has
    one bucket already and rows need no shuffle to be few files."""
    spark = df.sparkSession
    path = scratch(spark, what)
    name = _table_of(path)
    (df if dealt else df.repartition(buckets, key)).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def _table_of(path: str) -> str:
    return "scratch_" + path.rstrip("/").rsplit("/", 1)[1].replace("-", "_")


def drop_scratch(*tables: DataFrame) -> None:
    """Delete what cut() or cut_bucketed() wrote for the tables, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
            if spark.catalog.tableExists(_table_of(folder)):
                spark.sql(f"DROP TABLE {_table_of(folder)}")
