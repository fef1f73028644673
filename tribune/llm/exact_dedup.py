"""Exact deduplication by a stream with keyed state that never expires.

Texts are equal when they are the same after deleting every character of [\\x20\\x09-\\x0D]. Arriving rows
are reduced to (digest, doc_id, content locator, length) and stream through an aggregation keyed
by the digest. Its state lies on disk (RocksDB, checkpointed to the shared folder) and holds for each digest
the identifier and locator of the row that stays and the number of rows so far. There is no watermark, so
a digest is known for good, and a later run over new arrivals with the same state folder continues where the
last one stopped; a lost executor's state is read again from the checkpoint. The locator names the run
of a text and its hash; runs that share a state folder keep their texts in it by run and bucket, so that a later run reads those of its hits alone.
A run that is named can be given again after it was lost: what has landed lands once, and what was counted counts once.

A digest that is met again is a hit, not yet a copy: the full normalised text of each hit is
compared with that of the row that stays, wherever that arrived; the texts of a hot digest are dealt over many keys. Digests whose texts differ are grouped by their whole texts instead.

Of equal texts the row with the most code points stays, then the smallest doc_id. A run returns the rows of its own docs, judged
by all that has arrived so far; what an earlier run returned is not taken back. Defined cases: null text
counts as empty, and empty texts are equal to each other; a null doc_id comes after all others; rows with the same
doc_id and the same text are one document that occurs twice: they count twice in group_size, both have kept true when
that doc_id stays, and filter_kept() returns both if both were there; an empty table gives an empty result; extra columns are ignored by dedup() and kept by filter_kept().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, scratch

#: Up to so many dropped rows (16 bytes each) their keys are broadcast to filter the documents; beyond, a shuffle joins them.
BROADCAST_ROWS = 2_000_000
#: Up to so many hits (100 bytes each) are broadcast to find their texts; beyond, a shuffle joins them. Hits of one digest that share a key.
BROADCAST_HITS, HITS_A_KEY = 500_000, 1_000
#: Buckets of the stored texts of a run.
BUCKETS = 64
_BLANKS = " \t\n\x0b\x0c\r"
#: State on disk; a store is closed when its task has committed, so an executor keeps open (and on its own disk) only those at work.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # a commit writes one file of changes, not the store's files one by one
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: On a local file system the default manager starts processes for every file, each of which is for a moment a copy of the executor; elsewhere it is the safer one.
_LOCAL_CONF = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def arrivals(docs: DataFrame, run: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What of a row takes part: doc_id, locator (run and text hash), n_points, text_sha256, digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.lit(run).alias("run"), F.xxhash64(text).alias("text_hash")).alias("locator"),
        F.length(text).alias("n_points"),
        sha256(normalised(F.col("text"))).alias("text_sha256"),
        *([] if digest is sha256 else [digest(normalised(F.col("text"))).alias("digest")]),
    )
    return rows if digest is not sha256 else rows.withColumn("digest", F.col("text_sha256"))


def contents(docs: DataFrame, run: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, run, text_hash, n_points, digest and the full normalised text of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(run).alias("run"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("n_points"), normalised(F.col("text")).alias("full"))
    return rows.withColumn("digest", digest(F.col("full")))


def _fs(spark: SparkSession, path: str) -> tuple:
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path_.getFileSystem(spark._jsc.hadoopConfiguration()), path_


def _batches(spark: SparkSession, log: str) -> set[int]:
    fs, path = _fs(spark, log)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")}


def land(rows: DataFrame, folder: str, *by: str) -> None:
    """Write rows to a folder that appears when it is whole; one that is there stays as it is."""
    spark = rows.sparkSession
    fs, final = _fs(spark, folder)
    if fs.exists(final):
        return
    draft = scratch(spark, "landing")
    rows.write.partitionBy(*by).parquet(draft) if by else rows.write.parquet(draft)
    fs.mkdirs(final.getParent())
    if not fs.rename(_fs(spark, draft)[1], final):
        raise OSError(f"{draft} could not be moved to {folder}")


def absorb(spark: SparkSession, landing: str, state: str) -> DataFrame:
    """Stream what is new in the landing folder through the state; the row that stays and the count of each digest that it changed.

    Every run appends the digests it changed to a log beside the state; the last entry of a digest holds. Where nothing is new, as in
    a run that is given again, the whole log is returned.
    """
    log = f"{state}/log"
    before = _batches(spark, log)
    schema = spark.read.parquet(f"{landing}/*").schema
    stays = F.max(F.struct("n_points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("order"), "doc_id", "locator"))
    groups = spark.readStream.schema(schema).parquet(f"{landing}/*").groupBy("digest").agg(stays.alias("stays"), F.count("*").alias("group_size"))

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    wanted = _STATE_CONF | (_LOCAL_CONF if _fs(spark, state)[0].getUri().getScheme() == "file" else {})
    conf = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in conf.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # all digests of a run are in the batches that took it
    new = sorted(_batches(spark, log) - before) or sorted(before)
    changed = spark.read.option("basePath", log).parquet(*(f"{log}/batch={k}" for k in new))
    last = changed.groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("last"))
    return last.select("digest", F.col("last.stays.doc_id").alias("keep_id"), F.col("last.stays.locator").alias("keep_locator"), F.col("last.group_size").alias("group_size"))


def _bucket(text_hash: str) -> Column:
    return F.pmod(F.col(text_hash), F.lit(BUCKETS)).cast("int")


def differing(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests with a hit whose full normalised text is not that of the row that stays. texts: contents of all runs that rows name; where they are stored, only
    runs and buckets with a hit are read."""
    met = rows.where("group_size > 1").withColumn("n_keys", F.ceil(F.col("group_size") / HITS_A_KEY).cast("int"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))
    key = F.pmod(F.xxhash64("doc_id", "locator.text_hash"), F.col("n_keys")).cast("int")
    hits = met.where(~stays).select("digest", "doc_id", "locator.run", "locator.text_hash", F.array(key).alias("keys"), F.lit(False).alias("stays"))
    kept = met.select("digest", F.col("keep_id").alias("doc_id"), "keep_locator.run", "keep_locator.text_hash", F.sequence(F.lit(0), F.col("n_keys") - 1).alias("keys"), F.lit(True).alias("stays"))
    asked = cut(hits.union(kept).distinct(), "hits")
    if "bucket" in texts.columns:
        runs = [r.run for r in asked.select("run").distinct().collect()]  # a name for each run with a hit, and BUCKETS at most
        texts = texts.where(F.col("run").isin(runs) & F.col("bucket").isin([r.bucket for r in asked.select(_bucket("text_hash").alias("bucket")).distinct().collect()]))
    asked = (F.broadcast(asked) if asked.count() <= BROADCAST_HITS else asked).alias("h")
    t = texts.select("doc_id", "run", "text_hash", "full").alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t.text_hash") == F.col("h.text_hash")) & (F.col("t.run") == F.col("h.run"))
    found = t.join(asked, same).select("digest", "stays", F.explode("keys").alias("key"), "full").dropDuplicates(["digest", "stays", "key", "full"])
    # equal texts of a key are one row by now: two kinds with one text, or the digest is wrong
    compared = found.groupBy("digest", "key").agg(F.count_distinct("full").alias("n_texts"))
    return compared.where("n_texts > 1").select("digest").distinct()


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None, run: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, keep_id, group_size, kept, text_sha256. With a state folder, docs are new
    arrivals after those of earlier runs with the same folder. A run that has a name may be given again with the same docs: it is counted once."""
    spark, run = docs.sparkSession, run or uuid.uuid4().hex
    texts = contents(docs, run, digest)
    if state:
        land(texts.drop("run").withColumn("bucket", _bucket("text_hash")).repartition("bucket"), f"{state}/contents/run={run}", "bucket")
        # the run's name stays text, whatever it looks like
        texts = spark.read.schema("doc_id long, text_hash long, n_points int, full string, digest string, run string, bucket int").parquet(f"{state}/contents")
    state = state or scratch(spark, "dedup-state")
    landing = f"{state}/landing"
    land(arrivals(docs, run, digest), f"{landing}/{run}")
    rows = spark.read.parquet(f"{landing}/{run}").join(absorb(spark, landing, state), "digest")
    wrong = cut(differing(texts, rows), "differing")
    result = rows.select("digest", "doc_id", F.col("locator.text_hash").alias("text_hash"), "keep_id", "group_size", "text_sha256")
    if wrong.limit(1).count():
        right = texts.join(wrong, "digest", "left_semi")
        stays = F.max(F.struct("n_points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("order"), "doc_id")).alias("stays")
        groups = right.groupBy("full").agg(stays, F.count("*").alias("group_size"))
        mended = right.where(F.col("run") == run).join(groups, "full").select("digest", "doc_id", "text_hash", F.col("stays.doc_id").alias("keep_id"), "group_size", sha256(F.col("full")).alias("text_sha256"))
        result = result.join(wrong, "digest", "left_anti").unionByName(mended)
    return result.drop("digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def filter_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    dropped = cut(dedup(docs).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_gone_hash"))
    return docs.join(dropped, same, "left_anti")
