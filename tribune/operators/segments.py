"""The term index in segments: arrivals become immutable segments, deletions are notes on them, merges rewrite the small ones, and a manifest says what counts.

All segments are partitions of one table that is bucketed by speech and sorted by lemma, so a search over any of them plans without an exchange. Lemmas are
numbers there; the dictionary that gives them grows by the lemmas that each arrival brings, with dense ids that never change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from ..tables import cut, cut_bucketed, drop_scratch
from . import index, search
from .analyzer import Analyzer
from .query import parse_query

#: Segments of about one size that are merged when there are so many, and postings up to which a segment is of the smallest size.
FAN, SMALLEST = 4, 100_000
#: Buckets of the table, fixed when it is made.
BUCKETS = 64
#: Up to so many deletions or lemmas (a few bytes each) are broadcast; beyond, deletions are bucketed like the index and lemmas shuffled.
BROADCAST_ROWS = 1_000_000

SEGMENTS, LEMMAS, DELETED = "segments", "lemmas", "deleted"
_LEMMAS, _DELETED = "lemma string, id long", "speech_id long"
_FIRST = 1


def size_tier(n: int) -> int:
    """0 up to SMALLEST postings, and one more for each FAN times as many."""
    tier = 0
    while n > SMALLEST * FAN**tier:
        tier += 1
    return tier


def get_or_create(store: Store, lemmas: DataFrame) -> tuple[dict[str, list[dict]], dict, DataFrame]:
    """Ids for all of `lemmas` (one column, repeats allowed): the parts and notes to commit, and (lemma, id) of the whole dictionary with them.

    New lemmas are numbered where they lie: each task's rows follow those of the tasks before it, whose number is all that is collected.
    """
    known = store.read(LEMMAS, _LEMMAS).drop("part")
    fresh = cut(index.new_lemmas(lemmas, known).select("lemma", F.monotonically_increasing_id().alias("place")), "lemmas")
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.task, r.n) for r in fresh.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # a row per task
    last = store.notes.get("last_id", _FIRST - 1)
    starts, n = [], 0
    for k, own in counts:
        starts.append((k, last + 1 + n))
        n += own
    if not n:
        drop_scratch(fresh)
        return {}, {}, known
    offsets = F.broadcast(store.spark.createDataFrame(starts, "task long, start long"))
    numbered = fresh.withColumns({"task": task, "row": row}).join(offsets, "task").select("lemma", (F.col("start") + F.col("row")).alias("id"))
    part = store.stage(LEMMAS, numbered, first=last + 1, last=last + n)
    drop_scratch(fresh)
    return {LEMMAS: [part]}, {"last_id": last + n}, known.unionByName(store.read_staged(LEMMAS, part, _LEMMAS).drop("part"))


def by_table(rows: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """rows joined with a table that has a row for each key and no nulls, and what is to be dropped when they are read. Of a table beyond BROADCAST_ROWS
    the keys that come most often are broadcast, and only the rows of the others are shuffled: few, as words go. rows are read three times, so they should be written."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key), []
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    weighed = cut(table.join(sizes, key).withColumn("_tier", F.floor(F.log2("_n")).cast("int")).drop("_n"), "weighed")
    least, n = 64, 0
    for tier, own in sorted(((r._tier, r.n) for r in weighed.groupBy("_tier").agg(F.count("*").alias("n")).collect()), reverse=True):  # 63 at most
        n += own
        if n > BROADCAST_ROWS:
            break
        least = tier
    some = lambda often: weighed.where(F.col("_tier") >= least if often else F.col("_tier") < least).drop("_tier")
    value = next(c for c in table.columns if c != key)
    met = rows.join(F.broadcast(some(True)), key, "left")
    rare = met.where(F.col(value).isNull()).select(*rows.columns).join(some(False), key)
    return met.where(F.col(value).isNotNull()).unionByName(rare), [weighed]


class SegmentIndex:
    """An index in a folder, known to the session as the table `name`."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = BUCKETS):
        self.spark, self.name = spark, name
        self.store = Store(spark, root)
        self.buckets = self.store.notes.get("buckets", buckets)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (speech_id BIGINT, lemma_id BIGINT, count BIGINT, segment STRING) USING parquet "
            f"PARTITIONED BY (segment) CLUSTERED BY (speech_id) SORTED BY (lemma_id) INTO {self.buckets} BUCKETS LOCATION '{self.store.root}/_postings'"
        )

    def _write(self, rows: DataFrame) -> dict:
        """Rows (speech_id, lemma_id, count) as a new segment, which does not count yet."""
        segment = f"{self.store.version + 1:010d}-{uuid.uuid4().hex}"
        dealt = rows.select("speech_id", "lemma_id", "count", F.lit(segment).alias("segment")).repartition(self.buckets, "speech_id")
        writer = dealt.write.format("parquet").mode("append").partitionBy("segment").bucketBy(self.buckets, "speech_id").sortBy("lemma_id")
        writer.option("path", f"{self.store.root}/_postings").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return {"id": segment, "n": self._of([segment]).count()}

    def _of(self, segments: list[str]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("segment").isin(segments))

    def _buried(self, rows: DataFrame) -> DataFrame:
        """rows of segments without those of speeches that were deleted after their segment was written."""
        parts = self.store.parts(DELETED)
        if not parts:
            return rows
        gone = [self.store.read(DELETED, _DELETED, only=lambda p, i=part["id"]: p["id"] == i).select(F.col("speech_id"), F.lit(part["at"]).alias("_at")) for part in parts]
        every = gone[0]
        for other in gone[1:]:
            every = every.unionByName(other)
        last = every.groupBy(F.col("speech_id")).agg(F.max("_at").alias("_at"))
        if sum(p["n"] for p in parts) <= BROADCAST_ROWS:
            last = F.broadcast(last)
        else:
            last = cut_bucketed(last, "deleted", "speech_id", self.buckets)
        written = F.left("segment", F.lit(10)).cast("long")
        return rows.join(last, "speech_id", "left").where(F.col("_at").isNull() | (F.col("_at") < written)).drop("_at")

    def live(self) -> DataFrame:
        """(speech_id, lemma_id, count) of what counts."""
        self.store.refresh()
        return self._buried(self._of([p["id"] for p in self.store.parts(SEGMENTS)])).select("speech_id", "lemma_id", "count")

    def add(self, speeches: DataFrame, analyzer: Analyzer) -> None:
        """Index speeches (speech_id, text) that are not in it. Their segment and their new lemmas count together."""
        found = cut(index.postings(speeches, analyzer), "arrival")
        parts, notes, dictionary = get_or_create(self.store, found.select("lemma"))
        rows, held = by_table(found, dictionary.select("lemma", F.col("id").alias("lemma_id")), "lemma")
        segment = self._write(rows)
        self.store.commit(parts | {SEGMENTS: [segment]}, notes=notes | {"buckets": self.buckets})
        drop_scratch(found, *held)

    def delete(self, speeches: DataFrame) -> None:
        """Take speeches (speech_id) out; those that are added later are in again."""
        part = self.store.stage(DELETED, speeches.select("speech_id").distinct(), at=self.store.version + 1)
        part["n"] = self.store.read_staged(DELETED, part, _DELETED).count()
        self.store.commit({DELETED: [part]})

    def merge(self, fan: int = FAN) -> int:
        """Merge segments of one size where there are `fan` of them, and their results again, until there are none; returns how many merges it took. Deleted
        speeches are left out, and deletions older than all segments are forgotten."""
        done = 0
        while True:
            tiers: dict[int, list[dict]] = {}
            for p in self.store.parts(SEGMENTS):
                tiers.setdefault(size_tier(p["n"]), []).append(p)
            ready = sorted((k, own) for k, own in tiers.items() if len(own) >= fan)
            if not ready:
                return done
            old = [p["id"] for p in ready[0][1]]
            merged = self._write(self._buried(self._of(old)))
            rest = [p["id"] for p in self.store.parts(SEGMENTS) if p["id"] not in old]
            oldest = min(int(i[:10]) for i in [*rest, merged["id"]])
            forgotten = [p["id"] for p in self.store.parts(DELETED) if p["at"] < oldest]
            self.store.commit({SEGMENTS: [merged]}, drop={SEGMENTS: old, DELETED: forgotten})
            done += 1

    def clean(self) -> None:
        """Delete segments and parts that no longer count; not while a search or a change is under way."""
        self.store.clean()
        live = {f"segment={p['id']}" for p in self.store.parts(SEGMENTS)}
        folder = self.store._path(f"{self.store.root}/_postings")
        for s in self.store.fs.listStatus(folder):
            if s.getPath().getName().startswith("segment=") and s.getPath().getName() not in live:
                self.store.fs.delete(s.getPath(), True)
        self.spark.catalog.refreshTable(self.name)

    def lemma_ids(self, words: list[str]) -> dict[str, int]:
        """Ids of a few words; those that no speech has are missing."""
        return {r.lemma: r.id for r in self.store.read(LEMMAS, _LEMMAS).where(F.col("lemma").isin(words)).collect()}

    def match(self, query: str, analyzer: Analyzer) -> DataFrame:
        """(speech_id, count) of the speeches that match a query."""
        groups = parse_query(query, analyzer)
        ids = self.lemma_ids(sorted({w for g in groups for w in g}))
        # a word that no speech has makes its alternative unsatisfiable
        own = [[ids.get(w, _FIRST - 1) for w in g] for g in groups]
        return search.match(self.live().withColumnRenamed("lemma_id", "lemma"), own)

    def postings(self) -> DataFrame:
        """(speech_id, lemma, count) of what counts."""
        rows, _ = by_table(self.live(), self.store.read(LEMMAS, _LEMMAS).select("lemma", F.col("id").alias("lemma_id")), "lemma_id")
        return rows.select("speech_id", "lemma", "count")
