"""Queries over stores that are built in several steps: segments of the index, ids of lemmas, rejected lines, with SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import archive, search
from .operators.analyzer import SimpleAnalyzer
from .operators.query import parse_query
from .operators.segments import LEMMAS, SegmentIndex
from .plans import jobs, samples
from .plans.publish import Aside
from .sources.store import Store
from .tables import scratch

ANALYZER = SimpleAnalyzer()
COMBINED, RARE = "the that, pour par", "ciónas"
#: Stored indexes by application and data folder: one is built for a session, and searches of it are searches only.
_built: dict[tuple[str, str], SegmentIndex] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text")


def _new(spark: SparkSession, what: str) -> SegmentIndex:
    return SegmentIndex(spark, scratch(spark, what), f"{what}_{uuid.uuid4().hex}", buckets=16)


def stored_index(spark: SparkSession, sf_dir: str) -> SegmentIndex:
    """The index of the documents as one segment, built by the first who asks in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = _new(spark, "postings")
        _built[key].add(_docs(spark, sf_dir), ANALYZER)
    return _built[key]


def stored_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the build leaves: lemmas, postings, and occurrences, of the stored index."""
    live = stored_index(spark, sf_dir).live()
    return live.agg(F.count_distinct("lemma_id").alias("n_lemmas"), F.count("*").alias("n_postings"), F.sum("count").alias("n_occurrences"))


def stored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).match(COMBINED, ANALYZER)


def stored_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(samples.speeches(spark, sf_dir), stored_match(spark, sf_dir), 50)


def stored_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored_index(spark, sf_dir).match(RARE, ANALYZER)
    return search.activity(search.attach(samples.speeches(spark, sf_dir).select("speech_id", "date"), found), "monthly")


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest matches by periods, read from the newest back; those of a second arrival among them."""
    store = Store(spark, scratch(spark, "archive"))
    for k in range(2):
        archive.add(store, samples.speeches(spark, sf_dir).where(F.col("speech_id") % 2 == k), ANALYZER)
    return archive.newest(store, parse_query(COMBINED, ANALYZER), 50)[0]


def _in_arrivals(spark: SparkSession, sf_dir: str) -> tuple[SegmentIndex, list[int]]:
    """Documents by the remainder of their number by three, one arrival each; the last id after each."""
    own, last = _new(spark, "arrivals"), []
    for k in range(3):
        own.add(_docs(spark, sf_dir).where(F.col("speech_id") % 3 == k), ANALYZER)
        last.append(own.store.notes["last_id"])
    return own, last


def index_in_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals, some speeches deleted, a merge, more deleted, some of the first back."""
    own, _ = _in_arrivals(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    own.delete(docs.where("speech_id % 10 = 7"))
    own.merge(fan=3)
    own.delete(docs.where("speech_id % 10 = 4"))
    own.add(docs.where("speech_id % 20 = 7"), ANALYZER)
    return own.postings()


def index_in_arrivals_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = _in_arrivals(spark, sf_dir)
    own.delete(_docs(spark, sf_dir).where("speech_id % 10 = 7"))
    return own.match(COMBINED, ANALYZER)


def lemma_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrival in which each lemma got its id, and whether ids are dense: 1 to their number."""
    own, last = _in_arrivals(spark, sf_dir)
    ids = own.store.read(LEMMAS, "lemma string, id long")
    dense = ids.agg((F.count("*") == F.max("id")).alias("a"), (F.count_distinct("id") == F.max("id")).alias("b"), (F.min("id") == 1).alias("c")).select((F.col("a") & F.col("b") & F.col("c")).alias("dense"))
    arrival = F.when(F.col("id") <= last[0], 0).when(F.col("id") <= last[1], 1).otherwise(2)
    return ids.select("lemma", arrival.alias("arrival")).crossJoin(F.broadcast(dense))  # one row


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are cut short and some lack a speaker or a text, loaded twice: what is stored of good and of bad ones."""
    lines, speeches = scratch(spark, "lines"), scratch(spark, "speeches")
    n = F.col("doc_id")
    row = F.struct(
        F.lit("2024-01-08").alias("date"), F.lit("1500").alias("time"), n.cast("string").alias("source_file"), F.lit("u").alias("source_url"),
        F.when(n % 7 != 0, F.col("source")).alias("speaker"), F.when(n % 5 != 0, F.col("text")).alias("text"),
    )
    whole = F.to_json(row)
    line = F.when(n % 11 == 0, F.concat(F.left(whole, F.lit(40)), n.cast("string"))).otherwise(whole)
    samples.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(f"{lines}/written")
    # text files are none that loaders take, so they move to names that are
    aside = Aside(spark, lines)
    for k, name in enumerate(aside._files(f"{lines}/written")):
        aside._move(f"{lines}/written/{name}", f"{lines}/{k}.jsonl")
    for _ in range(2):
        jobs.load_speeches(spark, f"{lines}/*.jsonl", speeches)
    good = jobs.stored(spark, speeches, schemas.SPEECHES).select(F.lit("good").alias("reason"))
    bad = Store(spark, speeches).read(jobs.REJECTED, schemas.REJECTED).select("reason")
    return good.unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (stored_build, stored_match, stored_top50, stored_activity, newest_first, index_in_arrivals, index_in_arrivals_search, lemma_ids, rejected_lines)
}


def oracles(found: dict[str, str], terms: str) -> dict[str, str]:
    """SQL of these queries; found: that of searches without a stored index, terms: the common table of postings."""
    return {
        "stored_build": f"WITH {terms} SELECT count(DISTINCT lemma) AS n_lemmas, count(*) AS n_postings, sum(cnt)::BIGINT AS n_occurrences FROM terms",
        "stored_match": found["search_combined"],
        "stored_top50": found["search_top50"],
        "stored_activity": found["activity_monthly_filled"],
        "newest_first": found["search_top50"],
        "index_in_arrivals": f"WITH {terms} SELECT speech_id, lemma, cnt AS count FROM terms WHERE speech_id % 20 = 7 OR speech_id % 10 NOT IN (4, 7)",
        "index_in_arrivals_search": f"SELECT * FROM ({found['search_combined']}) WHERE speech_id % 10 <> 7",
        "lemma_ids": f"WITH {terms} SELECT lemma, min(speech_id % 3)::INTEGER AS arrival, true AS dense FROM terms GROUP BY lemma",
        "rejected_lines": """WITH r AS (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 'malformed' WHEN doc_id % 35 = 0 THEN 'without speaker, text' WHEN doc_id % 7 = 0 THEN 'without speaker' WHEN doc_id % 5 = 0 THEN 'without text' ELSE 'good' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    }
