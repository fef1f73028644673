"""Speeches and their postings by period, for searches that want the newest first: periods are read from the newest back, until there are enough.

A store's tables `rows` (the speeches) and `postings` are partitioned by year or month; the manifest tells which periods a part has and how many speeches in
each. As every match of a period is newer than any of an earlier one, a search may end with the period that fills its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import ROWS, Store
from ..tables import cut, drop_scratch
from . import index, search
from .analyzer import Analyzer

POSTINGS = "postings"
#: Where speeches without a date are: behind all others, as in any search.
UNDATED = "a"
_SPEECHES = "speech_id long, date string, time string, speaker string, text string, source_url string"
_POSTINGS = "speech_id long, date string, time string, lemma string, count long"


def period_of(date: Column, months: bool = False) -> Column:
    """The year (or month) with which a date begins, as text that sorts as dates do: dates are compared as text, so one that is none has its place, too."""
    return F.coalesce(F.concat(F.lit("d"), F.left(date, F.lit(7 if months else 4))), F.lit(UNDATED))


def add(store: Store, speeches: DataFrame, analyzer: Analyzer, months: bool = False) -> None:
    """Append speeches (of _SPEECHES' columns) that are not there yet, with their postings; both count together."""
    names = [c.split()[0] for c in _SPEECHES.split(", ")]
    rows = cut(speeches.select(*names, period_of(F.col("date"), months).alias("period")), "speeches")
    sizes = {r.period: r.n for r in rows.groupBy("period").agg(F.count("*").alias("n")).collect()}  # a row per period
    if sizes:
        found = index.postings(rows.select("speech_id", "text"), analyzer).join(rows.select("speech_id", "date", "time", "period"), "speech_id")
        # a period's postings in a few files, sorted by lemma, so that readers skip what holds none of a query's words
        found = found.repartition("period", F.pmod(F.xxhash64("speech_id"), F.lit(8))).sortWithinPartitions("period", "lemma")
        kept = store.stage(ROWS, rows.repartition("period", F.pmod(F.xxhash64("speech_id"), F.lit(8))), by=("period",), periods=sizes)
        store.commit({ROWS: [kept], POSTINGS: [store.stage(POSTINGS, found, by=("period",), periods=sizes)]})
    drop_scratch(rows)


def _read(store: Store, table: str, schema: str, periods: list[str]) -> DataFrame:
    """The rows of some periods: only parts that have one of them, and only its folders."""
    rows = store.read(table, f"{schema}, period string", only=lambda p: bool(set(p["periods"]) & set(periods)))
    return rows.where(F.col("period").isin(periods))


def newest(store: Store, groups: list[list[str]], limit: int = 50) -> tuple[DataFrame, list[str]]:
    """The newest matches (speaker, text, count, date, time, source_url), as search.search() has them, and the periods that were read.

    Twice as many periods are read at a time as before, so a rare word costs few jobs more than a single pass, and a frequent one reads the newest
    periods only. What the driver holds are up to `limit` narrow rows.
    """
    left = sorted({p for part in store.parts(POSTINGS) for p in part["periods"]}, reverse=True)
    read: list[str] = []
    top: list[tuple] = []
    step = 1
    while groups and left and len(top) < limit:
        now, left = left[:step], left[step:]
        index_ = _read(store, POSTINGS, _POSTINGS, now)
        found = search.match(index_, groups, also=("date", "time"))
        # of what is older than all that was found, as much as is still wanted
        some = found.orderBy(F.desc("date"), F.desc("time"), "speech_id").limit(limit - len(top))
        top += [(r.speech_id, r["count"]) for r in some.collect()]
        read += now
        step *= 2
    chosen = F.broadcast(store.spark.createDataFrame(top, "speech_id long, count long"))  # limit rows
    speeches = _read(store, ROWS, _SPEECHES, read or [UNDATED]).drop("part", "period")
    return search.newest(search.attach(speeches, chosen), limit), read
