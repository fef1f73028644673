"""Incremental ingestion as a stream: verbatims in landing files to speeches by year, each sitting once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dates
from ..operators.analyzer import Analyzer
from ..plans import ingest
from ..schemas import VERBATIMS


def sittings(spark: SparkSession, landing: str, forget_after: str | None = None, in_parts: bool = False) -> DataFrame:
    """A stream of dated verbatims, one per uid. By default uids are remembered for good (a few thousand in years); with
    forget_after (such as `14 days`) only within that watermark of the sitting's day. in_parts: several payloads may have one uid (parts of a long
    sitting, or links that serve several), so that only a payload that is the same in all its fields is a repeat."""
    rows = ingest.dated(spark.readStream.schema(VERBATIMS).json(landing))
    key = ["uid"]
    if in_parts:
        key = ["uid", "payload"]
        rows = rows.withColumn("payload", F.unhex(F.sha2(F.to_json(F.struct("link", "title", "date", "agendaItems")), 256)))
    if forget_after is None:
        return rows.dropDuplicates(key)
    return rows.withColumn("at", F.to_timestamp("day")).withWatermark("at", forget_after).dropDuplicatesWithinWatermark(key).drop("at")


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, history: DataFrame, analyzer: Analyzer, forget_after: str | None = None, in_parts: bool = False) -> StreamingQuery:
    """Start a query that takes all files that are there, appends their speeches to year folders of JSON lines, and ends."""
    rows = ingest.speeches_of(sittings(spark, landing, forget_after, in_parts), history, analyzer)
    rows = rows.withColumn("year", F.year(dates.day(F.col("date"))))
    return rows.writeStream.format("json").partitionBy("year").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _period_end(at: Column, interval: str) -> Column:
    """The first moment after the month or week of a moment; a week ends with its year at the latest."""
    year = F.date_trunc("year", at) + F.expr("interval 1 year")
    if interval == "monthly":
        return F.date_trunc("month", at) + F.expr("interval 1 month")
    return F.least(F.date_trunc("week", at) + F.expr("interval 7 days"), year)


def _count_period(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The count of a period so far, as long as the watermark has not passed its end; then its state goes."""
    if state.hasTimedOut:
        state.remove()
        return
    n, end = 0, 0
    for part in rows:
        n += len(part)
        end = max(end, int(part["end_ms"].iloc[0]))
    if end <= state.getCurrentWatermarkMs():
        return  # closed: what is that late no longer counts
    total = n + (state.get[0] if state.exists else 0)
    state.update((total,))
    state.setTimeoutTimestamp(end)
    yield pd.DataFrame({"period": [key[0]], "count": [total]})


def counts(rows: DataFrame, interval: str = "daily", late: str = "14 days") -> DataFrame:
    """Streaming counts of speeches (a `date` column of text) by day, week or month; sittings up to `late` behind the newest still count. A period is
    updated until the newest day is so far past its end; then its state is dropped, and later sittings of it no longer count. Days are
    windows; weeks, which end with the year, and months are no windows of one length, and keep a count with a timer each. Rows without a date drop out."""
    at = rows.withColumn("at", F.to_timestamp(dates.day(F.col("date")))).where("at is not null").withWatermark("at", late)
    if interval == "daily":
        return at.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("count")).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "count")
    bucket, name = dates.period(F.col("date"), interval)
    each = at.select(bucket.alias("period"), "at", F.unix_millis(_period_end(F.col("at"), interval)).alias("end_ms"))
    counted = each.groupBy("period").applyInPandasWithState(_count_period, "period string, count long", "count long", "update", GroupStateTimeout.EventTimeTimeout)
    return counted.withColumnRenamed("period", name)
