"""Search, activity and top speakers over matches of keyword groups.

A speech matches when it has all lemmas of any group; its weight is the number of occurrences of all lemmas of all groups, also of
those groups that it does not satisfy.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .analyzer import Analyzer


def _all(groups: list[list[str]]) -> list[str]:
    return list(dict.fromkeys(w for g in groups for w in g))


def match(index: DataFrame, groups: list[list[str]], also: tuple[str, ...] = ()) -> DataFrame:
    """(speech_id, count) of matches, from the index: one filtered scan and one aggregation for any number of groups. also: columns of the
    speech that the index repeats, returned with them."""
    if not groups:
        return index.select("speech_id", "count", *also).limit(0)
    hit = [F.count_if(F.col("lemma").isin(g)).alias(f"g{k}") for k, g in enumerate(groups)]
    found = index.where(F.col("lemma").isin(_all(groups))).groupBy("speech_id", *also).agg(F.sum("count").alias("count"), *hit)
    return found.where(reduce(or_, (F.col(f"g{k}") == len(g) for k, g in enumerate(groups)))).select("speech_id", "count", *also)


def match_texts(speeches: DataFrame, groups: list[list[str]], analyzer: Analyzer) -> DataFrame:
    """speeches that match, with count, straight from their texts: a projection and a filter without any shuffle."""
    words = _all(groups)
    if not groups:
        return speeches.withColumn("count", F.lit(0).cast("long")).limit(0)
    if analyzer.by_substring:  # cheaper than tokens, and drops most rows
        speeches = speeches.where(reduce(or_, (F.lower("text").contains(w) for w in words)))
    # counts first, tokens once: the tokens stay in one expression that the optimiser does not repeat
    rows = speeches.withColumn("_hits", F.filter(analyzer.tokens(F.col("text")), lambda w: w.isin(words)))
    has: dict[str, Column] = {w: F.array_contains("_hits", w) for w in words}
    ok = [F.lit(False) if len(set(g)) < len(g) else reduce(and_, (has[w] for w in g)) for g in groups]
    return rows.where(reduce(or_, ok)).withColumn("count", F.size("_hits").cast("long")).drop("_hits")


def attach(speeches: DataFrame, matches: DataFrame) -> DataFrame:
    """speeches that match, with count, from (speech_id, count)."""
    return speeches.join(matches, "speech_id")


def newest(found: DataFrame, limit: int = 50) -> DataFrame:
    """The newest of matched speeches with count: speaker, text, count, date, time, source_url. Each task keeps `limit` rows, in one pass."""
    return found.orderBy(F.desc("date"), F.desc("time"), "speech_id").limit(limit).select("speaker", "text", "count", "date", "time", "source_url")


def search(speeches: DataFrame, matches: DataFrame, limit: int = 50) -> DataFrame:
    """The same from an index: the narrow columns of speeches are joined and cut to the limit, and texts are joined to its rows only."""
    # at most `limit` (200) rows are broadcast to fetch the texts
    top = attach(speeches.select("speech_id", "date", "time"), matches).orderBy(F.desc("date"), F.desc("time"), "speech_id").limit(limit)
    return newest(attach(speeches.select("speech_id", "speaker", "text", "source_url"), F.broadcast(top)), limit)


def activity(found: DataFrame, interval: str = "weekly", metric: str = "speeches") -> DataFrame:
    """Matched speeches (date, count), or with metric mentions their weights, by day, week or month in order; months without any are filled with 0."""
    bucket, name = dates.period(F.col("date"), interval)
    counted = F.count("*") if metric == "speeches" else F.sum("count")
    rows = found.groupBy(bucket.alias(name)).agg(counted.alias("count"))
    if interval == "monthly":
        # a row per month is little: they become one map, so that the texts are not asked again for the first and last month
        known = rows.where(F.col(name).isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(name, "count"))).alias("known"), F.min(name).alias("lo"), F.max(name).alias("hi"))
        month = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
        every = known.where("lo is not null").select("known", F.explode(F.sequence(month("lo"), month("hi"), F.expr("interval 1 month"))).alias("m"))
        every = every.select("known", F.date_format("m", "yyyy-MM").alias(name))
        rows = every.select(name, F.coalesce(F.col("known")[F.col(name)], F.lit(0)).cast("long").alias("count"))
    return rows.orderBy(name)


def top_speakers(found: DataFrame, limit: int = 20) -> DataFrame:
    """Speakers of matched speeches (speaker, count) by summed weight; a negative limit means all of them."""
    rows = found.groupBy("speaker").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "speaker")
    return rows if limit < 0 else rows.limit(limit)
