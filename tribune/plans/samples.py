"""The engine's tables made from the driver's synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the date of the order and the time of the event of the same number."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text", "lang as speaker_faction", "source as speaker")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("speech_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("speech_id"), F.date_format("ts", "HHmm").alias("time"))
    url = F.concat(F.lit("https://s.example/"), F.col("speech_id").cast("string"))
    return docs.join(orders, "speech_id").join(events, "speech_id").withColumn("source_url", url)


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as roll calls: a user is present if the event is a view; a voting is an hour."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("session_date"),
        F.date_format("ts", "yyyyMMddHH").alias("voting_uuid"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member_name"),
        F.lit("").alias("faction"),
        F.when(F.col("event_type") == "view", "KOHAL").otherwise("PUUDUB").alias("status"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faction history of customers: from each order to the next, the last one open; neighbouring intervals share a day."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("faction"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), "o_orderkey")
    return orders.selectExpr(
        "name", "faction", "start", "coalesce(lead(start) over (partition by name order by start, o_orderkey), '2099-12-31') as end",
        "cast(row_number() over (partition by name order by start, o_orderkey) - 1 as int) as place",
    )


def verbatims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested sittings: one agenda item for each 64 turns, a turn an event; system turns are no speeches. A long
    conversation is several payloads with one link and date, which its title tells apart; numbers that are far apart share links, too."""
    turns = table(spark, sf_dir, "conversations")
    event = F.struct("turn", F.when(F.col("role") == "system", "NOTE").otherwise("SPEECH").alias("type"), "text", F.concat(F.lit("Esimees Mari "), F.initcap("role")).alias("speaker"))
    grouped = turns.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("block")).agg(F.array_sort(F.collect_list(event)).alias("e"))
    events = F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["speaker"].alias("speaker")))
    link = F.concat(F.lit("https://s.example/20240108"), F.lpad((F.col("conv_id") % 2400).cast("string"), 4, "0"))
    return grouped.select(
        F.when(F.col("conv_id") % 5 != 0, link).alias("link"), F.concat_ws("/", "conv_id", "block").alias("title"),
        F.when(F.col("conv_id") % 7 != 0, F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 700).cast("int")), "yyyy-MM-dd"), F.lit("T13:00:00.000+00:00"))).alias("date"),
        F.array(F.struct(events.alias("events"))).alias("agendaItems"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link per document: even ones end in a session time, odd ones are the url of a page."""
    docs, pages = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "pages").select("page_id", "url")
    made = F.concat(F.lit("https://s.example/2024010"), F.lpad((F.col("doc_id") * 37 % 100_000).cast("string"), 5, "0"))
    joined = docs.join(pages, F.col("doc_id") == F.col("page_id"), "left")
    return joined.select("doc_id", F.when(F.col("doc_id") % 2 == 0, made).otherwise(F.coalesce("url", F.lit(""))).alias("link"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw speaker lines with the name and role that they should split into, by customer number."""
    n = F.col("c_custkey") % 6
    own = F.concat(F.lit("Mari Tamm"), F.col("c_custkey").cast("string"))
    expected_role = F.when(n == 0, "Peaminister").when(n == 1, "Riigikogu esimees").when(n == 2, "Haridus- ja teadusminister").when(n == 3, "väga tähtis")
    raw = F.when(n <= 3, F.concat(expected_role, F.lit(" "), own)).when(n == 4, own).otherwise(F.concat(F.lit("kõneleja"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
