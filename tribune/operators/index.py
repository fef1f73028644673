"""The term index: one posting (speech_id, lemma, count) for each lemma of each speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analyzer import Analyzer, DictionaryAnalyzer

#: Bytes of text whose postings a task counts: they bound its memory, some 50 times that, whatever the size of the table.
PART_BYTES = 8_000_000
#: Up to so many ids of speeches (8 bytes each) are broadcast; beyond, a task holds those of its part of the speeches.
BROADCAST_ROWS = 1_000_000


def lemmatised(speeches: DataFrame, analyzer: Analyzer) -> DataFrame:
    """speeches with text_lemmas filled where it is null or empty (space between lemmas)."""
    own = F.array_join(analyzer.tokens(F.col("text")), " ")
    return speeches.withColumn("text_lemmas", F.when(F.coalesce("text_lemmas", F.lit("")) == "", own).otherwise(F.col("text_lemmas")))


def postings(speeches: DataFrame, analyzer: Analyzer, parts: int | None = None) -> DataFrame:
    """Postings of speeches (speech_id, text). Texts are dealt by speech before they are split, as they are smaller than their postings: counting then needs no
    shuffle. They are dealt to as many tasks as their size asks. Forms become lemmas when they are counted, so a frequent word is asked for once a speech."""
    dealt = speeches.select("speech_id", "text")
    if parts is None:
        size = dealt.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(dealt.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    dealt = dealt.repartition(parts, "speech_id")
    words = dealt.select("speech_id", F.explode(analyzer.forms(F.col("text"))).alias("lemma"))
    counted = words.groupBy("speech_id", "lemma").agg(F.count("*").alias("count"))
    unified = analyzer.unify(counted)
    return counted if unified is counted else unified.groupBy("speech_id", "lemma").agg(F.sum("count").alias("count"))


def postings_of(speeches: DataFrame, analyzer: DictionaryAnalyzer, lemmas: list[str]) -> DataFrame:
    """The postings that a few lemmas have, straight from the texts: words that are none of their forms go before anything is counted or shuffled."""
    words = speeches.select("speech_id", F.explode(analyzer.forms(F.col("text"))).alias("form"))
    found = words.join(F.broadcast(analyzer.forms_of(lemmas)), "form")  # the forms of some words
    return found.groupBy("speech_id", F.col("_lemma").alias("lemma")).agg(F.count("*").alias("count"))


def without(speeches: DataFrame, ids: DataFrame) -> DataFrame:
    """speeches whose speech_id is not among ids; their texts are never sorted, and not shuffled where ids are few."""
    ids = ids.select("speech_id").distinct()
    return speeches.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("shuffle_hash"), "speech_id", "left_anti")


def dictionary(index: DataFrame) -> DataFrame:
    """Each lemma with the number of speeches and of occurrences."""
    return index.groupBy("lemma").agg(F.count("*").alias("n_speeches"), F.sum("count").alias("n_occurrences"))


def new_lemmas(index: DataFrame, known: DataFrame) -> DataFrame:
    """Lemmas of the index that the dictionary `known` lacks."""
    return index.select("lemma").distinct().join(known, "lemma", "left_anti")


def missing(speeches: DataFrame, index: DataFrame) -> DataFrame:
    """Speeches without any posting."""
    return without(speeches, index)


def extend(speeches: DataFrame, index: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Postings of the speeches that have none yet, to be appended."""
    return postings(missing(speeches, index), analyzer)


def save(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Write the index bucketed by speech and sorted by lemma: matching then needs no shuffle, and a filter on lemmas skips row groups."""
    index.write.bucketBy(buckets, "speech_id").sortBy("lemma").mode("overwrite").saveAsTable(table)
