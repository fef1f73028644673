"""From documents to token ids: quality, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribune.llm import exact_dedup, mixing, ngram_join, pieces, quality
from tribune.tables import cut
from tribune.llm.queries import PIECES, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learned from the labelled ones among docs."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    weights = quality.train(docs, table(spark, sf_dir, "labels"), learnable=~held)
    return quality.score(docs, weights).where(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, as operator 6 keeps it."""
    return exact_dedup.filter_kept(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    return ngram_join.filter_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a random order."""
    return mixing.mix_sources(docs, mixing.TARGETS).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mixture."""
    return pieces.encode(docs.select("doc_id", "source", "text"), pieces.read_model(PIECES), check=True).drop("text")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding", encoded),
]

#: The classifier's training and the streaming state are beyond SQL; tests/llm compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
