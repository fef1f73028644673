"""Text to lemmas. Index and queries must use the same analyzer."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Up to so many rows of a dictionary (two words, some 100 bytes there) are broadcast; beyond, forms are shuffled.
BROADCAST_ROWS = 2_000_000


class Analyzer(Protocol):
    def tokens(self, text: Column) -> Column:
        """Lemmas of a text, an array of strings in order; empty for null."""

    def forms(self, text: Column) -> Column:
        """What unify() makes lemmas of: the words of a text, or its lemmas where these come at once."""

    def tokens_of(self, *texts: str) -> list[list[str]]:
        """The same for each of a few texts on the driver."""

    def unify(self, words: DataFrame) -> DataFrame:
        """Rows with one of the forms in `lemma`, with its lemma there instead. Forms are few beside the words of texts, so count them first."""


class SimpleAnalyzer:
    """Lower-case words of letters only, as column functions. It does not unify inflected forms."""

    #: A row can hold a lemma only if its lower-case text contains it.
    by_substring = True

    def tokens(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
        return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.rlike(r"^\p{L}+$"))

    def forms(self, text: Column) -> Column:
        return self.tokens(text)

    def tokens_of(self, *texts: str) -> list[list[str]]:
        # through the same expression, so that letters and cases mean the same
        spark = SparkSession.getActiveSession()
        # an Arrow table becomes a local relation, which the optimiser evaluates without a job
        rows = spark.createDataFrame(pa.table({"place": list(range(len(texts))), "text": list(texts)})).select("place", self.tokens(F.col("text")).alias("t"))
        return [list(r.t) for r in sorted(rows.collect())]

    def unify(self, words: DataFrame) -> DataFrame:
        return words


class DictionaryAnalyzer(SimpleAnalyzer):
    """Words of letters, unified by a table of forms and their lemmas (form, lemma; lower case; of several lemmas of a form the first in order of
    letters). Words that it does not hold are their own lemmas. The table is joined: broadcast up to BROADCAST_ROWS, which are counted once, and shuffled beyond, so
    it may be of any size. It serves the index and queries on it; for lemmas of texts as a column, LemmaAnalyzer has to hold the table."""

    by_substring = False

    def __init__(self, dictionary: DataFrame):
        self.given = dictionary
        self.dictionary = dictionary.groupBy("form").agg(F.min("lemma").alias("_lemma"))
        self._small: bool | None = None

    def forms(self, text: Column) -> Column:
        return super().tokens(text)

    def tokens(self, text: Column) -> Column:
        raise TypeError("a joined table gives no lemmas as a column: use lemmas.LemmaAnalyzer")

    def unify(self, words: DataFrame) -> DataFrame:
        if self._small is None:
            self._small = self.dictionary.count() <= BROADCAST_ROWS
        # Spark broadcasts by size, which a table of many forms passes long before it is too large: rows would be shuffled to it and back
        table = F.broadcast(self.dictionary) if self._small else self.dictionary
        return words.join(table, F.col("lemma") == F.col("form"), "left").withColumn("lemma", F.coalesce("_lemma", "lemma")).drop("form", "_lemma")

    def forms_of(self, lemmas: list[str]) -> DataFrame:
        """(form, _lemma) of all forms of a few lemmas, those that the table does not hold included. Filters reach the table before it is grouped."""
        own = self.given.sparkSession.createDataFrame(pa.table({"form": lemmas})) if lemmas else self.given.select("form").limit(0)
        some = self.given.where(F.col("lemma").isin(lemmas) | F.col("form").isin(lemmas)).select("form").distinct()
        rows = self.given.select("form", "lemma").join(F.broadcast(some), "form", "left_semi").union(own.select("form", F.lit(None).cast("string")))
        asked = rows.groupBy("form").agg(F.min("lemma").alias("_lemma"))
        return asked.withColumn("_lemma", F.coalesce("_lemma", "form")).where(F.col("_lemma").isin(lemmas))

    def tokens_of(self, *texts: str) -> list[list[str]]:
        split = SimpleAnalyzer().tokens_of(*texts)
        asked = {w for own in split for w in own}
        lemma = {r.form: r._lemma for r in self.dictionary.where(F.col("form").isin(sorted(asked))).collect()}  # a row per word of the query
        return [[lemma.get(w, w) for w in own] for own in split]


class PandasAnalyzer:
    """Any Python lemmatiser: lemmas(text) gives the lemma of each word, of which those of letters only are kept, lower case."""

    by_substring = False

    def __init__(self, lemmas: Callable[[str], list[str]]):
        self.lemmas = lemmas

    def _of(self, text: str) -> list[str]:
        return [w.lower() for w in self.lemmas(text) if w.isalpha()] if text else []

    def tokens_of(self, *texts: str) -> list[list[str]]:
        return [self._of(t) for t in texts]

    def unify(self, words: DataFrame) -> DataFrame:
        return words

    def forms(self, text: Column) -> Column:
        return self.tokens(text)

    def tokens(self, text: Column) -> Column:
        own = self._of

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: own(t or ""))

        return run(text)
