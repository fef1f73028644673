"""Lemmas of inflected forms: a table of known forms, and for all others rules by suffix that are learned from it.

A rule says what a form loses at its end and what is put there instead. Learning counts, for each suffix of the known forms, the rules
that fit it; each suffix ranks its rules by how often they hold. A form that is not in the table takes the first rule of the longest suffix
it shares with any. A leading `^` marks the beginning of a word, so that short words can have rules of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import cut, drop_scratch
from .analyzer import SimpleAnalyzer

#: Letters of the longest suffix, and forms that must show a rule before it counts.
LONGEST, LEAST = 6, 2
#: Entries (forms that are exceptions to the rules, and rules) that an analyzer may send to its workers; some 200 MB there. Beyond, build the index by DictionaryAnalyzer's join.
MOST = 2_000_000

WORDS = "form string, lemma string"
RULES = "suffix string, cut int, add string, n long, place int"


def known_forms(dictionary: DataFrame) -> DataFrame:
    """One lemma for each form of a dictionary (form, lemma): of several the first in order of letters. Nulls and empty ones drop out."""
    rows = dictionary.select(F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).where("form <> '' and lemma <> ''")
    return rows.groupBy("form").agg(F.min("lemma").alias("lemma"))


def learn(dictionary: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Ranked rules (suffix, cut, add, n, place) of a dictionary: place 1 is a suffix's first analysis.

    Suffixes whose first rule is that of the suffix one letter shorter are left out, as the search then ends there with the same lemma.
    """
    pairs = known_forms(dictionary)
    shorter = F.least(F.length("form"), F.length("lemma"))
    same = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda k: F.left("form", k) == F.left("lemma", k)))
    rules = pairs.select("form", (F.length("form") - same).alias("cut"), F.substring("lemma", same + 1, F.length("lemma")).alias("add"))
    marked = F.concat(F.lit("^"), F.col("form"))
    lengths = F.sequence(F.col("cut"), F.greatest(F.col("cut"), F.least(F.length(marked), F.lit(longest))))
    each = rules.select(F.explode(F.transform(lengths, lambda k: F.right(marked, k))).alias("suffix"), "cut", "add")
    counted = each.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("suffix").orderBy(F.desc("n"), "cut", "add")))
    parent = ranked.where("place = 1").select(F.col("suffix").alias("_parent"), F.col("cut").alias("_cut"), F.col("add").alias("_add"))
    first = ranked.where("place = 1").join(parent, F.expr("suffix <> '' and _parent = substring(suffix, 2)"), "left")
    needed = first.where("_cut is null or _cut <> cut or _add <> add").select("suffix")
    return ranked.join(needed, "suffix").select("suffix", F.col("cut").cast("int").alias("cut"), "add", "n", F.col("place").cast("int").alias("place"))


class Lemmatiser:
    """What an analyzer knows, in a worker."""

    def __init__(self, words: Iterable[tuple[str, str]], rules: Iterable[tuple[str, int, str, int]]):
        self.words = dict(words)
        self.rules: dict[str, list[tuple[int, str]]] = {}
        for suffix, cut, add, _ in sorted(rules, key=lambda r: r[3]):
            self.rules.setdefault(suffix, []).append((cut, add))
        self.longest = max(map(len, self.rules), default=-1)
        self.found: dict[str, str] = {}

    def analyses(self, form: str) -> list[str]:
        """Lemmas of a form, best first: the known one alone, else those of the longest suffix with rules, else the form itself."""
        if form in self.words:
            return [self.words[form]]
        marked = f"^{form}"
        for k in range(min(self.longest, len(marked)), -1, -1):
            for_it = self.rules.get(marked[len(marked) - k :])
            if for_it:
                # a rule may take a whole word, but leaves no empty lemma
                return [x for cut, add in for_it if (x := form[: len(form) - cut] + add)] or [form]
        return [form]

    def lemma(self, form: str) -> str:
        got = self.found.get(form)
        if got is None:
            if len(self.found) > 500_000:
                self.found.clear()
            got = self.found[form] = self.analyses(form)[0]
        return got


class LemmaAnalyzer(SimpleAnalyzer):
    """Words of letters by their lemmas: one object for the index, lemma columns, texts and queries, which all ask the same table and rules.

    words (form, lemma) and rules (of learn()) are counted before they are sent to the workers, and refused beyond `most` entries.
    """

    by_substring = False

    def __init__(self, words: DataFrame, rules: DataFrame | None = None, most: int = MOST):
        known = known_forms(words)
        rules = words.sparkSession.createDataFrame([], RULES) if rules is None else rules
        size = known.count() + rules.count()
        if size > most:
            raise ValueError(f"{size} exceptions and rules, more than {most}: raise `least`, or use DictionaryAnalyzer, which joins its table")
        self.model = Lemmatiser([tuple(r) for r in known.collect()], [(r.suffix, r.cut, r.add, r.place) for r in rules.collect()])
        self._shared = words.sparkSession.sparkContext.broadcast((list(self.model.words.items()), [(s, c, a, k) for s, own in self.model.rules.items() for k, (c, a) in enumerate(own)]))

    @classmethod
    def learned(cls, dictionary: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> LemmaAnalyzer:
        """An analyzer of a dictionary and the rules learned from it."""
        rules = cut(learn(dictionary, longest, least), "rules")
        own = cls(exceptions(known_forms(dictionary), rules), rules, most)
        drop_scratch(rules)
        return own

    def forms(self, text: Column) -> Column:
        return super().tokens(text)

    def tokens(self, text: Column) -> Column:
        shared = self._shared

        @F.pandas_udf("array<string>")
        def run(forms: pd.Series) -> pd.Series:
            lemma = _in_worker(shared).lemma
            return forms.map(lambda own: [lemma(w) for w in own])

        return run(self.forms(text))

    def tokens_of(self, *texts: str) -> list[list[str]]:
        return [[self.model.lemma(w) for w in own] for own in SimpleAnalyzer().tokens_of(*texts)]

    def unify(self, words: DataFrame) -> DataFrame:
        shared = self._shared

        @F.pandas_udf("string")
        def run(forms: pd.Series) -> pd.Series:
            return forms.map(_in_worker(shared).lemma)

        return words.withColumn("lemma", run("lemma"))


_workers: dict[int, Lemmatiser] = {}


def _in_worker(shared) -> Lemmatiser:
    """The lemmatiser of a broadcast, made once in a worker; the last one only, so that a long session does not pile them up."""
    own = _workers.get(id(shared.value))
    if own is None:
        _workers.clear()
        own = _workers[id(shared.value)] = Lemmatiser(*shared.value)
    return own


def by_rules(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """forms (a column form) with the lemma that the first rule of the longest suffix gives, as `ruled`: by a join on suffixes, so rules may be any number."""
    marked = F.concat(F.lit("^"), F.col("form"))
    asked = forms.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(0), F.length(marked)), lambda k: F.right(marked, k))))
    # the rules of a suffix in order; those that would leave nothing of the form are passed over
    own = rules.groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct("place", "cut", "add"))).alias("own"))
    lemmas = F.filter(F.transform("own", lambda r: F.concat(F.left("form", F.greatest(F.length("form") - r["cut"], F.lit(0))), r["add"])), lambda x: x != "")
    best = asked.join(own, "suffix").groupBy("form").agg(F.max_by(F.coalesce(F.get(lemmas, F.lit(0)), F.col("form")), F.length("suffix")).alias("ruled"))
    return forms.join(best, "form", "left").withColumn("ruled", F.coalesce("ruled", "form"))


def exceptions(known: DataFrame, rules: DataFrame) -> DataFrame:
    """The known forms (form, lemma) whose lemma the rules would not give: with the rules they say what all of them say."""
    return by_rules(known, rules).where("ruled <> lemma").select("form", "lemma")


def save_model(dictionary: DataFrame, path: str, longest: int = LONGEST, least: int = LEAST) -> None:
    """Write the rules of a dictionary and the forms that are exceptions to them, for load_model(). A language's forms grow with its texts; those that
    rules give are not kept, so that an analyzer stays small."""
    known = cut(known_forms(dictionary), "forms")
    learn(known, longest, least).write.mode("overwrite").parquet(f"{path}/rules")
    exceptions(known, known.sparkSession.read.schema(RULES).parquet(f"{path}/rules")).write.mode("overwrite").parquet(f"{path}/words")
    drop_scratch(known)


def load_model(spark: SparkSession, path: str, most: int = MOST) -> LemmaAnalyzer:
    return LemmaAnalyzer(spark.read.schema(WORDS).parquet(f"{path}/words"), spark.read.schema(RULES).parquet(f"{path}/rules"), most)
