"""Queries that go by lemmas which are learned from some of the forms of the documents and applied to all, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, search
from .operators.analyzer import SimpleAnalyzer
from .operators.lemmas import LEAST, LONGEST, LemmaAnalyzer, load_model, save_model
from .operators.query import parse_query
from .plans import samples
from .tables import scratch

#: Inflections that the documents' forms are taken to have, longest first; shorter words have none.
ENDINGS = {"ation": "ate", "ing": "", "ed": "", "es": "e", "s": "", "ment": "mer"}
LEAST_LETTERS = 6
QUERY = "Thering, thatment thates"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of the documents with its lemma; four of five are known (by their crc32), the others are held out."""
    words = _docs(spark, sf_dir).select(F.explode(SimpleAnalyzer().tokens(F.col("text"))).alias("form")).distinct()
    lemma = F.col("form")
    for ending, other in reversed(ENDINGS.items()):
        lemma = F.when((F.length("form") >= LEAST_LETTERS) & F.endswith("form", F.lit(ending)), F.concat(F.expr(f"left(form, length(form) - {len(ending)})"), F.lit(other))).otherwise(lemma)
    return words.select("form", lemma.alias("lemma"), (F.crc32(F.col("form").cast("binary")) % 5 == 0).alias("held_out"))


def _analyzer(spark: SparkSession, sf_dir: str) -> LemmaAnalyzer:
    """Learned, written and read again, as jobs have it."""
    path = scratch(spark, "lemma-model")
    save_model(_forms(spark, sf_dir).where("not held_out"), path)
    return load_model(spark, path)


def lemmas_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemma that each form gets, and whether it is the one it should have; held-out forms go by rules alone."""
    forms = _forms(spark, sf_dir)
    given = _analyzer(spark, sf_dir).unify(forms.select("form", "held_out", F.col("lemma").alias("wanted"), F.col("form").alias("lemma")))
    return given.select("form", "held_out", "lemma", (F.col("lemma") == F.col("wanted")).alias("correct"))


def lemma_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_docs(spark, sf_dir), _analyzer(spark, sf_dir))


def lemma_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("text_lemmas", F.lit(None).cast("string"))
    return index.lemmatised(rows, _analyzer(spark, sf_dir)).select("speech_id", "text_lemmas")


def lemma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches straight from the texts; lemma_search_index has the same rows."""
    analyzer = _analyzer(spark, sf_dir)
    return search.match_texts(_docs(spark, sf_dir), parse_query(QUERY, analyzer), analyzer).select("speech_id", "count")


def lemma_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzer = _analyzer(spark, sf_dir)
    return search.match(index.postings(_docs(spark, sf_dir), analyzer), parse_query(QUERY, analyzer))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (lemmas_held_out, lemma_index, lemma_texts, lemma_search, lemma_search_index)}

_WANTED = "CASE " + " ".join(f"WHEN length(form) >= {LEAST_LETTERS} AND form LIKE '%{e}' THEN left(form, length(form) - {len(e)}) || '{o}'" for e, o in ENDINGS.items()) + " ELSE form END"
#: crc32 of the bytes of a form, bit by bit, as DuckDB has no function for it.
_CRC = r"""list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(form)) + 1), lambda i: ('0x' || substr(hex(encode(form)), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
#: Longest suffix with rules, all of them kept: left out ones give the same lemmas.
_LEARNED = rf"""forms AS (
  SELECT form, {_WANTED} AS wanted, xor({_CRC}, 4294967295) % 5 = 0 AS held_out FROM (SELECT DISTINCT lemma AS form FROM terms)),
parted AS (
  SELECT form, wanted, len(list_filter(range(1, least(length(form), length(wanted)) + 1), lambda k: left(form, k) = left(wanted, k))) AS p FROM forms WHERE NOT held_out),
each AS (
  SELECT unnest(list_transform(range(length(form) - p, greatest(length(form) - p, least(length(form) + 1, {LONGEST})) + 1), lambda k: right('^' || form, k))) AS suffix,
         length(form) - p AS cut, substr(wanted, p + 1) AS add FROM parted),
counted AS (SELECT suffix, cut, add, count(*) AS n FROM each GROUP BY ALL HAVING count(*) >= {LEAST}),
firsts AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) = 1),
asked AS (
  SELECT form, held_out, wanted, unnest(list_transform(range(0, length(form) + 2), lambda k: right('^' || form, k))) AS suffix FROM forms),
fits AS (
  SELECT form, cut, add FROM asked JOIN firsts USING (suffix) WHERE held_out QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC) = 1),
lemmas AS (
  SELECT f.form, held_out, CASE WHEN NOT held_out THEN wanted ELSE coalesce(left(f.form, length(f.form) - cut) || add, f.form) END AS lemma, wanted
  FROM forms f LEFT JOIN fits USING (form))"""


def oracles(terms: str) -> dict[str, str]:
    """SQL of these queries; terms: the common table of (speech_id, lemma, cnt) by forms."""
    learned = f"WITH {terms}, {_LEARNED}"
    unified = f"{learned}, unified AS (SELECT speech_id, l.lemma, sum(cnt)::BIGINT AS count FROM terms t JOIN lemmas l ON t.lemma = l.form GROUP BY ALL)"
    groups = [[w.lower() for w in g.split()] for g in QUERY.split(",")]
    # words of the query that no document has go by the rules, too
    asked = " UNION ALL ".join(f"SELECT '{w}' AS form, {k} AS g" for k, g in enumerate(groups) for w in g)
    found = f"""{unified.replace("(SELECT DISTINCT lemma AS form FROM terms)", f"(SELECT DISTINCT form, exists(SELECT 1 FROM terms t WHERE t.lemma = form) AS there FROM (SELECT lemma AS form FROM terms UNION SELECT form FROM ({asked})))").replace("xor(" + _CRC + ", 4294967295) % 5 = 0 AS held_out", "NOT there OR xor(" + _CRC + ", 4294967295) % 5 = 0 AS held_out")},
q AS (SELECT DISTINCT g, lemma FROM ({asked}) JOIN lemmas USING (form)),
ok AS (SELECT DISTINCT speech_id FROM (SELECT speech_id, g, count(*) AS n FROM unified JOIN q USING (lemma) GROUP BY ALL) JOIN (SELECT g, count(*) AS n FROM q GROUP BY g) USING (g, n))
SELECT speech_id, sum(count)::BIGINT AS count FROM unified WHERE speech_id IN (SELECT speech_id FROM ok) AND lemma IN (SELECT lemma FROM q) GROUP BY speech_id"""
    return {
        "lemmas_held_out": f"{learned} SELECT form, held_out, lemma, lemma = wanted AS correct FROM lemmas",
        "lemma_index": f"{unified} SELECT speech_id, lemma, count FROM unified",
        "lemma_texts": rf"""{learned}, words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS form
  FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: regexp_full_match(x, '\p{{L}}+')) AS ws FROM documents)),
joined AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS text_lemmas FROM words JOIN lemmas USING (form) GROUP BY doc_id)
SELECT d.doc_id AS speech_id, coalesce(text_lemmas, '') AS text_lemmas FROM documents d LEFT JOIN joined USING (doc_id)""",
        "lemma_search": found,
        "lemma_search_index": found,
    }
