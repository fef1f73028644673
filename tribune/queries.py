"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import job_queries, lemma_queries, store_queries
from .functions import dates, numbers, text
from .operators import attendance, index, search
from .operators.analyzer import SimpleAnalyzer
from .operators.query import parse_query
from .plans import ingest, samples

Query = Callable[[SparkSession, str], DataFrame]
ANALYZER = SimpleAnalyzer()

#: Words of the four languages of the test texts.
SINGLE, AND, OR, COMBINED, PARTIAL, STOPPED, RARE = "the", "the that", "pour, und", "the that, pour par", "the that, und zzz", "on the, et", "ciónas"


def _matches(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Speeches that match, with their count, in one pass over the texts."""
    return search.match_texts(samples.speeches(spark, sf_dir), parse_query(query, ANALYZER), ANALYZER)


def _found(query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text")
        return search.match_texts(docs, parse_query(query, ANALYZER), ANALYZER).select("speech_id", "count")

    return run


def _from_index(query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text")
        return search.match(index.postings(docs, ANALYZER), parse_query(query, ANALYZER))

    return run


def _top(limit: int) -> Query:
    return lambda spark, sf_dir: search.newest(_matches(spark, sf_dir, COMBINED), limit)


def _activity(query: str, interval: str) -> Query:
    return lambda spark, sf_dir: search.activity(_matches(spark, sf_dir, query), interval)


def _speakers(limit: int) -> Query:
    return lambda spark, sf_dir: search.top_speakers(_matches(spark, sf_dir, COMBINED), limit)


def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text"), ANALYZER)


def lemma_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dictionary(term_index(spark, sf_dir))


def new_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text", "lang")
    known = index.postings(docs.where("lang = 'en'"), ANALYZER).select("lemma").distinct()
    return index.new_lemmas(index.postings(docs, ANALYZER), known)


def missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples.table(spark, sf_dir, "documents").selectExpr("doc_id as speech_id", "text", "lang")
    return index.missing(docs, index.postings(docs.where("lang <> 'de'"), ANALYZER)).select("speech_id")


def search_duplicate_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found("the the")(spark, sf_dir).agg(F.count("*").alias("n"))


def attendance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attendance.stats(samples.attendance(spark, sf_dir))


def attendance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attendance.banded(attendance_stats(spark, sf_dir)).select("member_name", "attendance_percentage", "band")


def attendance_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.attendance(spark, sf_dir)
    voter = F.struct(F.col("member_name").alias("fullName"), F.struct(F.col("faction").alias("name")).alias("faction"), F.struct(F.col("status").alias("code")).alias("decision"))
    votings = rows.where("member_name <> 'm1'").groupBy(F.col("voting_uuid").alias("uuid"), F.pmod(F.xxhash64("member_name"), F.lit(32)).alias("block")).agg(F.min("session_date").alias("startDateTime"), F.collect_set(voter).alias("voters"))
    known = rows.where("voting_uuid like '%00'").select("voting_uuid")
    return ingest.attendance_of(votings, known).groupBy("voting_uuid").agg(F.count("*").alias("n_members"))


def faction_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = samples.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("speaker"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 3).cast("int") - 1), "yyyy-MM-dd").alias("date"))
    return ingest.with_faction(asked, samples.history(spark, sf_dir)).select("o_orderkey", "date", "speaker_faction")


def speaker_role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, role = text.split_speaker(F.col("raw"))
    return samples.speakers(spark, sf_dir).select("c_custkey", name.alias("speaker"), role.alias("speaker_role"))


def speech_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.flatten(ingest.dated(samples.verbatims(spark, sf_dir)))
    return rows.select("uid", "date", "time", "source_file", "source_url", "speaker", "speaker_role", "text")


def uid_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.dated(samples.verbatims(spark, sf_dir))
    ledger = rows.where("date like '2024-01%'").select("uid").distinct()
    return ingest.unseen(rows.select("uid"), ledger)


def load_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples.table(spark, sf_dir, "documents").selectExpr("doc_id", "lang as source_file", "source as speaker", "text")
    return ingest.first_of(docs, ["source_file", "speaker", "text"], [F.col("doc_id")]).select("doc_id", "source_file", "speaker")


def load_reject_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples.table(spark, sf_dir, "documents").selectExpr("doc_id", "nullif(lang, 'de') as source_file", "nullif(source, 'src3') as speaker")
    return ingest.complete(docs, ("source_file", "speaker"))[0]


def session_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.links(spark, sf_dir).select("doc_id", dates.session_time(F.col("link")).alias("time"))


def month_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = samples.table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return ends.select(F.explode(dates.month_chunks(F.col("lo"), F.col("hi"))).alias("c")).select(*(F.date_format(f"c.{x}", "yyyy-MM-dd").alias(f"chunk_{x}") for x in ("start", "end")))


def datetime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HHmm").alias("hhmm"), F.date_format("ts", "HH:mm:ss").alias("long"))
    time = F.when(F.col("event_id") % 3 == 0, F.col("hhmm")).when(F.col("event_id") % 3 == 1, F.col("long")).otherwise(F.lit("9"))
    return rows.select("event_id", dates.label(F.col("date"), time).alias("label"))


def snippet_350(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def year_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return rows.groupBy(F.year(dates.day(F.col("date"))).alias("year")).agg(F.count("*").alias("n"))


def percentage_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), (F.col("l_orderkey") % 200 + 8).alias("n")).distinct()
    return rows.select("k", "n", numbers.percentage(F.col("k"), F.col("n")).alias("percent"))


def percentage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares with up to 20,000 sittings, ties among them: the number of an order's part and one of the multiples that can tie."""
    rows = samples.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1250 * 16 + 16).alias("n"), ((F.col("l_partkey") * 2 + 1) % 2000).alias("odd"))
    shares = rows.select("n", F.expr("(odd * n) div 2000").alias("k")).distinct()
    return shares.select("k", "n", numbers.percentage(F.col("k"), F.col("n")).alias("percent"))


QUERIES: dict[str, Query] = {
    "term_index": term_index,
    "lemma_dictionary": lemma_dictionary,
    "new_lemmas": new_lemmas,
    "missing_terms": missing_terms,
    "search_single": _found(SINGLE),
    "search_and": _found(AND),
    "search_or": _found(OR),
    "search_combined": _found(COMBINED),
    "search_combined_index": _from_index(COMBINED),
    "search_partial_group_weight": _found(PARTIAL),
    "search_stopwords": _found(STOPPED),
    "search_duplicate_term": search_duplicate_term,
    "search_top50": _top(50),
    "activity_daily": _activity(COMBINED, "daily"),
    "activity_weekly": _activity(COMBINED, "weekly"),
    "activity_monthly_filled": _activity(RARE, "monthly"),
    "top_speakers": _speakers(20),
    "top_speakers_8": _speakers(8),
    "attendance_stats": attendance_stats,
    "attendance_bands": attendance_bands,
    "attendance_load": attendance_load,
    "faction_interval": faction_interval,
    "speaker_role_split": speaker_role_split,
    "speech_flatten": speech_flatten,
    "uid_incremental": uid_incremental,
    "load_dedupe": load_dedupe,
    "load_reject_nulls": load_reject_nulls,
    "session_time": session_time,
    "month_chunks": month_chunks,
    "datetime_label": datetime_label,
    "snippet_350": snippet_350,
    "year_partition_counts": year_partition_counts,
    "percentage_ties": percentage_ties,
    "percentage_exact": percentage_exact,
} | job_queries.QUERIES | lemma_queries.QUERIES | store_queries.QUERIES

# --- the same in SQL, stated independently: an alternative is a speech id in a grouped subquery ---

_TERMS = r"""terms AS (
  SELECT speech_id, lemma, count(*) AS cnt FROM (
    SELECT doc_id AS speech_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS lemma FROM documents)
  WHERE regexp_full_match(lemma, '\p{L}+') GROUP BY ALL)"""
_SPEECHES = """speeches AS (
  SELECT d.doc_id AS speech_id, d.text, d.source AS speaker, strftime(o.o_orderdate, '%Y-%m-%d') AS date, strftime(e.ts, '%H%M') AS time,
         'https://s.example/' || d.doc_id AS source_url
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey JOIN events e ON d.doc_id = e.event_id)"""


def _words(ws: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


def _hits(groups: list[list[str]]) -> str:
    some = " OR ".join(f"speech_id IN (SELECT speech_id FROM terms WHERE lemma IN {_words(g)} GROUP BY speech_id HAVING count(DISTINCT lemma) = {len(g)})" for g in groups)
    return f"hits AS (SELECT speech_id, sum(cnt)::BIGINT AS count FROM terms WHERE ({some}) AND lemma IN {_words([w for g in groups for w in g])} GROUP BY speech_id)"


_FOUND = lambda groups: f"WITH {_TERMS}, {_hits(groups)} SELECT speech_id, count FROM hits"
_JOINED = lambda groups: f"WITH {_TERMS}, {_hits(groups)}, {_SPEECHES}"
_COMBINED = [["the", "that"], ["pour", "par"]]
_ATT = """att AS (
  SELECT strftime(ts, '%Y%m%d%H') AS voting_uuid, 'm' || user_id AS member_name, CASE WHEN event_type = 'view' THEN 'KOHAL' ELSE 'PUUDUB' END AS status FROM events)"""
_STATS = f"""WITH {_ATT}, s AS (
  SELECT member_name, count(*) AS total_sessions, count(*) FILTER (status = 'KOHAL') AS present_sessions FROM att GROUP BY member_name)
SELECT member_name, total_sessions, present_sessions, round_even(present_sessions / total_sessions * 100, 1) AS attendance_percentage FROM s"""
_HISTORY = """history AS (
  SELECT o_custkey::VARCHAR AS name, o_orderpriority AS faction, strftime(o_orderdate, '%Y-%m-%d') AS start, o_orderkey,
         coalesce(lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey), '2099-12-31') AS stop
  FROM orders)"""
_SITTINGS = """sittings AS (
  SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 <> 0 THEN 'https://s.example/20240108' || lpad((conv_id % 2400)::VARCHAR, 4, '0') END AS link,
         strftime(DATE '2024-01-01' + (conv_id % 700)::INTEGER, '%Y-%m-%d') AS day FROM conversations WHERE conv_id % 7 <> 0)"""

ORACLES: dict[str, str] = {
    "term_index": f"WITH {_TERMS} SELECT speech_id, lemma, cnt AS count FROM terms",
    "lemma_dictionary": f"WITH {_TERMS} SELECT lemma, count(*) AS n_speeches, sum(cnt)::BIGINT AS n_occurrences FROM terms GROUP BY lemma",
    "new_lemmas": f"WITH {_TERMS} SELECT DISTINCT lemma FROM terms WHERE lemma NOT IN (SELECT lemma FROM terms JOIN documents ON speech_id = doc_id WHERE lang = 'en')",
    "missing_terms": f"WITH {_TERMS} SELECT doc_id AS speech_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM terms t JOIN documents e ON t.speech_id = e.doc_id WHERE e.lang <> 'de' AND t.speech_id = d.doc_id)",
    "search_single": _FOUND([["the"]]),
    "search_and": _FOUND([["the", "that"]]),
    "search_or": _FOUND([["pour"], ["und"]]),
    "search_combined": _FOUND(_COMBINED),
    "search_combined_index": _FOUND(_COMBINED),
    "search_partial_group_weight": _FOUND([["the", "that"], ["und", "zzz"]]),
    "search_stopwords": _FOUND([["the"]]),
    "search_duplicate_term": f"WITH {_TERMS} SELECT count(*) AS n FROM (SELECT speech_id FROM terms WHERE lemma IN ('the', 'the') GROUP BY speech_id HAVING count(DISTINCT lemma) = 2)",
    "search_top50": f"{_JOINED(_COMBINED)} SELECT speaker, text, count, date, time, source_url FROM speeches JOIN hits USING (speech_id) ORDER BY date DESC, time DESC, speech_id LIMIT 50",
    "activity_daily": f"{_JOINED(_COMBINED)} SELECT date, count(*) AS count FROM speeches JOIN hits USING (speech_id) GROUP BY date",
    "activity_weekly": f"{_JOINED(_COMBINED)} SELECT strftime(date::DATE, '%Y-%W') AS week, count(*) AS count FROM speeches JOIN hits USING (speech_id) GROUP BY ALL",
    "activity_monthly_filled": f"""{_JOINED([[RARE]])}, m AS (SELECT strftime(date::DATE, '%Y-%m') AS month, count(*) AS n FROM speeches JOIN hits USING (speech_id) GROUP BY ALL),
every AS (SELECT strftime(unnest(generate_series((SELECT min(month) || '-01' FROM m)::DATE, (SELECT max(month) || '-01' FROM m)::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT month, coalesce(n, 0)::BIGINT AS count FROM every LEFT JOIN m USING (month)""",
    "top_speakers": f"{_JOINED(_COMBINED)} SELECT speaker, sum(count)::BIGINT AS count FROM speeches JOIN hits USING (speech_id) GROUP BY speaker ORDER BY count DESC, speaker LIMIT 20",
    "top_speakers_8": f"{_JOINED(_COMBINED)} SELECT speaker, sum(count)::BIGINT AS count FROM speeches JOIN hits USING (speech_id) GROUP BY speaker ORDER BY count DESC, speaker LIMIT 8",
    "attendance_stats": _STATS,
    "attendance_bands": f"SELECT member_name, attendance_percentage, CASE WHEN attendance_percentage >= 90 THEN 'green' WHEN attendance_percentage >= 70 THEN 'amber' ELSE 'red' END AS band FROM ({_STATS})",
    "attendance_load": f"WITH {_ATT} SELECT voting_uuid, count(DISTINCT member_name) AS n_members FROM att WHERE member_name <> 'm1' AND voting_uuid NOT LIKE '%00' GROUP BY voting_uuid",
    "faction_interval": f"""WITH {_HISTORY}, asked AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS name, strftime(o_orderdate::DATE + (o_orderkey % 3)::INTEGER - 1, '%Y-%m-%d') AS date FROM orders),
ranked AS (SELECT k, date, faction, row_number() OVER (PARTITION BY k ORDER BY start NULLS LAST, o_orderkey) AS rn FROM asked LEFT JOIN history ON history.name = asked.name AND date BETWEEN start AND stop)
SELECT k AS o_orderkey, date, faction AS speaker_faction FROM ranked WHERE rn = 1""",
    "speaker_role_split": """SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN 'kõneleja' || c_custkey ELSE 'Mari Tamm' || c_custkey END AS speaker,
CASE c_custkey % 6 WHEN 0 THEN 'Peaminister' WHEN 1 THEN 'Riigikogu esimees' WHEN 2 THEN 'Haridus- ja teadusminister' WHEN 3 THEN 'väga tähtis' END AS speaker_role FROM customer""",
    "speech_flatten": f"""WITH {_SITTINGS} SELECT coalesce(link, day || 'T13:00:00.000+00:00') AS uid, day AS date, coalesce(right(link, 4), '0000') AS time, day || '_' || coalesce(right(link, 4), '0000') || '.api' AS source_file,
coalesce(link, '') AS source_url, 'Mari ' || upper(role[1]) || role[2:] AS speaker, 'Esimees' AS speaker_role, text FROM sittings JOIN conversations USING (conv_id) WHERE role <> 'system' AND text <> ''""",
    "uid_incremental": f"WITH {_SITTINGS}, u AS (SELECT coalesce(link, day || 'T13:00:00.000+00:00') AS uid, day FROM sittings) SELECT DISTINCT uid FROM u WHERE uid NOT IN (SELECT uid FROM u WHERE day LIKE '2024-01%')",
    "load_dedupe": "SELECT doc_id, lang AS source_file, source AS speaker FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source, text ORDER BY doc_id) = 1",
    "load_reject_nulls": "SELECT doc_id, lang AS source_file, source AS speaker FROM documents WHERE lang <> 'de' AND source <> 'src3'",
    "session_time": """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://s.example/2024010' || lpad((doc_id * 37 % 100000)::VARCHAR, 5, '0') ELSE coalesce(url, '') END AS link FROM documents LEFT JOIN pages ON doc_id = page_id)
SELECT doc_id, CASE WHEN regexp_full_match(right(link, 4), '[0-9]{4}') THEN right(link, 4) ELSE '0000' END AS time FROM l""",
    "month_chunks": """WITH e AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), m AS (SELECT lo, hi, unnest(generate_series(date_trunc('month', lo)::DATE, hi, INTERVAL 1 MONTH))::DATE AS m FROM e)
SELECT strftime(greatest(m, lo), '%Y-%m-%d') AS chunk_start, strftime(least(last_day(m), hi), '%Y-%m-%d') AS chunk_end FROM m""",
    "datetime_label": f"""SELECT event_id, day(ts) || '. ' || (['{"', '".join(dates.MONTHS)}'])[month(ts)] || ' ' || year(ts) || ' kell ' || CASE WHEN event_id % 3 = 2 THEN '9' ELSE strftime(ts, '%H:%M') END AS label FROM events""",
    "snippet_350": "SELECT doc_id, left(text, 350) || '...' AS snippet FROM documents",
    "year_partition_counts": "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1",
    "percentage_ties": "SELECT k, n, round_even(k / n * 100, 1) AS percent FROM (SELECT DISTINCT l_linenumber::BIGINT AS k, l_orderkey % 200 + 8 AS n FROM lineitem)",
    # the double's exact part behind the point, in whole numbers of 2^-60
    "percentage_exact": """WITH s AS (SELECT DISTINCT l_orderkey % 1250 * 16 + 16 AS n, (((l_partkey * 2 + 1) % 2000) * (l_orderkey % 1250 * 16 + 16)) // 2000 AS k FROM lineitem),
x AS (SELECT k, n, floor(k / n * 100)::BIGINT AS w, ((k / n * 100 - floor(k / n * 100)) * 1152921504606846976.0::DOUBLE)::HUGEINT * 10 AS p FROM s),
t AS (SELECT k, n, w * 10 + p // 1152921504606846976 AS t, 2 * (p % 1152921504606846976) AS rest FROM x)
SELECT k, n, ((t + CASE WHEN rest > 1152921504606846976 OR (rest = 1152921504606846976 AND t % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE) / 10 AS percent FROM t""",
}
ORACLES |= job_queries.oracles(ORACLES, _TERMS, _STATS) | lemma_queries.oracles(_TERMS) | store_queries.oracles(ORACLES, _TERMS)
