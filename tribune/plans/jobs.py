"""The steps of the offline pipeline as jobs over folders: each reads tables, computes what is new, and appends it."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import index, lemmas as lemma_rules
from ..operators.analyzer import Analyzer
from ..operators.segments import SegmentIndex
from ..functions import dates
from ..sources import files
from ..sources.mirror import mirror
from ..sources.store import ROWS, Store
from ..tables import TEXTS, cut, drop_scratch
from . import ingest, keys
from .publish import Aside

#: The table of a store of speeches that holds the lines which are none.
REJECTED = "rejected"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a store, or of a plain Parquet table; none where nothing was written yet."""
    if Store.there(spark, path):
        return Store(spark, path).read(ROWS, schema).drop("part")
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def load_speeches(spark: SparkSession, lines: str, speeches: str) -> dict[str, int]:
    """Speech files into the store of speeches: complete ones, the first of each key, not stored before. Lemmas are left to build_lemmas.

    One pass over the files tells good lines from those that lack a mandatory column and those that are no JSON; these two go to the store's table
    `rejected` with the reason and the file, each once however often the file is loaded. All of it counts together. Returns how many
    lines were read, were good, were rejected and were malformed, and how many speeches are new.
    """
    rows = files.read_speeches(spark, lines).withColumns({"_file": F.col("_metadata.file_path"), "_line": F.monotonically_increasing_id(), "text_lemmas": F.lit(None).cast("string")})
    counts = Observation()
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    malformed = F.coalesce(F.col("reason") == ingest.MALFORMED, F.lit(False))
    told = ingest.judged(rows).observe(counts, F.count("*").alias("read"), n(F.col("reason").isNull()).alias("good"), n(F.col("reason").isNotNull() & ~malformed).alias("rejected"), n(malformed).alias("malformed"))
    landed = cut(told, "landed", TEXTS)
    store = Store(spark, speeches)
    bad = landed.where("reason is not null").select("reason", F.col("_file").alias("file"), "record").distinct()
    extra = {}
    if not bad.isEmpty():
        known = store.read(REJECTED, schemas.REJECTED).drop("part")
        part = store.stage(REJECTED, bad.join(known, ["file", "record"], "left_anti").select("reason", "file", "record"))
        extra = {REJECTED: [part]}
    good = landed.where("reason is null").withColumn("speech_id", F.xxhash64(*ingest.KEY))
    added = keys.append(store, good, ingest.KEY, schemas.SPEECHES, [F.col("_file"), F.col("_line")], extra)
    drop_scratch(landed)
    return {k: counts.get[k] for k in ("read", "good", "rejected", "malformed")} | {"new": added}


def learn_lemmas(spark: SparkSession, dictionary: str, model: str) -> None:
    """A lemma model of a table of forms and lemmas (Parquet, columns form and lemma), for the jobs that take an analyzer."""
    lemma_rules.save_model(spark.read.schema(lemma_rules.WORDS).parquet(dictionary), model)


def build_lemmas(spark: SparkSession, speeches: str, lemmas: str, analyzer: Analyzer) -> None:
    """Lemmas (speech_id, text_lemmas, space between them) of the speeches that have none yet, appended; those whose text yields none are noted, too."""
    table = stored(spark, speeches, schemas.SPEECHES)
    fresh = table.join(stored(spark, lemmas, schemas.LEMMAS).select("speech_id"), "speech_id", "left_anti")
    index.lemmatised(fresh, analyzer).select("speech_id", "text_lemmas").write.mode("append").parquet(lemmas)


def build_terms(spark: SparkSession, speeches: str, postings: str, analyzer: Analyzer, done: str | None = None) -> None:
    """Postings of the speeches that have none. With a ledger `done` of speeches, those whose text yields no lemma are not tokenised again."""
    table = stored(spark, speeches, schemas.SPEECHES)
    known = stored(spark, postings, schemas.POSTINGS)
    if done:
        table = index.without(table, stored(spark, done, "speech_id long"))
    fresh = cut(index.missing(table.select("speech_id", "text"), known), "fresh")
    index.postings(fresh, analyzer).write.mode("append").parquet(postings)
    if done:
        fresh.select("speech_id").write.mode("append").parquet(done)
    drop_scratch(fresh)


def build_index(spark: SparkSession, postings: str, table: str) -> None:
    """The bucketed, sorted table of the postings."""
    index.save(stored(spark, postings, schemas.POSTINGS), table)


def update_index(spark: SparkSession, speeches: str, folder: str, table: str, analyzer: Analyzer) -> None:
    """Speeches that the segmented index in a folder lacks become a segment of it; small segments are merged, and what no longer counts is deleted."""
    own = SegmentIndex(spark, folder, table)
    fresh = stored(spark, speeches, schemas.SPEECHES).select("speech_id", "text").join(own.live().select("speech_id").distinct(), "speech_id", "left_anti")
    own.add(fresh, analyzer)
    own.merge()
    own.clean()


def _polled(spark: SparkSession, known: bool, start: str | None, end: str | None, today: date, last: str | None = None) -> tuple[str, str, list[tuple[str, str]]]:
    """The days to ask for, and their months: as given; else from two weeks before today (from the first day of all, where nothing is known) to the last day
    processed, if told, or today. By the same columns as any table of such days."""
    now = F.lit(today.isoformat()).cast("date")
    first = F.coalesce(F.lit(start).cast("date"), dates.look_back(F.lit(known), now))
    until = F.coalesce(F.lit(end).cast("date"), dates.until(F.lit(last), now))
    (row,) = spark.range(1).select(first.alias("s"), until.alias("e")).withColumn("months", dates.month_chunks(F.col("s"), F.col("e"))).collect()
    return row.s.isoformat(), row.e.isoformat(), [(m.start.isoformat(), m.end.isoformat()) for m in row.months]


def fetch_sittings(spark: SparkSession, url: str, out: str, ledger: str, history: str, analyzer: Analyzer, start: str | None = None, end: str | None = None, pause: str = "6.1", state: str | None = None) -> None:
    """New sittings of a REST interface, by months, into speech files, and their uids into the ledger: both or neither, whatever is lost on the way. A run that
    was lost after it counted is carried through first. state: a folder that keeps the last day asked for, which fetch_attendance reads."""
    aside = Aside(spark, f"{out.rstrip('/')}/_aside")
    aside.replay()
    known = files.read_ledger(spark, ledger)
    _, last, months = _polled(spark, not known.isEmpty(), start, end, date.today())
    answers = spark.read.format("rest_months").options(url=url, months=json.dumps(months), pause=pause).load().coalesce(1)
    fresh = cut(ingest.unseen(ingest.dated(_parsed(cut(answers, "answers"), schemas.VERBATIMS)), known), "sittings")
    run = aside.begin()
    aside.write(run, "lines", files.by_year(ingest.speeches_of(fresh, files.read_history(spark, history), analyzer)), "year")
    targets = {"lines": out, "ledger": ledger}
    aside.write(run, "ledger", fresh.select("uid").distinct())
    if state:
        day = spark.createDataFrame([(last, date.today().isoformat())], "last_processed_date string, last_checked_date string")
        aside.write(run, "state", day)
        targets["state"] = state
    aside.commit(run, targets)
    aside.replay()
    drop_scratch(fresh)


def last_processed(spark: SparkSession, state: str | None) -> str | None:
    """The last day that fetch_sittings has noted."""
    if not state:
        return None
    return files.read_or_empty(spark, state, "last_processed_date string").agg(F.max("last_processed_date")).first()[0]


def fetch_factions(spark: SparkSession, url: str, out: str, params: dict | None = None) -> None:
    """Members of a REST interface into the faction history."""
    answers = spark.read.format("rest_list").options(url=url, params=json.dumps(params or {}), pause="0").load()
    rows = answers.select(F.from_json("json", schemas.MEMBERS).alias("r"), F.monotonically_increasing_id().alias("place_of_member")).select("r.*", "place_of_member")
    files.write_history(ingest.history_of(rows), out)


def fetch_attendance(spark: SparkSession, url: str, attendance: str, start: str | None = None, end: str | None = None, state: str | None = None, pause: str = "5.1", wait: str = "10") -> None:
    """Roll calls of a REST interface that are not in the attendance table yet, with their voters. Without an end they are asked for up to the last day
    that the state of fetch_sittings tells."""
    known = stored(spark, attendance, schemas.ATTENDANCE)
    start, end, _ = _polled(spark, False, start, end, date.today(), last_processed(spark, state))
    days = spark.read.format("rest_list").options(url=url, params=json.dumps({"startDate": start, "endDate": end}), pause="0").load()
    calls = ingest.roll_calls(_parsed(days, schemas.VOTINGS)).join(known.select(F.col("voting_uuid").alias("uuid")).distinct(), "uuid", "left_anti")
    asked = [r.asDict() for r in calls.collect()]  # a request each: the interface's limit of twelve a minute bounds them
    voters = spark.read.format("rest_voters").options(url=url, votings=json.dumps(asked), tries="3", pause=pause, wait=wait).load().coalesce(1)
    ingest.attendance_of(_parsed(voters, schemas.VOTERS)).write.mode("append").parquet(attendance)


def upload(spark: SparkSession, lines: str, store: str) -> None:
    """All speech files into an object store, byte for byte, in place of what is there of their years."""
    mirror(spark, lines, store)


def download(spark: SparkSession, store: str, lines: str, year: str | None = None) -> None:
    """The speech files of one year, by default the current one, out of an object store; a year that is missing gives none."""
    mirror(spark, store, lines, int(year or date.today().year))


def download_all(spark: SparkSession, store: str, lines: str) -> None:
    """The speech files of all years out of an object store."""
    mirror(spark, store, lines)
