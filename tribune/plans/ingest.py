"""From nested payloads to tables: speeches, faction history, attendance. Each step takes and returns DataFrames, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators.analyzer import Analyzer
from ..schemas import MANDATORY
from .keys import digest, once

#: End of a membership that has none yet, and the kind of voting that records presence: fixed values of the data.
OPEN_END = "2099-12-31"
ROLL_CALL = "KOHALOLEKU_KONTROLL"
#: What makes a speech one, and the reason for which a line that is no JSON is rejected.
KEY = ["source_file", "speaker", "text"]
MALFORMED = "malformed"


def dated(verbatims: DataFrame) -> DataFrame:
    """Verbatims with uid, day and session time; those without a readable date drop out and may come again later."""
    rows = verbatims.withColumns({"uid": text.uid(F.col("link"), F.col("date")), "day": dates.date_of(F.col("date")), "time": dates.session_time(F.coalesce("link", F.lit("")))})
    return rows.where("day is not null")


def unseen(rows: DataFrame, ledger: DataFrame, key: str = "uid") -> DataFrame:
    """Rows whose key is not in the ledger; of several with one key in rows, any one."""
    return rows.join(ledger.select(key), key, "left_anti").dropDuplicates([key])


def flatten(verbatims: DataFrame) -> DataFrame:
    """A row per speech of dated verbatims: events of type SPEECH with a text and a speaker, numbered in order within their verbatim."""
    items = verbatims.select("uid", "day", "time", F.coalesce("link", F.lit("")).alias("source_url"), F.posexplode("agendaItems").alias("item_no", "item"))
    events = items.select("uid", "day", "time", "source_url", "item_no", F.posexplode("item.events").alias("event_no", "e"))
    spoken = events.where("e.type = 'SPEECH' and e.text <> '' and e.speaker <> ''")
    name, role = text.split_speaker(F.col("e.speaker"))
    return spoken.select(
        F.col("day").alias("date"), "time", text.source_file(F.col("day"), F.col("time")).alias("source_file"), "source_url",
        name.alias("speaker"), role.alias("speaker_role"), F.col("e.text").alias("text"), "uid", "item_no", "event_no",
    )


def history_of(members: DataFrame) -> DataFrame:
    """Flat faction history (name, faction, start, end, place) of members; memberships without a start drop out. place is the order
    in which a name's memberships are asked: by start, then as given. Of several members with one name the last in the
    order of `place_of_member` (a column of members, if there) holds."""
    rows = members.withColumn("name", text.full_name(F.col("firstName"), F.col("lastName")))
    if "place_of_member" in rows.columns:
        last = rows.groupBy("name").agg(F.max("place_of_member").alias("place_of_member"))
        rows = rows.join(last, ["name", "place_of_member"])
    each = rows.select("name", F.posexplode("factions").alias("given", "f")).where("f.membership.startDate is not null and f.membership.startDate <> ''")
    end = F.coalesce(F.nullif(F.col("f.membership.endDate"), F.lit("")), F.lit(OPEN_END))
    flat = each.select("name", F.col("f.name").alias("faction"), F.col("f.membership.startDate").alias("start"), end.alias("end"), "given")
    return flat.selectExpr("name", "faction", "start", "end", "cast(row_number() over (partition by name order by start, given) - 1 as int) as place")


def history_map(history: DataFrame) -> DataFrame:
    """One row per name with the array of its memberships in order."""
    entry = F.struct("place", "faction", "start", "end")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda h: F.struct(h["faction"].alias("faction"), h["start"].alias("start"), h["end"].alias("end")))
    return history.groupBy("name").agg(ordered.alias("history"))


def with_faction(rows: DataFrame, history: DataFrame, name: str = "speaker", date: str = "date", into: str = "speaker_faction") -> DataFrame:
    """rows with the faction of the first membership whose dates (both inclusive, compared as text) hold the row's date; else null.

    The memberships of a name are few, so they travel as one array: a join on the name and a filter in the row, without a
    range join, a row number or a second shuffle. Spark broadcasts the table where it is small.
    """
    table = history_map(history).select(F.col("name").alias("_name"), F.col("history").alias("_history"))
    holds = F.filter("_history", lambda h: (h["start"] <= F.col(date)) & (F.col(date) <= h["end"]))
    return rows.join(table, F.col(name) == F.col("_name"), "left").withColumn(into, F.get(holds, F.lit(0))["faction"]).drop("_name", "_history")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given. Aggregates within tasks first, so that a hot key costs a row per task."""
    # the texts of a key are its own, so only the order and the other columns travel with it
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*").select(rows.columns)


def complete(rows: DataFrame, columns: tuple[str, ...] = MANDATORY) -> tuple[DataFrame, DataFrame]:
    """Rows that have all mandatory columns, and the rejected rest."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return rows.where(ok), rows.where(~ok)


def load(rows: DataFrame, existing: DataFrame | None = None, order: list[Column] | None = None) -> DataFrame:
    """Speeches to append to a table: complete, first of each key, not there yet, with speech_id hashed from the key. Keys are compared by their digests. A
    store does without reading the existing ones: see keys.append()."""
    fresh = once(complete(rows)[0], KEY, order)
    if existing is not None:
        fresh = fresh.join(existing.select(digest(KEY).alias("digest")), "digest", "left_anti")
    return fresh.drop("digest").withColumn("speech_id", F.xxhash64(*KEY))


def judged(rows: DataFrame, columns: tuple[str, ...] = MANDATORY) -> DataFrame:
    """rows with `reason` (why a line is no speech: it is no JSON, or lacks columns; null for good ones) and `record`, the line as it was given, of bad ones."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit(MALFORMED)).when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", ")))
    own = [c for c in rows.columns if not c.startswith("_") and c != "text_lemmas"]
    record = F.coalesce(F.col("_corrupt_record"), F.to_json(F.struct(*own)))
    return rows.withColumn("reason", reason).withColumn("record", F.when(F.col("reason").isNotNull(), record)).drop("_corrupt_record")


def speeches_of(verbatims: DataFrame, history: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Lines of the yearly speech files from verbatims that are not processed yet."""
    rows = with_faction(flatten(verbatims), history)
    lemmas = F.array_join(analyzer.tokens(F.col("text")), " ").alias("text_lemmas")
    return rows.select("date", "time", "source_file", "source_url", "speaker", "speaker_role", "speaker_faction", "text", lemmas)


def roll_calls(days: DataFrame) -> DataFrame:
    """uuid and startDateTime of the votings that record presence."""
    return days.select(F.explode("votings").alias("v")).where(F.col("v.type.code") == ROLL_CALL).select("v.uuid", "v.startDateTime")


def attendance_of(votings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Attendance rows of votings with voters (uuid, startDateTime, voters) that are not there yet; missing texts are empty. A
    voting without voters gives none and may come again; a voter who occurs twice in a voting counts once."""
    if existing is not None:
        votings = votings.join(existing.select(F.col("voting_uuid").alias("uuid")).distinct(), "uuid", "left_anti")
    each = votings.select("uuid", "startDateTime", F.explode("voters").alias("v"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = each.select(
        F.col("startDateTime").alias("session_date"), F.col("uuid").alias("voting_uuid"), empty("v.fullName").alias("member_name"),
        empty("v.faction.name").alias("faction"), empty("v.decision.code").alias("status"),
    )
    return rows.dropDuplicates(["voting_uuid", "member_name"])
