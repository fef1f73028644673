import json

import pytest

from tribune.operators.analyzer import SimpleAnalyzer
from tribune.plans import ingest
from tribune.schemas import ATTENDANCE, FACTION_HISTORY, MEMBERS, VERBATIMS, VOTERS, VOTINGS
from tribune.sources import files, rest
from tribune.streaming import verbatims as stream

EVENT = lambda kind="SPEECH", said="Tere tulemast", by="Peaminister A B": {"type": kind, "text": said, "speaker": by}
SITTING = lambda link, day, *events: {"link": link, "title": "t", "date": day, "agendaItems": [{"events": list(events)}]}
LINK = "https://s.example/202401081500"
SITTINGS = [
    SITTING(LINK, "2020-05-01T13:00:00.000+00:00", EVENT(), EVENT("NOTE"), EVENT(said=""), EVENT(by=None), EVENT(said="Teine", by="C D")),
    SITTING(LINK, "2020-05-01T13:00:00.000+00:00", EVENT(said="again")),
    SITTING(None, "2021-01-01T10:00:00.000+00:00", EVENT(said="Kolmas")),
    SITTING("https://s.example/x", None, EVENT()),
    {"link": "https://s.example/9999", "date": "2021-02-02"},
]
HISTORY = [("A B", "F1", "2019-01-01", "2020-05-01", 0), ("A B", "F2", "2020-05-01", "2099-12-31", 1)]


def frame(spark, rows, schema, tmp_path, name="rows"):
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(schema).json(str(path))


@pytest.fixture
def history(spark):
    return spark.createDataFrame(HISTORY, FACTION_HISTORY)


def test_flatten_pipeline(spark, tmp_path, history):
    rows = ingest.dated(frame(spark, SITTINGS, VERBATIMS, tmp_path))
    none = files.read_ledger(spark, str(tmp_path / "ledger"))
    fresh = ingest.unseen(rows, none)
    assert {r.uid for r in fresh.collect()} == {LINK, "2021-01-01T10:00:00.000+00:00", "https://s.example/9999"}
    got = {(r.date, r.time, r.source_file, r.source_url, r.speaker, r.speaker_role, r.speaker_faction) for r in ingest.speeches_of(rows.dropDuplicates(["uid"]), history, SimpleAnalyzer()).collect()}
    assert got >= {("2021-01-01", "0000", "2021-01-01_0000.api", "", "A B", "Peaminister", "F2")}
    assert ("2020-05-01", "1500", "2020-05-01_1500.api", LINK, "A B", "Peaminister", "F1") in got
    files.append_ledger(fresh, str(tmp_path / "ledger"))
    assert ingest.unseen(rows, files.read_ledger(spark, str(tmp_path / "ledger"))).count() == 0


def test_faction(spark, history):
    asked = spark.createDataFrame([("A B", "2020-05-01"), ("A B", "2021-01-01"), ("A B", "2018-01-01"), ("X", "2020-01-01")], "speaker string, date string")
    assert [r.speaker_faction for r in ingest.with_faction(asked, history).orderBy("speaker", "date").collect()] == [None, "F1", "F2", None]


def test_history(spark, tmp_path):
    member = lambda a, b, *f: {"firstName": a, "lastName": b, "factions": [{"name": n, "membership": {"startDate": s, "endDate": e}} for n, s, e in f]}
    rows = frame(spark, [member(" A", "B ", ("late", "2021", None), ("none", None, None), ("early", "2019", "2021"), ("also", "2021", "")), member("", "Z")], MEMBERS, tmp_path)
    flat = ingest.history_of(rows)
    assert [tuple(r) for r in flat.orderBy("name", "place").collect()] == [("A B", "early", "2019", "2021", 0), ("A B", "late", "2021", "2099-12-31", 1), ("A B", "also", "2021", "2099-12-31", 2)]
    files.write_history(flat, str(tmp_path / "map"))
    assert ingest.history_map(files.read_history(spark, str(tmp_path / "map"))).first().history[0].faction == "early"
    assert files.read_history(spark, str(tmp_path / "nothing")).count() == 0
    twice = spark.createDataFrame([("A", "B", [("x", ("2019", None))], 0), ("A", "B", [("y", ("2020", None))], 1)], "firstName string, lastName string, factions array<struct<name: string, membership: struct<startDate: string, endDate: string>>>, place_of_member int")
    assert [r.faction for r in ingest.history_of(twice).collect()] == ["y"]


def test_load(spark):
    rows = [(1, "f", "s", "t", "2020-01-01", "0900", "u"), (2, "f", "s", "t", "2020-01-02", "0900", "u"), (3, "f", "s", "other", None, "0900", "u"), (4, "g", "s", "t", "2020-01-01", "0900", "u")]
    df = spark.createDataFrame(rows, "n int, source_file string, speaker string, text string, date string, time string, source_url string")
    got = ingest.load(df, order=[df.n])
    assert sorted(r.n for r in got.collect()) == [1, 4]
    assert ingest.complete(df)[1].count() == 1
    assert sorted(r.n for r in ingest.load(df, existing=got.where("n = 1"), order=[df.n]).collect()) == [4]


def test_attendance(spark, tmp_path):
    days = frame(spark, [{"votings": [{"uuid": "u1", "startDateTime": "d1", "type": {"code": ingest.ROLL_CALL}}, {"uuid": "u2", "type": {"code": "X"}}, {"uuid": "u3"}]}, {}], VOTINGS, tmp_path)
    assert [tuple(r) for r in ingest.roll_calls(days).collect()] == [("u1", "d1")]
    voter = {"fullName": "A", "faction": {"name": "F"}, "decision": {"code": "KOHAL"}}
    votings = frame(spark, [{"uuid": "u1", "startDateTime": "d1", "voters": [voter, voter, {}]}, {"uuid": "u4", "startDateTime": "d", "voters": []}, {"uuid": "u5", "voters": [voter]}], VOTERS, tmp_path, "v")
    known = spark.createDataFrame([("d", "u5", "A", "", "KOHAL")], ATTENDANCE)
    assert {tuple(r) for r in ingest.attendance_of(votings, known).collect()} == {("d1", "u1", "A", "F", "KOHAL"), ("d1", "u1", "", "", "")}


def test_files(spark, tmp_path):
    from tribune.schemas import SPEECH_LINES

    rows = spark.createDataFrame([("2020-01-01", "0900", "f", "u", "s", None, None, "õ", ""), ("2021-01-01", "0900", "f", "u", "s", None, None, "b", "")], SPEECH_LINES)
    out = str(tmp_path / "speeches")
    files.write_speeches(rows, out)
    files.write_speeches(rows, out)
    assert files.read_speeches(spark, out).count() == 4
    assert [r.text for r in files.read_speeches(spark, out, strict=True, year=2020).collect()] == ["õ", "õ"]
    assert files.read_speeches(spark, out, year=1900).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"date": "2020-01-01"}\nnot json\n')
    assert files.read_speeches(spark, str(tmp_path / "bad.jsonl")).cache().where("_corrupt_record is not null").count() == 1


def test_stream_restarts(spark, tmp_path, history):
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    put("1.json", SITTINGS[:2])
    stream.ingest_stream(spark, landing, out, check, history, SimpleAnalyzer()).awaitTermination()
    first = files.read_speeches(spark, out).count()
    assert first in (1, 2)  # of two sittings with one uid either is taken
    put("2.json", SITTINGS)
    stream.ingest_stream(spark, landing, out, check, history, SimpleAnalyzer()).awaitTermination()
    rows = files.read_speeches(spark, out)
    assert rows.count() == first + 1
    assert rows.where("text = 'Kolmas'").first().speaker_faction == "F2"
    other = str(tmp_path / "bounded")
    stream.ingest_stream(spark, landing, other, other + "-check", history, SimpleAnalyzer(), forget_after="14 days").awaitTermination()
    assert files.read_speeches(spark, other).count() == first + 1


def test_rest_sources(spark):
    def transport(url, params):
        if url.endswith("/late"):
            return 429, None
        if url.endswith("/u1"):
            return 200, {"voters": [{"fullName": "A"}]}
        if url.endswith("/u2"):
            return 200, {"voters": []}
        if params.get("startDate") == "2024-02-01":
            return 500, None
        return 200, [{"link": params.get("startDate", "one"), "date": "2024-01-01"}]

    rest.register(spark, transport)
    rows = lambda f, **o: sorted(r.json for r in spark.read.format(f).options(pause="0", wait="0", **o).load().collect())
    got = rows("rest_months", url="http://x", months='[["2024-01-10", "2024-01-31"], ["2024-02-01", "2024-02-29"], ["2024-03-01", "2024-03-05"]]')
    assert [json.loads(r)["link"] for r in got] == ["2024-01-10", "2024-03-01"]
    assert len(rows("rest_list", url="http://x", params='{"a": [1, 2]}')) == 1
    votings = json.dumps([{"uuid": u, "startDateTime": "d"} for u in ("u1", "u2", "late")])
    assert [json.loads(r)["uuid"] for r in rows("rest_voters", url="http://x", votings=votings, tries="2")] == ["u1"]


def test_streaming_counts_are_batch_counts(spark, tmp_path):
    days = ["2024-01-01", "2024-01-01", "2024-01-05", "2024-02-01", "2024-02-01", "2024-03-01"]
    spark.createDataFrame([(d,) for d in days], "date string").write.json(str(tmp_path / "days"))
    rows = spark.readStream.schema("date string").json(str(tmp_path / "days"))
    query = stream.counts(rows).writeStream.format("memory").queryName("day_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("day_counts").collect():
        got[r.date] = max(got.get(r.date, 0), r["count"])
    assert got == {d: days.count(d) for d in days}


@pytest.mark.parametrize("interval", ["weekly", "monthly"])
def test_calendar_periods_end(spark, tmp_path, interval):
    """Ten years of days, a file a year: counts are those of a batch, and only what the watermark has not passed keeps state."""
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    from tribune.functions import dates

    first = date(2010, 1, 1)
    days = [(first + timedelta(days=k)).isoformat() for k in range(0, 3652, 3)]
    landing = tmp_path / "in"
    landing.mkdir()
    schema = "date string"
    query_of = lambda: (
        stream.counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landing)), interval)
        .writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.write.mode("overwrite").json(f"{tmp_path}/out/batch={k}"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    states = []
    for y in range(2010, 2020):
        own = [d for d in days if d.startswith(str(y))]
        (landing / f"{y}.json").write_text("\n".join(json.dumps({"date": d}) for d in [*own, "no date"]))
        query = query_of()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    name = {"weekly": "week", "monthly": "month"}[interval]
    batch = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in days], schema).groupBy(dates.period(F.col("date"), interval)[0]).count().collect()}
    changed = spark.read.schema(f"{name} string, count long, batch int").option("basePath", f"{tmp_path}/out").json(f"{tmp_path}/out")
    got = {r[0]: r[1] for r in changed.groupBy(name).agg(F.max_by("count", "batch")).collect()}
    assert got == batch and max(states) <= {"weekly": 4, "monthly": 2}[interval], states
    # what comes after its period was closed does not count again
    (landing / "late.json").write_text(json.dumps({"date": "2012-02-02"}))
    query_of().awaitTermination()
    again = {r[0]: r[1] for r in changed.groupBy(name).agg(F.max_by("count", "batch")).collect()}
    assert again == got
