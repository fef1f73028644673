import json

import pytest

from tribune import schemas
from tribune.__main__ import JOBS, main
from tribune.operators.analyzer import SimpleAnalyzer
from tribune.operators.segments import SegmentIndex
from tribune.plans import jobs
from tribune.plans.ingest import ROLL_CALL
from tribune.plans.publish import Aside
from tribune.sources import files, rest
from tribune.sources.store import Store


def transport(url, params):
    if url.endswith("/members"):
        return 200, [{"firstName": "A", "lastName": "B", "factions": [{"name": "F", "membership": {"startDate": "2020-01-01"}}]}]
    if url.endswith("/votings"):
        return 200, [{"votings": [{"uuid": "u1", "startDateTime": "d", "type": {"code": ROLL_CALL}}, {"uuid": "u2", "startDateTime": "d", "type": {"code": "X"}}]}]
    if url.endswith("/votings/u1"):
        return 200, {"voters": [{"fullName": "A B", "decision": {"code": "KOHAL"}}]}
    if params.get("startDate") == "2024-01-01":
        event = {"type": "SPEECH", "text": "Kliima muutub, kliima", "speaker": "Peaminister A B"}
        return 200, [{"link": "https://s.example/202401081500", "date": "2024-01-08T13:00", "agendaItems": [{"events": [event, event]}]}]
    return 500, None


def test_pipeline_of_jobs(spark, tmp_path):
    rest.register(spark, transport)
    at = lambda n: str(tmp_path / n)
    run = lambda job, **o: main([job, *(f"{k}={v}" for k, v in o.items())], spark)
    run("fetch_factions", url="http://x/members", out=at("factions"))
    for _ in range(2):  # nothing comes twice
        run("fetch_sittings", url="http://x/v", start="2024-01-01", end="2024-02-20", out=at("lines"), ledger=at("ledger"), history=at("factions"), pause=0)
        run("load_speeches", lines=at("lines"), speeches=at("speeches"))
        run("build_terms", speeches=at("speeches"), postings=at("postings"))
        run("fetch_attendance", url="http://x/votings", start="2024-01-01", end="2024-02-20", attendance=at("attendance"), pause=0, wait=0)
    (speech,) = spark.read.parquet(at("speeches")).collect()
    assert (speech.speaker, speech.speaker_role, speech.speaker_faction, speech.text_lemmas) == ("A B", "Peaminister", "F", None)
    run("build_lemmas", speeches=at("speeches"), lemmas=at("lemmas"))
    assert spark.read.parquet(at("lemmas")).first().text_lemmas == "kliima muutub kliima"
    assert {(r.lemma, r["count"]) for r in spark.read.parquet(at("postings")).collect()} == {("kliima", 2), ("muutub", 1)}
    spark.createDataFrame([("muutub", "muutuma"), ("kaotab", "kaotama"), ("kliimat", "kliima")], "form string, lemma string").write.parquet(at("dictionary"))
    run("learn_lemmas", dictionary=at("dictionary"), model=at("model"))
    run("build_lemmas", speeches=at("speeches"), lemmas=at("learned"), model=at("model"))
    assert spark.read.parquet(at("learned")).first().text_lemmas == "kliima muutuma kliima"
    run("build_index", postings=at("postings"), table="job_index")
    assert spark.table("job_index").count() == 2
    spark.sql("drop table job_index")
    for _ in range(2):
        run("update_index", speeches=at("speeches"), folder=at("segments"), table="job_segments")
    assert {(r.lemma, r["count"]) for r in SegmentIndex(spark, at("segments"), "job_segments").postings().collect()} == {("kliima", 2), ("muutub", 1)}
    spark.sql("drop table job_segments")
    assert [tuple(r) for r in spark.read.parquet(at("attendance")).collect()] == [("d", "u1", "A B", "", "KOHAL")]
    assert len(json.loads(json.dumps(sorted(JOBS)))) == 12


def test_polling_window(spark):
    from datetime import date

    from tribune.plans.jobs import _polled

    today = date(2024, 3, 10)
    polled = lambda *a: _polled(spark, *a)[:2]
    assert polled(False, None, None, today) == ("2019-04-04", "2024-03-10")
    assert polled(True, None, None, today) == ("2024-02-25", "2024-03-10")
    assert polled(True, "2024-01-01", None, today, "2024-02-02") == ("2024-01-01", "2024-02-02")
    assert polled(True, None, "2024-03-01", today, "2024-02-02")[1] == "2024-03-01"
    months = _polled(spark, False, "2019-04-04", "2019-06-10", today)[2]
    assert months == [("2019-04-04", "2019-04-30"), ("2019-05-01", "2019-05-31"), ("2019-06-01", "2019-06-10")]
    assert _polled(spark, False, "2020-01-02", "2020-01-01", today)[2] == []


def test_rejects_are_kept(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    good = {"date": "2020-01-01", "time": "0900", "source_file": "f", "source_url": "u", "speaker": "s", "text": "t"}
    (tmp_path / "2020.jsonl").write_text("\n".join([json.dumps(good), "not json", json.dumps(good | {"text": None, "speaker": None}), json.dumps(good | {"extra": 1}), "not json"]))
    assert jobs.load_speeches(spark, at("2020.jsonl"), at("speeches")) == {"read": 5, "good": 2, "rejected": 1, "malformed": 2, "new": 1}
    (tmp_path / "2021.jsonl").write_text("{\n" + json.dumps(good | {"text": "other"}))
    assert jobs.load_speeches(spark, at("2020.jsonl"), at("speeches"))["new"] == 0
    assert jobs.load_speeches(spark, at("2021.jsonl"), at("speeches")) == {"read": 2, "good": 1, "rejected": 0, "malformed": 1, "new": 1}
    bad = Store(spark, at("speeches")).read(jobs.REJECTED, schemas.REJECTED).collect()
    assert sorted((r.reason, r.file.rsplit("/", 1)[1]) for r in bad) == [("malformed", "2020.jsonl"), ("malformed", "2021.jsonl"), ("without speaker, text", "2020.jsonl")]
    assert {r.record for r in bad if r.reason == "malformed"} == {"not json", "{"}
    assert jobs.stored(spark, at("speeches"), schemas.SPEECHES).count() == 2


class Lost(Exception):
    pass


def test_sittings_and_ledger_come_together(spark, tmp_path, monkeypatch):
    """A run is cut at each of its steps, given again, and leaves what an undisturbed one leaves."""
    rest.register(spark, transport)
    at = lambda n: str(tmp_path / n)
    fetch = lambda where: jobs.fetch_sittings(spark, "http://x/v", at(f"{where}/lines"), at(f"{where}/ledger"), at("none"), SimpleAnalyzer(), "2024-01-01", "2024-02-20", "0", at(f"{where}/state"))
    seen = lambda where: (sorted(map(str, files.read_speeches(spark, at(f"{where}/lines")).collect())), sorted(map(str, files.read_ledger(spark, at(f"{where}/ledger")).collect())), jobs.last_processed(spark, at(f"{where}/state")))
    fetch("whole")
    assert seen("whole")[2] == "2024-02-20" and len(seen("whole")[0]) == 2
    step, crashed = 0, True
    while crashed:
        calls = []

        def failing(real, calls=calls, step=step):
            def run(self, *args):
                calls.append(real.__name__)
                if len(calls) > step:
                    raise Lost
                return real(self, *args)

            return run

        with monkeypatch.context() as m:
            for name in ("write", "commit", "_move", "_delete"):
                m.setattr(Aside, name, failing(getattr(Aside, name)))
            try:
                fetch(str(step))
                crashed = False
            except Lost:
                pass
        fetch(str(step))
        assert seen(str(step)) == seen("whole"), (step, calls)
        assert Aside(spark, at(f"{step}/lines/_aside")).runs() == []
        step += 1
    assert step > 7  # three folders written, the manifest, three files moved, the run deleted


def test_store(spark, tmp_path):
    from datetime import date

    at = lambda n: str(tmp_path / n)
    year = date.today().year
    rows = spark.createDataFrame([(f"{y}-01-0{k}", f"u{k}") for y in (2020, year) for k in (1, 2)], "date string, source_url string")
    files.write_speeches(rows.selectExpr("date", "'0900' as time", "'f' as source_file", "source_url", "'s' as speaker", "'t' as text"), at("lines"))
    main(["upload", f"lines={at('lines')}", f"store={at('store')}"], spark)
    main(["download", f"store={at('store')}", f"lines={at('back')}"], spark)
    read = lambda: sorted(r.date for r in files.read_speeches(spark, at("back")).collect())
    assert read() == [f"{year}-01-01", f"{year}-01-02"]
    for _ in range(2):  # replaces, does not append
        main(["download_all", f"store={at('store')}", f"lines={at('back')}"], spark)
    assert read() == ["2020-01-01", "2020-01-02", f"{year}-01-01", f"{year}-01-02"]


def test_stores_keep_bytes(spark, tmp_path):
    """Both layouts, with lines that are none and fields nobody knows, arrive as they were; a crash leaves no name that counts."""
    import hashlib

    from tribune.sources import mirror

    store, back = tmp_path / "store", tmp_path / "back"
    (store / "year=2023").mkdir(parents=True)
    contents = {"2024.jsonl": b'{"date": "2024-01-01", "new": 1}\nnot json\n', "2022.jsonl": b"", "year=2023/part-0.json": "\xff õ".encode() * 300_000, "year=2023/part-1.json": b"{}"}
    for name, data in contents.items():
        (store / name).write_bytes(data)
    for name in ("notes.txt", ".2021.jsonl", "x2020.json"):
        (store / name).write_bytes(b"other")
    jobs.download(spark, str(store), str(back), "2024")
    assert sorted(p.name for p in back.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["2024.jsonl"]
    jobs.download(spark, str(store), str(back))  # nothing is there of the current year
    (back / "year=2023").mkdir()
    (back / "year=2023" / "old.json").write_bytes(b"{}")
    (back / "2019.jsonl").write_bytes(b"{}")
    got = {r.name: (r.bytes, r.sha256) for r in mirror.mirror(spark, str(store), str(back)).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    there = {str(p.relative_to(back)): p.read_bytes() for p in back.rglob("*.json*")}
    assert there == contents | {"2019.jsonl": b"{}"}
    assert files.read_speeches(spark, str(back / "2024.jsonl")).where("date = '2024-01-01'").count() == 1
    # a file that changes while it is copied
    with pytest.raises(mirror.Broken):
        mirror.copy_file(mirror._open(str(store / "2024.jsonl")), mirror._open(str(back / "2030.jsonl")), 7)
    assert not list(back.glob("*2030*")) and not list(back.glob(".2030*"))
    assert mirror.mirror(spark, str(tmp_path / "none"), str(back)).count() == 0


def test_usage(capsys):
    assert main([]) == 2 and "load_speeches" in capsys.readouterr().out
