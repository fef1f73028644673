import pytest

from tribune.operators import attendance
from tribune.operators.analyzer import SimpleAnalyzer
from tribune.operators.index import postings
from tribune.schemas import ATTENDANCE
from tribune.service import Invalid, Service


@pytest.fixture(scope="module")
def service(spark):
    rows = [(1, "2024-01-01", "0900", "A", "kliima muutub", "u1"), (2, "2024-03-01", "0900", "B", "kliima kliima ilm", "u2")]
    speeches = spark.createDataFrame(rows, "speech_id long, date string, time string, speaker string, text string, source_url string")
    roll = spark.createDataFrame([("d", f"v{k}", "A", "", "KOHAL" if k == 0 else "PUUDUB") for k in range(16)] + [("d", "v0", "B", "", "KOHAL"), ("d", "v0", "C", "", "KOHAL"), ("d", "v1", "C", "", "KOHAL")], ATTENDANCE)
    return Service(speeches, postings(speeches, SimpleAnalyzer()), roll)


def test_endpoints(service):
    assert service.root() == {"status": "ok"}
    found = service.search("kliima", 1)
    assert found == {"query": "kliima", "count": 1, "results": [{"speaker": "B", "text": "kliima kliima ilm", "count": 2, "date": "2024-03-01", "time": "0900", "source_url": "u2"}]}
    assert service.activity("kliima") == {"query": "kliima", "interval": "monthly", "activity": [{"month": "2024-01", "count": 1}, {"month": "2024-02", "count": 0}, {"month": "2024-03", "count": 1}]}
    assert service.speakers("kliima", 1)["speakers"] == [{"speaker": "B", "count": 2}]
    assert service.search("ja")["results"] == [] and service.speakers("")["speakers"] == []
    for bad in (lambda: service.search(""), lambda: service.search("a", 0), lambda: service.search("a", 201), lambda: service.activity("")):
        with pytest.raises(Invalid):
            bad()


def test_attendance(spark, service):
    got = service.attendance()
    assert [(r["member_name"], r["total_sessions"], r["present_sessions"], r["attendance_percentage"]) for r in got] == [("C", 2, 2, 100.0), ("B", 1, 1, 100.0), ("A", 16, 1, 6.2)]
    rows = attendance.stats(service.roll)
    assert [r.member_name for r in attendance.sort(rows, "member_name", ascending=True).collect()] == ["A", "B", "C"]
    assert {r.member_name: r.band for r in attendance.banded(rows).collect()} == {"A": "red", "B": "green", "C": "green"}
    with pytest.raises(ValueError):
        attendance.sort(rows, "other")
