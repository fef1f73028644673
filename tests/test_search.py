import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tribune.operators import index, search
from tribune.operators.analyzer import PandasAnalyzer, SimpleAnalyzer
from tribune.operators.query import build_query, parse_query

POSTINGS = [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 4), (3, "c", 1), (3, "d", 1), (4, "a", 1), (4, "b", 1), (4, "c", 5)]
WORDS = PandasAnalyzer(str.split)


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame(POSTINGS, "speech_id long, lemma string, count long").cache()


@pytest.mark.parametrize(
    ("query", "groups"),
    [
        ("kliima", [["kliima"]]),
        ("tartu ülikool", [["tartu", "ülikool"]]),
        ("kliima, ilm", [["kliima"], ["ilm"]]),
        ("kliima muutus, taastuv energia", [["kliima", "muutus"], ["taastuv", "energia"]]),
        ("ja kliima, on", [["kliima"]]),
        (",,", []),
        ("ja ning", []),
        ("kliima kliima", [["kliima", "kliima"]]),
    ],
)
def test_parse(spark, query, groups):
    assert parse_query(query, SimpleAnalyzer()) == groups
    assert parse_query(query, WORDS) == groups


def test_build_and_options(spark):
    assert build_query([["a", " b "], [], ["", "c"]]) == "a b, c"
    assert parse_query("kliima kliima", WORDS, dedupe_terms=True) == [["kliima"]]


@pytest.mark.parametrize(
    ("query", "expected"),
    [("a", {1: 2, 2: 1, 4: 1}), ("a b", {1: 3, 4: 2}), ("a, d", {1: 2, 2: 1, 3: 1, 4: 1}), ("a b, c d", {1: 3, 3: 2, 4: 7}), ("a a", {}), ("", {})],
)
def test_match(spark, postings, query, expected):
    groups = parse_query(query, WORDS)
    assert {r.speech_id: r["count"] for r in search.match(postings, groups).collect()} == expected
    texts = {}
    for i, w, n in POSTINGS:
        texts[i] = texts.get(i, []) + [w] * n
    speeches = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "speech_id long, text string")
    for analyzer in (SimpleAnalyzer(), WORDS):
        assert {r.speech_id: r["count"] for r in search.match_texts(speeches, groups, analyzer).collect()} == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=3, unique=True), min_size=1, max_size=3))
def test_alternatives_are_unions(spark, postings, groups):
    ids = lambda g: {r.speech_id for r in search.match(postings, g).collect()}
    assert ids(groups) == set().union(*(ids([g]) for g in groups)) == ids(groups[::-1])
    for g in groups:
        assert ids([g]) <= set.intersection(*(ids([[w]]) for w in g))


@pytest.fixture(scope="module")
def speeches(spark):
    rows = [(1, "2023-11-30", "0900", "B", "x", "u"), (2, "2024-01-01", "0900", "A", "y", "u"), (3, "2024-01-07", "1000", "A", "z", "u"), (4, "2024-01-08", "0900", "B", "w", "u"), (5, "no date", "0900", "B", "w", "u")]
    return spark.createDataFrame(rows, "speech_id long, date string, time string, speaker string, text string, source_url string")


def test_activity(spark, speeches):
    every = spark.createDataFrame([(k, k) for k in range(1, 6)], "speech_id long, count long")
    run = lambda i, **k: [tuple(r) for r in search.activity(search.attach(speeches, every), i, **k).collect()]
    assert run("monthly") == [("2023-11", 1), ("2023-12", 0), ("2024-01", 3)]
    assert run("weekly") == run("fortnightly") == [(None, 1), ("2023-48", 1), ("2024-01", 2), ("2024-02", 1)]
    assert run("daily") == [("2023-11-30", 1), ("2024-01-01", 1), ("2024-01-07", 1), ("2024-01-08", 1), ("no date", 1)]
    assert run("monthly", metric="mentions") == [("2023-11", 1), ("2023-12", 0), ("2024-01", 9)]
    assert search.activity(search.attach(speeches, every.limit(0)), "monthly").collect() == []


def test_search_and_speakers(spark, speeches):
    found = spark.createDataFrame([(1, 4), (2, 1), (3, 3), (4, 2)], "speech_id long, count long")
    got = search.search(speeches, found, 2).collect()
    assert [r["date"] for r in got] == ["2024-01-08", "2024-01-07"]
    assert got[0].asDict() == {"speaker": "B", "text": "w", "count": 2, "date": "2024-01-08", "time": "0900", "source_url": "u"}
    assert [r["date"] for r in search.newest(search.attach(speeches, found), 2).collect()] == ["2024-01-08", "2024-01-07"]
    top = lambda n: [tuple(r) for r in search.top_speakers(search.attach(speeches, found), n).collect()]
    assert top(20) == top(-1) == [("B", 6), ("A", 4)]
    assert top(1) == [("B", 6)] and top(0) == []


def test_index(spark):
    rows = spark.createDataFrame([(1, "Tere, TERE 2x maa-ilm", None), (2, "", ""), (3, None, "old"), (4, "x1 7", None)], "speech_id long, text string, text_lemmas string")
    found = index.postings(rows, SimpleAnalyzer())
    assert {(r.speech_id, r.lemma, r["count"]) for r in found.collect()} == {(1, "tere", 2), (1, "maa", 1), (1, "ilm", 1)}
    assert [r.text_lemmas for r in index.lemmatised(rows, SimpleAnalyzer()).orderBy("speech_id").collect()] == ["tere tere maa ilm", "", "old", ""]
    assert {r.speech_id for r in index.missing(rows, found).collect()} == {2, 3, 4}
    assert index.extend(rows, found, SimpleAnalyzer()).count() == 0
    assert {r.lemma for r in index.new_lemmas(found, spark.createDataFrame([("tere",)], "lemma string")).collect()} == {"maa", "ilm"}
    assert {r.lemma: (r.n_speeches, r.n_occurrences) for r in index.dictionary(found).collect()}["tere"] == (1, 2)


def test_bucketed_index_needs_no_exchange(spark, postings):
    index.save(postings, "test_index", buckets=4)
    plan = search.match(spark.table("test_index"), [["a", "b"], ["c"]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "In(lemma" in plan
    spark.sql("drop table test_index")


@pytest.mark.parametrize("name", ["search_top50", "activity_daily", "activity_monthly_filled", "top_speakers"])
def test_texts_are_read_once(spark, sf_dir, name, capsys):
    from tribune import queries

    queries.QUERIES[name](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert sum("documents.parquet" in line for line in plan.split("\n") if line.startswith("Location")) == 1


def test_dictionary(spark):
    from tribune.operators.analyzer import DictionaryAnalyzer
    from tribune.operators.query import parse_query

    forms = spark.createDataFrame([("kliimat", "kliima"), ("kliimat", "zzz"), ("seda", "see"), ("ilmad", "ilm")], "form string, lemma string")
    analyzer = DictionaryAnalyzer(forms)
    rows = spark.createDataFrame([(1, "Kliimat kliima ILMAD"), (2, "muu")], "speech_id long, text string")
    found = index.postings(rows, analyzer)
    assert {(r.speech_id, r.lemma, r["count"]) for r in found.collect()} == {(1, "kliima", 2), (1, "ilm", 1), (2, "muu", 1)}
    # the stopword is known by its lemma
    assert parse_query("kliimat seda, ILMAD", analyzer) == [["kliima"], ["ilm"]]
    assert [tuple(r) for r in search.match(found, parse_query("kliimat ilm", analyzer)).collect()] == [(1, 3)]
