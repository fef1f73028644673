"""Learned lemmas, the same everywhere."""

import pytest

from tribune.operators import index, search
from tribune.operators.analyzer import DictionaryAnalyzer
from tribune.operators.lemmas import LemmaAnalyzer, Lemmatiser, known_forms, learn
from tribune.operators.query import parse_query

#: Case forms of Estonian nouns; the stems of the last two are unknown.
FORMS = [(f"{stem}{end}", f"{stem}") for stem in ("kliima", "muutuse", "energia", "valitsuse", "komisjoni") for end in ("", "t", "s", "st", "le", "ga", "d", "ks")] + [("seda", "see"), ("sellest", "see"), ("läks", "minema")]


@pytest.fixture(scope="module")
def analyzer(spark):
    return LemmaAnalyzer.learned(spark.createDataFrame(FORMS, "form string, lemma string"))


def test_rules(spark, analyzer):
    of = analyzer.model
    assert [of.lemma(w) for w in ("kliimat", "seda", "läks", "rahandusega", "maailmast", "teemaks", "xyz")] == ["kliima", "see", "minema", "rahanduse", "maailma", "teema", "xyz"]
    assert of.analyses("tundmatust")[0] == "tundmatu" and len(of.analyses("õpetajad")) >= 1
    ranked = {(r.suffix, r.place): (r.cut, r.add, r.n) for r in learn(spark.createDataFrame(FORMS, "form string, lemma string")).collect()}
    assert ranked[("ga", 1)] == (2, "", 5) and all(n >= 2 for _, _, n in ranked.values())
    # a longer suffix that says the same is not kept
    assert ("aga", 1) not in ranked


def test_left_out_suffixes_change_nothing(spark):
    """All suffixes' first rules, as a plain count, against the shortened table."""
    from collections import Counter

    words = [(a + b + c, a + b) for a in ("ka", "la", "mu", "nõ") for b in ("ri", "ta", "sse", "") for c in ("", "d", "dd", "sid", "ta")]
    words = sorted({f: min(m for g, m in words if g == f and m) for f, m in words if m}.items())
    counts: dict[str, Counter] = {}
    for form, lemma in words:
        p = 0
        while p < min(len(form), len(lemma)) and form[p] == lemma[p]:
            p += 1
        cut = len(form) - p
        for k in range(cut, max(cut, min(len(form) + 1, 6)) + 1):
            counts.setdefault(("^" + form)[len(form) + 1 - k :], Counter())[cut, lemma[p:]] += 1
    first = {s: min(((-n, *r) for r, n in c.items() if n >= 2), default=None) for s, c in counts.items()}
    rules = learn(spark.createDataFrame(words, "form string, lemma string")).collect()
    of = Lemmatiser([], [(r.suffix, r.cut, r.add, r.place) for r in rules])
    for form in [f for f, _ in words] + ["xxsid", "tata", "q", "kkdd", "õta"]:
        own = next((f for k in range(len(form) + 1, -1, -1) if (f := first.get(("^" + form)[len(form) + 1 - k :]))), None)
        assert of.lemma(form) == ((form[: len(form) - own[1]] + own[2]) or form if own else form), form


def test_one_analyzer_everywhere(spark, analyzer):
    rows = spark.createDataFrame([(1, "Kliimat ja rahandusega, KLIIMAST", None), (2, "maailm", None), (3, None, None)], "speech_id long, text string, text_lemmas string")
    assert [r.text_lemmas for r in index.lemmatised(rows, analyzer).orderBy("speech_id").collect()] == ["kliima ja rahanduse kliima", "maailm", ""]
    postings = index.postings(rows, analyzer)
    assert {(r.speech_id, r.lemma, r["count"]) for r in postings.collect()} == {(1, "kliima", 2), (1, "ja", 1), (1, "rahanduse", 1), (2, "maailm", 1)}
    for query in ("kliimaga", "rahanduseks kliima", "KLIIMAD"):
        groups = parse_query(query, analyzer)
        want = [(1, {"kliimaga": 2, "rahanduseks kliima": 3, "KLIIMAD": 2}[query])]
        assert [tuple(r) for r in search.match(postings, groups).collect()] == want
        assert [(r.speech_id, r["count"]) for r in search.match_texts(rows, groups, analyzer).collect()] == want
    # a stopword is known by its lemma
    assert parse_query("seda", analyzer) == []


def test_joined_table_refuses_columns(spark):
    joined = DictionaryAnalyzer(spark.createDataFrame(FORMS, "form string, lemma string"))
    rows = spark.createDataFrame([(1, "Kliimat kliimat", "")], "speech_id long, text string, text_lemmas string")
    with pytest.raises(TypeError, match="LemmaAnalyzer"):
        index.lemmatised(rows, joined)
    with pytest.raises(TypeError, match="LemmaAnalyzer"):
        search.match_texts(rows, [["kliima"]], joined)
    assert [tuple(r) for r in index.postings(rows, joined).collect()] == [(1, "kliima", 2)]


def test_bounds_and_odd_tables(spark):
    table = spark.createDataFrame([(None, "x"), ("", "x"), ("A", None), ("B", "C"), ("b", "c"), ("b", "a")], "form string, lemma string")
    assert [tuple(r) for r in known_forms(table).collect()] == [("b", "a")]
    with pytest.raises(ValueError, match="more than 3"):
        LemmaAnalyzer(spark.createDataFrame(FORMS, "form string, lemma string"), most=3)
    assert LemmaAnalyzer.learned(table.limit(0)).tokens_of("Ab c") == [["ab", "c"]]
