"""The segmented index: arrivals, merges and deletions give what one build gives."""

import random

import pytest

from tribune.operators import index, search
from tribune.operators.analyzer import SimpleAnalyzer
from tribune.operators.query import parse_query
from tribune.operators.segments import LEMMAS, SEGMENTS, SegmentIndex, size_tier
from tribune.sources.store import Conflict

ANALYZER = SimpleAnalyzer()
SCHEMA = "speech_id long, text string"


def speeches(spark, ids, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    return spark.createDataFrame([(i, " ".join(random.Random(i).choices(words, k=i % 13))) for i in ids], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def name(spark):
    yield "test_segments"
    spark.sql("drop table if exists test_segments")


def test_arrivals_merge_and_deletions(spark, tmp_path, name):
    own = SegmentIndex(spark, str(tmp_path / "i"), name, buckets=4)
    assert own.live().count() == 0 and rows(own.match("aa", ANALYZER)) == []
    for k in range(3):
        own.add(speeches(spark, range(100 * k, 100 * k + 100)), ANALYZER)
    own.delete(speeches(spark, [5, 150, 999]))
    kept = speeches(spark, [i for i in range(300) if i not in (5, 150)])
    once = index.postings(kept, ANALYZER)
    assert rows(own.postings()) == rows(once) and len(own.store.parts(SEGMENTS)) == 3
    assert own.merge(fan=3) == 1 and len(own.store.parts(SEGMENTS)) == 1 and not own.store.parts("deleted")
    assert rows(own.postings()) == rows(once)
    # what was deleted may come again, and only its new words count
    own.add(spark.createDataFrame([(5, "zz zz a")], SCHEMA), ANALYZER)
    assert {r for r in rows(own.postings()) if r[0] == 5} == {(5, "a", 1), (5, "zz", 2)}
    own.delete(speeches(spark, [7]))
    assert not [r for r in rows(own.postings()) if r[0] == 7] and [r for r in rows(own.postings()) if r[0] == 5]
    own.clean()
    # another session's view of the folder
    spark.sql(f"drop table {name}")
    again = SegmentIndex(spark, str(tmp_path / "i"), name)
    assert again.buckets == 4 and rows(again.postings()) == rows(own.postings())
    for query in ("a b, c", "zz", "a nowhere", "nowhere, a", ""):
        want = search.match(again.postings(), parse_query(query, ANALYZER))
        assert rows(again.match(query, ANALYZER)) == rows(want), query


def test_ids_are_dense_and_stay(spark, tmp_path, name):
    own = SegmentIndex(spark, str(tmp_path / "i"), name, buckets=2)
    seen = {}
    for k in range(3):
        own.add(speeches(spark, range(40 * k, 40 * k + 40), seed=k).repartition(5), ANALYZER)
        own.store.refresh()
        ids = {r.lemma: r.id for r in own.store.read(LEMMAS, "lemma string, id long").collect()}
        assert sorted(ids.values()) == list(range(1, len(ids) + 1)) and seen.items() <= ids.items()
        assert own.store.notes["last_id"] == len(ids)
        seen = ids
    own.add(spark.createDataFrame([(900, ""), (901, None)], SCHEMA), ANALYZER)
    assert own.store.notes["last_id"] == len(seen)


def test_search_plans_without_exchange(spark, tmp_path, name):
    own = SegmentIndex(spark, str(tmp_path / "i"), name, buckets=4)
    for k in range(3):
        own.add(speeches(spark, range(50 * k, 50 * k + 50)), ANALYZER)
    own.delete(speeches(spark, [3]))
    plan = own.match("a b, c", ANALYZER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(speech_id" not in plan.replace("BroadcastExchange", "") or "Exchange hashpartitioning(speech_id" in plan.split("BroadcastExchange")[1]
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "lemma_id" in line)
    assert "segment" in scan and "In(lemma_id" in scan
    dead = own._write(own.live())  # a segment that never counted is not read
    assert dead["id"] not in {p["id"] for p in own.store.parts(SEGMENTS)} and own.match("a", ANALYZER).count() > 0
    assert rows(own.postings()) == rows(index.postings(speeches(spark, [i for i in range(150) if i != 3]), ANALYZER))


def test_two_writers(spark, tmp_path, name):
    a, b = (SegmentIndex(spark, str(tmp_path / "i"), name, buckets=2) for _ in range(2))
    a.add(speeches(spark, range(20)), ANALYZER)
    with pytest.raises(Conflict):
        b.add(speeches(spark, range(20, 40)), ANALYZER)
    b.store.refresh()
    b.add(speeches(spark, range(20, 40)), ANALYZER)
    assert rows(b.postings()) == rows(index.postings(speeches(spark, range(40)), ANALYZER))


def test_tiers():
    assert [size_tier(n) for n in (0, 100_000, 100_001, 400_000, 400_001)] == [0, 0, 1, 1, 2]
