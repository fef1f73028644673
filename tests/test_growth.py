"""What only larger tables show, on small ones made for it."""

import random

import pandas as pd

from tests.test_entry import same
from tribune import queries
from tribune.operators import index, segments
from tribune.operators.analyzer import DictionaryAnalyzer, SimpleAnalyzer
from tribune.sources import files
from tribune.sources.store import ROWS, Store
from tribune.tables import TEXTS, cut
from tribune.operators.lemmas import LemmaAnalyzer, Lemmatiser, known_forms, learn, load_model, save_model


def test_streamed_parts_of_a_link_are_all_kept(spark, tmp_path):
    # conversations 1 and 2401 share a link, 5 and 705 have none and share a date, and 2 is three payloads; 3 and 16803 are the same but for their number
    turns = [(c, t, "user", f"{c} says {t}") for c, n in ((1, 3), (2401, 2), (5, 2), (705, 2), (2, 130)) for t in range(n)]
    turns += [(c, 0, "assistant", "the same") for c in (3, 16803)]
    pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    same(spark, "stream_speeches", queries.QUERIES["stream_speeches"], queries.ORACLES["stream_speeches"], str(tmp_path))


def test_a_model_grows_by_exceptions_only(spark, tmp_path):
    """More forms than an analyzer may hold, nearly all of which rules give: none is refused, and each has the lemma of the whole table."""
    rng = random.Random(5)
    stems = sorted({"".join(rng.choice("abdeiklmnorstuõ") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    forms = [(stem + end, stem) for stem in stems for end in ("", "s", "sid", "ta")] + [(stem + "ks", rng.choice(stems)) for stem in stems[::40]] + [("s", "s"), ("ta", "minema")]
    table = spark.createDataFrame(forms, "form string, lemma string").coalesce(1)
    known = [tuple(r) for r in known_forms(table).collect()]
    whole = Lemmatiser(known, [(r.suffix, r.cut, r.add, r.place) for r in learn(table).collect()])
    save_model(table, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"), most=len(known) // 2)
    learned = LemmaAnalyzer.learned(table, most=len(known) // 2)
    asked = [f for f, _ in known] + [s + e for s in stems for e in ("sta", "t", "d", "ksid")] + ["q", "^", "sid"]
    for own in (loaded, learned):
        assert [own.model.lemma(f) for f in asked] == [whole.lemma(f) for f in asked]
    assert 0 < len(loaded.model.words) < len(known) // 4


def test_postings_shuffle_texts_once_and_rare_lemmas_alone(spark, tmp_path, monkeypatch):
    texts = [(k, " ".join(["often"] * (k % 3 + 1) + ["also", f"rare{'abcdefghij'[k % 10] * (k // 10 + 1)}"])) for k in range(40)] + [(7, "twice often"), (50, None)]
    rows = spark.createDataFrame(texts, "speech_id long, text string")
    found = index.postings(rows, SimpleAnalyzer())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(speech_id") == 1 and "Exchange hashpartitioning(speech_id#" in plan and "lemma" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
    want = sorted(tuple(r) for r in found.collect())
    assert (7, "often", 3) in want
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 5)
    own = segments.SegmentIndex(spark, str(tmp_path / "own"), "growth_segments", buckets=4)
    own.add(rows.where("speech_id % 2 = 0"), SimpleAnalyzer())
    own.add(rows.where("speech_id % 2 = 1"), SimpleAnalyzer())
    assert sorted(tuple(r) for r in own.postings().collect()) == want
    spark.sql("drop table growth_segments")
    table = spark.createDataFrame([(lemma, k) for k, lemma in enumerate(sorted({w for _, w, _ in want}))], "lemma string, id long")
    joined, held = segments.by_table(found, table, "lemma")
    assert sorted((r.speech_id, r.lemma, r["count"]) for r in joined.collect()) == want and len(held) == 1
    # the frequent lemmas do not go through the shuffle
    assert {r.lemma for r in held[0].where("_tier >= 4").collect()} == {"often", "also"}


def test_lines_of_one_file_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("'2024-01-08' as date", "'1500' as time", "'one' as source_file", "'u' as source_url", "'s' as speaker", "concat(sha2(cast(id as string), 512), sha2(cast(-id as string), 512)) as text")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        files.write_speeches(rows.repartition(8), str(tmp_path / "lines"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    back = files.read_speeches(spark, str(tmp_path / "lines"))
    assert len(back.inputFiles()) > 3 and back.select("text").distinct().count() == 4000


def test_a_dictionary_that_is_not_small_to_spark_moves_no_postings(spark):
    texts = [(k, f"pours often {'often ' * (k % 3)}this pours pour cats the") for k in range(30)] + [(90, "dogs"), (91, None)]
    rows = spark.createDataFrame(texts, "speech_id long, text string")
    forms = spark.createDataFrame([("pours", "pour"), ("pours", "pouring"), ("cats", "cat"), ("this", "these"), ("dogs", "dog")], "form string, lemma string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.postings(rows, DictionaryAnalyzer(forms))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(speech_id") == 1 and "SortMergeJoin" not in plan
        want = sorted(tuple(r) for r in found.collect())
        some = index.postings_of(rows, DictionaryAnalyzer(forms), ["pour", "these", "this", "often", "pours"])
        assert "SortMergeJoin" not in some._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in some.collect()) == [r for r in want if r[1] in ("pour", "these", "often")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (0, "pour", 3) in want and (90, "dog", 1) in want and not {"this", "pours"} & {r[1] for r in want}


def test_tasks_of_postings_have_texts_of_one_size(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "word " * 100) for k in range(100)], "speech_id long, text string")
    monkeypatch.setattr(index, "PART_BYTES", 5_000)
    found = index.postings(rows, SimpleAnalyzer())
    assert found.rdd.getNumPartitions() == 10 and found.count() == 100
    # what is known is looked for without sorting texts, few ids or many
    for most, join in ((100, "BroadcastHashJoin"), (1, "ShuffledHashJoin")):
        monkeypatch.setattr(index, "BROADCAST_ROWS", most)
        left = index.missing(rows, found.where("speech_id < 90"))
        assert join in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.speech_id for r in left.collect()) == list(range(90, 100))


def test_texts_on_the_way_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "id long, text string")
    store = Store(spark, str(tmp_path / "store"))
    for back in (cut(rows, "texts", TEXTS), store.read_staged(ROWS, store.stage(ROWS, rows), "id long, text string").drop("part")):
        assert all(f.endswith(".zstd.parquet") for f in back.inputFiles())
        assert sorted(map(tuple, back.collect())) == [(k, f"text {k}") for k in range(50)]
