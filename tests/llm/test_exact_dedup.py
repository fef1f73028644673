import pytest
from pyspark.sql import functions as F

from tribune.llm import exact_dedup as x

ROWS = [(1, "a b", "p"), (2, "ab", "q"), (3, None, "r"), (4, " \x0b", "s"), (None, "ab", "t"), (5, "zz", "u"), (5, "zz", "u"), (6, "q", None), (7, "y" * 300_000, "v"), (8, "y" * 300_000, "w"), (9, "A B", "x")]


def expected(rows):
    norm = lambda t: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
    out = []
    for i, t, _ in rows:
        group = [(-len(u or ""), k is None, k or 0) for k, u, _ in rows if norm(u) == norm(t)]
        best = min(group)
        out.append((i, None if best[1] else best[2], len(group)))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [x.sha256, lambda c: F.substring(x.sha256(c), 1, 1), lambda c: F.lit("one")])
def test_groups_also_when_digests_collide(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    got = x.dedup(docs, digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_filter_keeps_columns_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    kept = x.filter_kept(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 4, 5, 5, 6, 7, 9]
    assert x.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("digest", [x.sha256, lambda c: F.substring(x.sha256(c), 1, 1)])
def test_later_runs_go_on_with_the_state(spark, tmp_path, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    state, seen = str(tmp_path / "state"), []
    for part in ("doc_id in (2, 5, 9)", "doc_id in (1, 6, 8)", "doc_id in (3, 4, 7) or doc_id is null"):
        now = docs.where(part)
        seen += [tuple(r) for r in now.collect()]
        own = {r.doc_id for r in now.collect()}
        got = x.dedup(now, digest=digest, state=state).collect()
        # the rows of this run, as one run over all that has come so far would judge them
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == [e for e in expected(seen) if e[0] in own]
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_a_hot_digest_is_dealt_over_keys(spark, monkeypatch):
    monkeypatch.setattr(x, "HITS_A_KEY", 3)
    rows = [(k, "same" if k < 40 else f"other {k % 3}", "") for k in range(50)]
    for digest in (x.sha256, lambda c: F.lit("one")):
        got = x.dedup(spark.createDataFrame(rows, "doc_id long, text string, kept string"), digest=digest).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected(rows)


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["contents", "landing", "absorb", "result"])
def test_a_lost_run_is_given_again(spark, tmp_path, monkeypatch, step):
    """Wherever a run was lost, the same run again counts its rows once, and what comes later is judged rightly."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    first, second = docs.where("doc_id in (2, 5, 9)"), docs.where("doc_id in (1, 6, 8) or doc_id is null")
    state = str(tmp_path / "state")
    x.dedup(first, state=state, run="2024").collect()

    def lost(*args):
        raise Lost

    with monkeypatch.context() as m:
        if step == "absorb":
            m.setattr(x, "absorb", lost)
        elif step == "result":
            m.setattr(x, "differing", lost)
        else:
            real = x.land
            m.setattr(x, "land", lambda rows, folder, *by: lost() if (step == "contents") == ("/contents/" in folder) else real(rows, folder, *by))
        with pytest.raises(Lost):
            x.dedup(second, state=state, run="2025").collect()
    for _ in range(2):
        got = x.dedup(second, state=state, run="2025").collect()
        seen = [tuple(r) for r in first.collect() + second.collect()]
        own = [r.doc_id for r in second.collect()]
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == [e for e in expected(seen) if e[0] in own]
    third = x.dedup(docs.where("doc_id = 4"), state=state, run="2026").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in third] == [(4, 4, 1)]


def test_only_texts_of_hits_are_read(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    x.dedup(make([(k, f"old text {k}") for k in range(300)]), state=state, run="a").collect()
    x.dedup(make([(k, f"other text {k}") for k in range(300, 600)]), state=state, run="b").collect()
    read, seen = [], x.cut

    def watched(df, what):
        if what == "differing":
            plan = df._jdf.queryExecution().executedPlan().toString()
            read.append([line for line in plan.split("\n") if "full" in line and "FileScan" in line])
        return seen(df, what)

    monkeypatch.setattr(x, "cut", watched)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    got = x.dedup(make([(900, "old text 7"), (901, "quite new")]), state=state, run="c").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(900, 7, 2), (901, 901, 1)}
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    (lines,) = read
    filters = [line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in lines]
    assert filters and all("run#" in f and "bucket#" in f for f in filters), filters


def test_state_is_committed_in_few_files(spark, tmp_path):
    """A partition's commit writes its changes as one file, and the session's settings are as before."""
    names = [*x._STATE_CONF, "spark.sql.streaming.checkpointFileManagerClass"]
    before = [spark.conf.get(k, None) for k in names]
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "doc_id long, text string")
    assert x.dedup(docs, state=str(tmp_path / "state")).where("kept").count() == 7
    files = [f.suffix for f in (tmp_path / "state/checkpoint/state/0").glob("[0-9]*/*") if f.is_file() and not f.name.startswith(".")]
    assert ".changelog" in files and not set(files) - {".changelog", ".crc"}
    assert [spark.conf.get(k, None) for k in names] == before
