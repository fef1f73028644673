import math

import pytest
from pyspark.sql import functions as F

from tribune.llm import mixing


def frame(spark, n=4000):
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.lit("text").alias("text"),
        F.when(F.col("id") % 3 == 0, "src0").when(F.col("id") % 3 == 1, "b").alias("source"),
        (F.col("id") % 7 + 1).alias("n_chars"),
        F.lit("old").alias("replica"),
    )
    return rows


def test_shares_and_counts(spark):
    docs = frame(spark)
    got = mixing.mix_sources(docs, {"src0": 0.6})
    by = {r.source: r["size"] for r in got.groupBy("source").agg(F.sum("n_chars").alias("size")).collect()}
    total = docs.agg(F.sum("n_chars")).first()[0]
    assert by["src0"] / total == pytest.approx(0.6, abs=0.03)
    assert by["b"] / total == pytest.approx(0.2, abs=0.02) and by[None] / total == pytest.approx(0.2, abs=0.02)
    rates = {r.source: r.rate for r in mixing.rates(docs, {"src0": 0.6}).collect()}
    for source, rate in rates.items():
        u = docs.where(F.col("source").eqNullSafe(F.lit(source))).select("doc_id", mixing.uniform(F.col("doc_id"), mixing.SEED).alias("u"))
        counts = {r.doc_id: r["count"] for r in got.where(F.col("source").eqNullSafe(F.lit(source))).groupBy("doc_id").count().collect()}
        for r in u.collect():
            k, total_p = 0, math.exp(-rate)
            while total_p < r.u:
                k += 1
                total_p += math.exp(-rate) * rate**k / math.factorial(k)
            assert counts.get(r.doc_id, 0) == k
    assert all(r.a == 1 and r.n == r.b for r in got.groupBy("doc_id").agg(F.min("replica").alias("a"), F.max("replica").alias("b"), F.count("*").alias("n")).collect())


def test_order_is_mixed_and_repeatable(spark):
    docs = frame(spark)
    a, b = ([r.doc_id for r in mixing.mix_sources(d, {"src0": 0.6}).collect()] for d in (docs, docs.repartition(7)))
    assert sorted(a) == sorted(b) and a != sorted(a)
    other = [r.doc_id for r in mixing.mix_sources(docs, {"src0": 0.6}, seed="other").collect()]
    assert sorted(other) != sorted(a)


def test_odd_rows(spark):
    rows = [(1, "x", "src0", None), (1, "x", "src0", None), (None, None, "b", 5), (None, None, "b", 5), (2, "", "c", 0), (3, "y", "c", -4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix_sources(docs, {"src0": 0.2}, epochs=4)
    assert got.columns == [*docs.columns, "replica"]
    assert {r.source for r in got.collect()} <= {"src0", "b", "c"}
    sizes = {r.source: r["size"] for r in mixing.rates(docs, {"src0": 0.2}).collect()}
    assert sizes == {"src0": 2, "b": 10, "c": 1}
    assert mixing.mix_sources(docs.limit(0), {"src0": 0.2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 0.7, "b": 0.7})


def test_high_rates_are_split(spark):
    docs = spark.createDataFrame([(k, "x", "rare" if k < 20 else "rest", 1) for k in range(20_000)], "doc_id long, text string, source string, n_chars long")
    rate = {r.source: r.rate for r in mixing.rates(docs, {"rare": 0.9}).collect()}["rare"]
    assert rate == pytest.approx(900)
    counts = {r.doc_id: r["count"] for r in mixing.mix_sources(docs, {"rare": 0.9}).where("source = 'rare'").groupBy("doc_id").count().collect()}
    assert len(counts) == 20 and abs(sum(counts.values()) / 20 - rate) < 4 * math.sqrt(rate / 20)
    parts = math.ceil(rate / mixing.MOST_RATE)

    def drawn(doc, j):
        import hashlib

        u = (int(hashlib.md5(f"{doc}{'' if j == 1 else f'/{j}'}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, term = 0, math.exp(-rate / parts)
        total = term
        while total < u:
            k += 1
            term *= rate / parts / k
            total += term
        return k

    assert counts == {d: sum(drawn(d, j) for j in range(1, parts + 1)) for d in range(20)}
