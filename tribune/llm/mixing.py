"""Mixing sources to target weights by Poisson replication.

Every source s has a target share w(s) of the mixture. With S(s) its size and T the size of
all sources, a document of s is to be seen rate(s) = epochs * w(s) * T / S(s) times on average.
How often it is really seen is a Poisson variate with that mean, got by inverting the
distribution at a number in (0, 1) hashed from the document's id and the seed. So each
document decides alone, whatever the partitions, and a rerun or a lost executor changes nothing.

A rate beyond 200 is split: sums of Poisson variates are Poisson variates, and each part is inverted at a number of its own.

Defined cases: a null source is a source of its own; sizes that are null, negative or 0 are taken from the length of the text; a source
without any text has rate 0, so its documents do not appear; shares of sources that are absent, and what sources without a target leave, go to the others in
proportion; rows that share a doc_id get the same number of copies; an empty table gives an empty table; a column of the input named `replica`
is replaced. Text is else never read for the decision and passes whole, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut

#: Rates beyond are split into parts of at most this mean.
MOST_RATE = 200.0
#: With at most so many sources their rates are broadcast (under 40 MB); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"
#: Shares of the sources of the test data: the first one 0.2, the other nineteen falling in equal steps; sources not named here have 0.05 together.
TARGETS = {"src0": 0.2} | {f"src{k}": 0.75 * (20 - k) / 190 for k in range(1, 20)}


def uniform(ident: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of MD5."""
    digits = F.substring(F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str, float], size: str = "n_chars", epochs: float = 1.0) -> DataFrame:
    """One row per source: source, size, share, rate. Sources without a target divide what targets leave of 1 in proportion
    to size; what then is nobody's, as sources are absent, is divided in proportion to the shares."""
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares must not be negative nor exceed 1 together")
    told = F.col(size).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(F.when(told > 0, told).otherwise(F.length(F.coalesce("text", F.lit(""))).cast("long"))).alias("size"))
    given = F.lit(None).cast("double")
    for name, share in targets.items():
        given = F.when(F.col("source") == name, F.lit(float(share))).otherwise(given)
    marked = sizes.withColumn("given", given)
    other = F.col("given").isNull()
    held = marked.where("size > 0")
    totals = held.agg(F.sum("size").alias("total"), F.sum(F.when(other, F.col("size"))).alias("others"), F.sum("given").alias("told"))
    left = max(0.0, 1.0 - float(sum(targets.values())))
    all_shares = F.coalesce("told", F.lit(0.0)) + F.when(F.col("others") > 0, left).otherwise(0.0)
    share = F.when(all_shares > 0, F.coalesce("given", F.lit(left) * F.col("size") / F.col("others")) / all_shares)
    return (
        marked.join(F.broadcast(totals))  # totals is one row
        .withColumn("share", share)
        .withColumn("rate", F.when(F.col("size") > 0, F.lit(float(epochs)) * F.coalesce("share", F.lit(0.0)) * F.col("total") / F.col("size")).otherwise(0.0))
        .select("source", "size", "share", "rate")
    )


def _cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far beyond the mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def _count(cdf: Column, u: Column) -> Column:
    """How many values of a distribution lie below u."""

    def below(acc: Column, c: Column) -> Column:
        # the document's number is the start value, not a column named inside: a filter put on the result is then pushed down rightly
        return F.struct(acc["u"].alias("u"), (acc["n"] + F.when(c < acc["u"], 1).otherwise(0)).alias("n"))

    return F.aggregate(cdf, F.struct(u.alias("u"), F.lit(0).alias("n")), below, lambda acc: acc["n"])


def mix_sources(docs: DataFrame, targets: dict[str, float], seed: str = SEED, size: str = "n_chars", epochs: float = 1.0) -> DataFrame:
    """docs with each row repeated by its Poisson count, in a global random order, and `replica` (from 1).

    The rows are dealt by a hash of (id, replica) and sorted by it within partitions: partition after
    partition this is a random order, and no source or group of copies lands in one partition.
    """
    docs = docs.drop("replica")
    found = rates(docs, targets, size, epochs).withColumn("parts", F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int"))
    table = cut(found.select(F.col("source").alias("_mix_source"), F.col("parts").alias("_mix_parts"), _cumulative(F.col("rate") / F.col("parts")).alias("_mix_cdf")), "rates")
    table = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # a number for each part; the first is that of a rate that is not split
    names = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), lambda j: F.when(j == 1, "").otherwise(F.concat(F.lit("/"), j.cast("string"))))
    made = docs.join(table, docs["source"].eqNullSafe(table["_mix_source"])).withColumn("_mix_u", uniform(ident, seed))
    once = _count(F.col("_mix_cdf"), F.col("_mix_u"))
    parted = F.aggregate(
        names,
        F.struct(ident.alias("id"), F.col("_mix_cdf").alias("cdf"), F.lit(0).alias("n")),
        lambda acc, name: F.struct(acc["id"].alias("id"), acc["cdf"].alias("cdf"), (acc["n"] + _count(acc["cdf"], uniform(F.concat(acc["id"], name), seed))).alias("n")),
        lambda acc: acc["n"],
    )
    return (
        made.withColumn("_mix_n", F.when(F.col("_mix_parts") == 1, once).otherwise(parted))
        .where("_mix_n > 0")
        .withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
        .withColumn("_mix_key", F.xxhash64("doc_id", "replica", F.lit(seed)))
        .drop("_mix_source", "_mix_cdf", "_mix_n", "_mix_parts", "_mix_u")
        .repartition("_mix_key")
        .sortWithinPartitions("_mix_key")
        .drop("_mix_key")
    )
