from datetime import date, timedelta

from pyspark.sql import functions as F

from tribune.functions import dates, numbers, text


def column(spark, values, kind, make):
    df = spark.createDataFrame([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in enumerate(values)], f"k int, {kind}")
    return [r[0] for r in df.orderBy("k").select(make(df)).collect()]


def test_week_as_strftime(spark):
    days = [(date(2015, 1, 1) + timedelta(k)).isoformat() for k in range(0, 15 * 365)]
    assert column(spark, days, "d string", lambda d: dates.week(d.d)) == [date.fromisoformat(d).strftime("%Y-%W") for d in days]
    assert column(spark, ["2023-01-01", "x", None], "d string", lambda d: dates.week(d.d)) == ["2023-00", None, None]


def test_labels(spark):
    rows = [("2024-01-08", "1500"), ("2024-01-08", "15:00:00"), ("2024-01-08", "9"), ("", "1500"), (None, "1"), ("2024-01", "1500"), ("2024-01-08", "")]
    assert column(spark, rows, "d string, t string", lambda d: dates.label(d.d, d.t)) == [
        "8. jaanuar 2024 kell 15:00", "8. jaanuar 2024 kell 15:00", "8. jaanuar 2024 kell 9", "", "", "2024-01 kell 15:00", "8. jaanuar 2024",
    ]


def test_links(spark):
    links = ["https://s.example/202401081500", "https://s.example/about", "", "123", None]
    assert column(spark, links, "l string", lambda d: dates.session_time(F.coalesce(d.l, F.lit("")))) == ["1500", "0000", "0000", "0000", "0000"]
    moments = ["2024-01-08T23:59:00.000+00:00", "2024-02-30T00:00", "x", None, "2024-01-08"]
    assert column(spark, moments, "m string", lambda d: dates.date_of(d.m)) == ["2024-01-08", None, None, None, "2024-01-08"]


def test_month_chunks(spark):
    d = date.fromisoformat
    got = column(spark, [(d("2019-04-04"), d("2019-06-10")), (d("2020-01-02"), d("2020-01-01")), (d("2020-02-29"), d("2020-02-29"))], "a date, b date", lambda x: dates.month_chunks(x.a, x.b))
    assert [[(str(c.start), str(c.end)) for c in g] for g in got] == [
        [("2019-04-04", "2019-04-30"), ("2019-05-01", "2019-05-31"), ("2019-06-01", "2019-06-10")], [], [("2020-02-29", "2020-02-29")],
    ]


def test_look_back(spark):
    now = date(2024, 3, 1)
    got = column(spark, [(True, now), (False, now)], "b boolean, d date", lambda x: dates.look_back(x.b, x.d))
    assert [str(g) for g in got] == ["2024-02-16", "2019-04-04"]


def test_until(spark):
    now = date(2024, 3, 1)
    got = column(spark, [("2024-01-02", now), ("", now), (None, now)], "s string, d date", lambda x: dates.until(x.s, x.d))
    assert [str(g) for g in got] == ["2024-01-02", "2024-03-01", "2024-03-01"]


def test_split_speaker(spark):
    rows = {
        "Peaminister Kaja Kallas": ("Kaja Kallas", "Peaminister"),
        "Riigikogu esimees Lauri Hussar": ("Lauri Hussar", "Riigikogu esimees"),
        "Kaja Kallas": ("Kaja Kallas", None),
        "Esimees": ("Esimees", None),
        "kaja kallas": ("kaja kallas", None),
        "Jaan van Tamm": ("Tamm", "Jaan van"),
        "Aseesimees  Jüri Ratas": ("Jüri Ratas", "Aseesimees"),
        " Esimees ": (" Esimees ", None),
        "Rahandusminister Mart Võrklaev ": ("Mart Võrklaev", "Rahandusminister"),
        "": ("", None),
    }
    df = spark.createDataFrame([(k,) for k in rows], "raw string")
    name, role = text.split_speaker(df.raw)
    assert {r.raw: (r.n, r.r) for r in df.select("raw", name.alias("n"), role.alias("r")).collect()} == rows


def test_names_and_bands(spark):
    assert column(spark, [(" A ", "B "), ("", "B"), (None, None)], "a string, b string", lambda d: text.full_name(d.a, d.b)) == ["A B", "B", ""]
    shares = [(1, 16), (5, 16), (2, 3), (0, 7), (7, 7), (9, 10)]
    assert column(spark, shares, "a long, b long", lambda d: numbers.percentage(d.a, d.b)) == [6.2, 31.2, 66.7, 0.0, 100.0, 90.0]
    pairs = [(k, n) for n in range(1, 200) for k in range(0, n + 1, 3)]
    assert column(spark, pairs, "a long, b long", lambda d: numbers.percentage(d.a, d.b)) == [round(k / n * 100, 1) for k, n in pairs]
    assert column(spark, [90.0, 89.9, 70.0, 69.9], "p double", lambda d: numbers.band(d.p)) == ["green", "amber", "amber", "red"]
    assert column(spark, ["x" * 400, "y"], "t string", lambda d: text.snippet(d.t)) == ["x" * 350 + "...", "y..."]


def test_strip_takes_spaces_of_any_kind(spark):
    from tribune.functions import text

    got = spark.createDataFrame([("\u00a0 Esimees A\u3000",)], "t string").select(text.strip(F.col("t")).alias("t")).first().t
    assert got == "Esimees A"


def test_all_ties_up_to_20000(spark):
    """Every share whose tenths could be a tie (20 * 100 * k / n a whole odd number), and its neighbours, rounds as Python does."""
    from pyspark.sql import functions as F

    n = spark.range(1, 20_001).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(1999), F.lit(2))).alias("odd"))
    ties = n.where("(odd * n) % 2000 = 0").select("n", (F.col("odd") * F.col("n") / 2000).cast("long").alias("k"))
    near = ties.select("n", F.explode(F.array("k", F.col("k") + 1, F.col("k") - 1)).alias("k")).where("k between 0 and n").distinct()
    got = near.select("n", "k", numbers.percentage(F.col("k"), F.col("n")).alias("p")).toPandas()
    assert len(got) > 100_000
    wrong = [(n, k, p) for n, k, p in zip(got.n, got.k, got.p) if p != round(k / n * 100, 1)]
    assert not wrong, wrong[:5]
