"""Columns for dates that are kept as text (yyyy-MM-dd) and times kept as HHmm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that polling looks back, and the first day of all: fixed values.
LOOK_BACK, FIRST_DAY = 14, "2019-04-04"
#: Names of the months in Estonian, fixed values.
MONTHS = ["jaanuar", "veebruar", "märts", "aprill", "mai", "juuni", "juuli", "august", "september", "oktoober", "november", "detsember"]


def day(date: Column) -> Column:
    """A date, or null where the text is none."""
    return F.try_to_date(date, "yyyy-MM-dd")


def month(date: Column) -> Column:
    return F.date_format(day(date), "yyyy-MM")


def week(date: Column) -> Column:
    """Year and week of the year with weeks from Monday; days before the first Monday are in week 00."""
    d = day(date)
    number = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))


def period(date: Column, interval: str) -> tuple[Column, str]:
    """Bucket of a date and its label; an unknown interval counts as weekly."""
    if interval == "daily":
        return date, "date"
    return (month(date), "month") if interval == "monthly" else (week(date), "week")


def date_of(moment: Column) -> Column:
    """Day of an ISO date and time as it is written, without a change of zone; null where it is no date."""
    part = F.split(moment, "T")[0]
    return F.when(day(part).isNotNull(), part)


def session_time(link: Column) -> Column:
    """The last four characters of a link if they are digits, else 0000."""
    return F.when(F.right(link, F.lit(4)).rlike("^[0-9]{4}$"), F.right(link, F.lit(4))).otherwise(F.lit("0000"))


def label(date: Column, time: Column) -> Column:
    """Date and time for readers: `8. jaanuar 2024 kell 15:00`. A time of four digits or with colons becomes hours and
    minutes, any other stays; a date that has not three parts stays as it is."""
    parts = F.split(date, "-")
    number = F.try_to_number(F.get(parts, F.lit(1)), F.lit("99")).cast("int")
    name = F.get(F.array(*map(F.lit, MONTHS)), number - 1)
    long = F.concat(F.try_to_number(F.get(parts, F.lit(2)), F.lit("99")).cast("int").cast("string"), F.lit(". "), name, F.lit(" "), F.get(parts, F.lit(0)))
    shown = F.when(F.coalesce(date, F.lit("")) == "", F.lit("")).when(F.size(parts) == 3, F.coalesce(long, date)).otherwise(date)
    pieces = F.split(time, ":")
    clock = (
        F.when(time.contains(":"), F.concat_ws(":", F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))))
        .when(F.length(time) == 4, F.concat(F.left(time, F.lit(2)), F.lit(":"), F.right(time, F.lit(2))))
        .otherwise(time)
    )
    return F.when((shown == "") | (F.coalesce(time, F.lit("")) == ""), shown).otherwise(F.concat(shown, F.lit(" kell "), clock))


def month_chunks(start: Column, end: Column) -> Column:
    """The months of [start, end] (dates) as an array of (start, end), cut to both ends; empty where start is after end."""
    months = F.when(start <= end, F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")))


def look_back(known: Column, now: Column, first: str = FIRST_DAY, days: int = LOOK_BACK) -> Column:
    """Where polling starts: some days before now when anything is known, else at the first day of all."""
    return F.when(known, F.date_sub(now, days)).otherwise(F.lit(first).cast("date"))


def until(last_processed: Column, today: Column) -> Column:
    """Where polling ends: at the last day that is known to be processed, else today."""
    return F.coalesce(F.nullif(last_processed, F.lit("")).cast("date"), today)
