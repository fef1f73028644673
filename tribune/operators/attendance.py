"""Presence of members at roll calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import band, percentage

PRESENT = "KOHAL"
SORTABLE = ("member_name", "total_sessions", "present_sessions", "attendance_percentage")


def stats(attendance: DataFrame) -> DataFrame:
    """Per member: sessions, sessions present and their share, best first."""
    counted = attendance.groupBy("member_name").agg(F.count("*").alias("total_sessions"), F.count_if(F.col("status") == PRESENT).alias("present_sessions"))
    shared = counted.withColumn("attendance_percentage", percentage(F.col("present_sessions"), F.col("total_sessions")))
    return sort(shared, "attendance_percentage")


def sort(rows: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """Any of the four columns, either way; then more sessions first, then by name."""
    if by not in SORTABLE:
        raise ValueError(f"not sortable: {by}")
    return rows.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), F.desc("total_sessions"), "member_name")


def banded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("band", band(F.col("attendance_percentage")))
