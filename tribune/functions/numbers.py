"""Columns for shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Binary places that are looked at behind the point: all of a double's from 1/64 on, and ten times as much stays within 64 bits.
_PLACES = 58


def tenths(x: Column) -> Column:
    """A double from 0 to about 1e14 rounded to one decimal by its exact binary value, ties to even.

    The part behind the point is a whole number of 2^-58, so that tenths and what is left of them are found in whole numbers (below 1/64 it
    may lose bits, far from any tie).
    """
    whole = F.floor(x)
    part = ((x - whole) * float(2**_PLACES)).cast("long") * 10
    t = F.shiftright(part, _PLACES)
    rest = part - F.shiftleft(t, _PLACES)
    half, n = F.lit(2 ** (_PLACES - 1)), whole * 10 + t
    up = (rest > half) | ((rest == half) & (n % 2 == 1))
    return (n + F.when(up, 1).otherwise(0)) / F.lit(10.0)


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal: the double's exact value, ties to even."""
    return tenths(part / whole * 100)


def band(percent: Column) -> Column:
    return F.when(percent >= 90, "green").when(percent >= 70, "amber").otherwise("red")
