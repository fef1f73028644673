"""Columns for names, links and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of titles that end the name in front of which they stand, fixed values.
_TITLES = "minister|esimees"
_WORD = rf"(?![^ ]*(?i:{_TITLES}))\p{{Lu}}[^ ]*"
_NAME = rf"(?:^| )({_WORD}(?: {_WORD})*)$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_speaker(raw: Column) -> tuple[Column, Column]:
    """Name and role: the name is the longest run of capitalised words at the end none of which holds a title; what stands
    before it is the role. A single word, or no such run, is a name as it stands."""
    text = strip(raw)
    name = F.regexp_extract(text, _NAME, 1)
    front = strip(F.substring(text, F.lit(1), F.length(text) - F.length(name)))
    split = (name != "") & text.contains(" ")
    return F.when(split, name).otherwise(raw), F.when(split & (front != ""), front)


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit("")) for x in (first, last)))


def source_file(date: Column, time: Column) -> Column:
    return F.concat(date, F.lit("_"), time, F.lit(".api"))


def uid(link: Column, date: Column) -> Column:
    """What identifies a sitting: its link, or its date where it has none."""
    return F.coalesce(F.nullif(link, F.lit("")), date)


def snippet(text: Column, size: int = 350) -> Column:
    return F.concat(F.left(text, F.lit(size)), F.lit("..."))
