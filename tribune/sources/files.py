"""Speech files (JSON lines by year), ledgers of what is processed, and faction maps, on any filesystem Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day
from ..schemas import FACTION_HISTORY, SPEECH_LINES


def read_speeches(spark: SparkSession, path: str, strict: bool = False, year: int | None = None) -> DataFrame:
    """Lines of the *.jsonl files (or year=... folders) under path. strict fails at a line that is not JSON; else it is kept in _corrupt_record. A
    year that is missing has no lines."""
    schema = SPEECH_LINES if strict else f"{SPEECH_LINES}, _corrupt_record string"
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("recursiveFileLookup", "false")
    if year is not None:
        return read_or_empty(spark, f"{path}/year={year}", schema, reader)
    return reader.option("pathGlobFilter", "*.json*").json(path)


def by_year(speeches: DataFrame) -> DataFrame:
    """Lines with the year of their date, dealt so that those of a year go to a few files, not to one from every task. A year of many lines is split by
    their size, whatever files they come from, so that no task has all of it."""
    return speeches.withColumn("year", F.year(day(F.col("date")))).hint("rebalance", "year")


def write_speeches(speeches: DataFrame, path: str) -> None:
    """Append lines to the folder of their year."""
    by_year(speeches).write.mode("append").partitionBy("year").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, reader: DataFrameReader | None = None) -> DataFrame:
    """JSON at path; an empty table where there is nothing."""
    try:
        return (reader or spark.read.schema(schema)).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, FACTION_HISTORY)


def write_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The uids that are processed."""
    return read_or_empty(spark, path, "uid string")


def append_ledger(uids: DataFrame, path: str) -> None:
    uids.select("uid").distinct().write.mode("append").json(path)
