"""Interest windows and tick rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowline.functions.staging import once
from stowline.functions.times import parse_instant, parse_millisecond

RIC_POSITION, START_POSITION, END_POSITION = 2, 5, 6
START_NAME, END_NAME = "Execution_Start_Time", "Execution_End_Time"


def _clean_ric(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit('"'), F.lit(""))


def file_order() -> Column:
    """Place of a row of files just read: file path, start of the block in it, position in the block."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("position"))


def raw_interest(rows: DataFrame, ric: str, start: str, end: str, key: Column | None = None) -> DataFrame:
    """(row_key, ric, start_text, end_text) of all rows: dates are read from rows without a symbol too.

    Without a key column the rows come from files, and `row_key` follows the files by path and the rows in them.
    """
    return rows.select(
        (file_order() if key is None else key).alias("row_key"),
        _clean_ric(F.col(ric)).alias("ric"),
        F.trim(F.col(start)).alias("start_text"),
        F.trim(F.col(end)).alias("end_text"),
    )


def _with_symbol(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("ric").isNotNull() & (F.col("ric") != ""))


def read_raw_interest(spark: SparkSession, path: str) -> DataFrame:
    """By position: third column the symbol, sixth and seventh the window's ends."""
    rows = spark.read.csv(path, header=True)
    ric, start, end = (f"`{rows.columns[at]}`" for at in (RIC_POSITION, START_POSITION, END_POSITION))
    return raw_interest(rows, ric, start, end)


def read_named_interest(spark: SparkSession, path: str) -> DataFrame:
    """By column name."""
    return raw_interest(spark.read.csv(path, header=True), "RIC", START_NAME, END_NAME)


def parsed(raw: DataFrame) -> DataFrame:
    return once(raw, start=parse_instant(F.col("start_text")), end=parse_instant(F.col("end_text")))


def interest_windows(raw: DataFrame) -> DataFrame:
    """Rows with a symbol and two readable ends."""
    ready = parsed(_with_symbol(raw)).filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    return ready.select("row_key", "ric", "start", "end")


def rejected_interest(raw: DataFrame) -> DataFrame:
    """Rows that `interest_windows` leaves out because an end is unreadable."""
    bad = parsed(_with_symbol(raw)).filter(F.col("start").isNull() | F.col("end").isNull())
    return bad.select("row_key", "ric", "start_text", "end_text")


def with_tick_time(rows: DataFrame, date: str = "date_column", time: str = "time_column") -> DataFrame:
    return once(rows, ts=parse_millisecond(F.col(date), F.col(time)))


def read_ticks(spark: SparkSession, path: str, date: str = "date_column", time: str = "time_column") -> DataFrame:
    """Header CSV, all text, plus `ts`."""
    return with_tick_time(spark.read.csv(path, header=True), date, time)
