"""Symbol batches and time slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowline.operators.numbering import number_rows


def interval_minutes(value: int | None, default: int) -> int:
    """A slot length outside 1..1440 falls back to the default."""
    return value if value is not None and 1 <= value <= 1440 else default


def symbols(interest: DataFrame) -> DataFrame:
    return interest.filter(F.col("ric").isNotNull() & (F.col("ric") != "")).select("ric").distinct()


def symbol_batches(interest: DataFrame, size: int) -> DataFrame:
    """(batch_id, syms): the sorted distinct symbols in chunks of `size`."""
    numbered = number_rows(symbols(interest), ["ric"])
    return numbered.groupBy(F.expr(f"row_no div {size}").alias("batch_id")).agg(
        F.array_sort(F.collect_list("ric")).alias("syms")
    )


def day_start(day: Column) -> Column:
    return day.cast("timestamp")


def slot_end(start: Column, minutes: int) -> Column:
    """Last millisecond of a slot."""
    return start + F.expr(f"make_dt_interval(0, 0, {minutes}, 0)") - F.expr("make_dt_interval(0, 0, 0, 0.001)")


def day_slots(df: DataFrame, day: Column, minutes: int) -> DataFrame:
    """Every row once per slot of its day; a last slot that does not fit runs past midnight."""
    offset = F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(minutes))).alias("_minute")
    start = day_start(F.col("_day")) + F.make_dt_interval(mins=F.col("_minute"))
    return (
        df.withColumn("_day", day)
        .select("*", offset)
        .withColumn("start", start)
        .withColumn("end", slot_end(F.col("start"), minutes))
        .drop("_day", "_minute")
    )
