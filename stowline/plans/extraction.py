"""Requests for the tick store, and the filter of what it returns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from stowline.fixed_values import (
    DAY_MINUTES,
    DAY_SYMBOLS,
    KEY_GROUP_SYMBOLS,
    KEY_MINUTES,
    KEY_SYMBOLS_PER_REQUEST,
    SLOT_MINUTES,
    SLOT_SYMBOLS,
    WINDOW_MAX_MINUTES,
    WINDOW_MAX_ROWS,
)
from stowline.functions.requests import request_text, templated_request
from stowline.functions.times import parse_day
from stowline.operators.grid import day_slots, day_start, interval_minutes, slot_end, symbol_batches
from stowline.operators.intervals import SLICE_SECONDS, drop_repeats, ticks_in_windows
from stowline.operators.numbering import number_rows
from stowline.operators.packing import pack_windows

BY_SYMBOL = ["first_ric", "start"]
BY_START = ["start", "first_ric"]
DAYS_PER_STRETCH = 1_024


def window_requests(
    windows: DataFrame,
    order: list[str] | None = None,
    max_minutes: float = WINDOW_MAX_MINUTES,
    max_rows: int = WINDOW_MAX_ROWS,
    key: str = "row_key",
    **options,
) -> DataFrame:
    """Packed windows with their request text and `position`, ordered by first symbol (default) or by start.

    Positions count from 0 through the whole result; they are numbered within range partitions.
    """
    batches = pack_windows(windows, key, max_minutes, max_rows, **options)
    request = request_text(F.col("start"), F.col("end"), F.col("syms"))
    numbered = number_rows(batches.withColumn("request", request), [*(order or BY_SYMBOL), "first_row"], "position")
    return numbered.orderBy("position")


def first_day(raw: DataFrame) -> DataFrame:
    """One row: the day of the first row, in file order, that has a start day."""
    rows = raw.select("row_key", parse_day(F.col("start_text")).alias("day")).filter(F.col("day").isNotNull())
    return rows.agg(F.min_by("day", "row_key").alias("day"))


def interest_range(raw: DataFrame) -> DataFrame:
    """One row: earliest start day and latest end day (the start day when no end is readable)."""
    start, end = parse_day(F.col("start_text")), parse_day(F.col("end_text"))
    return raw.agg(F.min(start).alias("start_day"), F.max(end).alias("_end")).select(
        "start_day", F.coalesce("_end", "start_day").alias("end_day")
    )


def slot_requests(raw: DataFrame, minutes: int | None = None, symbols_per_request: int = SLOT_SYMBOLS) -> DataFrame:
    """Every symbol batch for every slot of the first day."""
    step = interval_minutes(minutes, SLOT_MINUTES)
    batches = symbol_batches(raw, symbols_per_request)
    slots = day_slots(batches, first_day(raw).scalar(), step)
    slots = slots.filter(F.col("start").isNotNull())  # no readable day, no request
    return slots.withColumn("request", request_text(F.col("start"), F.col("end"), F.col("syms")))


def _days_between(batches: DataFrame) -> DataFrame:
    """(batch_id, syms, day_no, day) for every day from `_first` to `_last`; none when `_last` comes first.

    Days come in stretches that are dealt over the cluster before they are opened, so neither array of a row is longer
    than a few thousand elements, up to the year 9999.
    """
    last_stretch = F.floor(F.date_diff("_last", "_first") / DAYS_PER_STRETCH).cast("int")
    stretches = F.when(last_stretch >= 0, F.sequence(F.lit(0), last_stretch))
    dealt = batches.select("*", F.explode(stretches).alias("_stretch")).repartition("batch_id", "_stretch")
    begin = F.col("_stretch") * DAYS_PER_STRETCH
    end = F.least(begin + DAYS_PER_STRETCH - 1, F.date_diff("_last", "_first"))
    numbered = dealt.select("batch_id", "syms", "_first", F.explode(F.sequence(begin, end)).alias("day_no"))
    return numbered.select("batch_id", "syms", "day_no", F.date_add("_first", F.col("day_no")).alias("day"))


def _day_batches(raw: DataFrame, minutes: int, symbols_per_request: int, all_days: bool) -> DataFrame:
    ends = interest_range(raw)
    first, last = ends.select("start_day").scalar(), ends.select("end_day").scalar()
    batches = symbol_batches(raw, symbols_per_request).withColumn("_first", first).withColumn("_last", last)
    if all_days:
        days = _days_between(batches)
    else:
        days = batches.select("batch_id", "syms", F.posexplode(F.array("_first", "_last")).alias("day_no", "day"))
    start = day_start(F.col("day"))
    return (
        days.filter(F.col("day").isNotNull())  # no readable day, no request
        .withColumn("start", start)
        .withColumn("end", slot_end(F.col("start"), minutes))
    )


def endpoint_day_requests(
    raw: DataFrame,
    minutes: int | None = None,
    symbols_per_request: int = DAY_SYMBOLS,
    all_days: bool = False,
) -> DataFrame:
    """Every symbol batch for the first and the last day, both even when equal; `all_days` fills between, each day once."""
    rows = _day_batches(raw, interval_minutes(minutes, DAY_MINUTES), symbols_per_request, all_days)
    return rows.withColumn("request", request_text(F.col("start"), F.col("end"), F.col("syms")))


def templated_requests(raw: DataFrame, settings: Mapping[str, str], all_days: bool = False) -> DataFrame:
    """As `endpoint_day_requests`, with the text, batch size and length from the settings."""
    grouped = settings[KEY_GROUP_SYMBOLS].upper() == "Y"
    size = int(settings[KEY_SYMBOLS_PER_REQUEST]) if grouped else 1
    rows = _day_batches(raw, int(settings[KEY_MINUTES]), size, all_days)
    return rows.withColumn("request", templated_request(F.col("start"), F.col("end"), F.col("syms"), settings))


def filter_ticks(ticks: DataFrame, windows: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Distinct ticks inside a window of their symbol.

    Copies pass or fail the windows together, so the filter runs first and only what is
    left is made distinct.
    """
    return drop_repeats(ticks_in_windows(ticks, windows, slice_seconds))
