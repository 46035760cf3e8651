"""Greedy packing of windows into batches bounded by span and row count, in parallel and exact."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stowline.fixed_values import WINDOW_MAX_MINUTES, WINDOW_MAX_ROWS
from stowline.operators.numbering import number_rows

# worker functions travel by value, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 16_384
BLOCKS_PER_CHAIN = 1_024


def _next_opener(start: np.ndarray, end: np.ndarray, span: int, max_rows: int) -> np.ndarray:
    """For each row as a batch's first row: the index of the row that opens the next batch.

    `longest[k]` holds the latest end of 2^k rows from each row on; the steps of a binary search over them find the
    first row whose end lies beyond the span, whatever `max_rows` is.
    """
    count = len(start)
    at = np.arange(count)
    if not count:
        return at
    longest = [end]
    while 2 ** len(longest) <= min(max_rows, count):
        half = 2 ** (len(longest) - 1)
        longest.append(np.maximum(longest[-1][:-half], longest[-1][half:]))
    latest, found = start + span, at.copy()
    for power in reversed(range(len(longest))):
        table = longest[power]
        within = (found < len(table)) & (table[np.minimum(found, len(table) - 1)] <= latest)
        found[within] += 2**power
    return np.minimum(np.maximum(found, at + 1), np.minimum(at + max_rows, count))


# an exit table: where pieces begin, the exit there, and whether exits stay (0) or grow by one with each entry (1)
_TABLE = "block bigint, begins array<int>, exits array<int>, slopes array<int>"


def _pieces(exits: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Exits of neighbouring entries mostly meet or keep their distance, so few pieces hold them all."""
    step = np.diff(exits)
    new = np.ones(len(exits), dtype=bool)
    new[1:] = (step != 0) & (step != 1)
    new[2:] |= step[1:] != step[:-1]
    begins = np.flatnonzero(new)
    following = np.minimum(begins + 1, len(exits) - 1)
    slopes = np.where(new[following], 0, exits[following] - exits[begins])
    return begins.tolist(), exits[begins].tolist(), slopes.tolist()


def _exit(table, entry):
    """The exits of one entry or an array of entries."""
    begins, exits, slopes = (np.asarray(part) for part in (table.begins, table.exits, table.slopes))
    piece = np.searchsorted(begins, entry, side="right") - 1
    return exits[piece] + slopes[piece] * (entry - begins[piece])


def _block_exits(rows: pd.DataFrame, span: int, max_rows: int, block_rows: int) -> np.ndarray:
    """Entry offset -> offset at which the next block is entered, for each of `max_rows` entries."""
    start, end = rows["start_us"].to_numpy(), rows["end_us"].to_numpy()
    count = len(start)
    jump = np.arange(max(count, max_rows) + 1)
    inner = min(count, block_rows)
    jump[:inner] = _next_opener(start, end, span, max_rows)[:inner]
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    return np.clip(jump[:max_rows] - block_rows, 0, max_rows - 1)


def _table(block: int, exits: np.ndarray) -> pd.DataFrame:
    begins, values, slopes = _pieces(exits)
    return pd.DataFrame({"block": [block], "begins": [begins], "exits": [values], "slopes": [slopes]})


def _exits_job(span: int, max_rows: int, block_rows: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no")
        return _table(rows["block"].iloc[0], _block_exits(rows, span, max_rows, block_rows))

    return run


def _chain_job(fan: int, max_rows: int):
    """Compose the exit tables of consecutive blocks into one table for the whole chain."""

    def run(tables: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values("block")
        through = np.arange(max_rows)
        for table in tables.itertuples():
            through = _exit(table, through)
        return _table(tables["block"].iloc[0] // fan, through)

    return run


def _entries_job():
    """Walk a chain from its known entry and give every block its own."""

    def run(tables: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values("block")
        here = int(known["entry"].iloc[0])
        entries = []
        for table in tables.itertuples():
            entries.append(here)
            here = int(_exit(table, here))
        return pd.DataFrame({"block": tables["block"].to_numpy(), "entry": entries})

    return run


def _batches_job(span: int, max_rows: int, block_rows: int):
    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no")
        start, end = rows["start_us"].to_numpy(), rows["end_us"].to_numpy()
        names, number = rows["ric"].tolist(), rows["row_no"].to_numpy()
        following = _next_opener(start, end, span, max_rows).tolist()
        inner = min(len(names), block_rows)
        out = []
        at = int(known["entry"].iloc[0])
        while at < inner:
            stop = following[at]
            symbols = list(dict.fromkeys(names[at:stop]))
            out.append((number[at], start[at], end[at:stop].max(), stop - at, symbols, min(symbols)))
            at = stop
        columns = ["first_row", "start_us", "end_us", "rows", "syms", "first_ric"]
        return pd.DataFrame(out, columns=columns)

    return run


def _block_entries(exits: DataFrame, blocks: int, max_rows: int) -> DataFrame:
    """Entry offset of each block: compose up in chains until one is left, then walk back down."""
    levels = [exits]
    while blocks > BLOCKS_PER_CHAIN:
        chain = F.expr(f"block div {BLOCKS_PER_CHAIN}")
        up = levels[-1].groupBy(chain.alias("chain")).applyInPandas(
            _chain_job(BLOCKS_PER_CHAIN, max_rows), _TABLE
        )
        levels.append(up)
        blocks = -(-blocks // BLOCKS_PER_CHAIN)
    known = exits.sparkSession.range(1).select(F.col("id").alias("chain"), F.lit(0).cast("bigint").alias("entry"))
    for tables in reversed(levels):
        keyed = tables.withColumn("chain", F.expr(f"block div {BLOCKS_PER_CHAIN}"))
        entries = (
            keyed.groupBy("chain")
            .cogroup(known.groupBy("chain"))
            .applyInPandas(_entries_job(), "block bigint, entry bigint")
        )
        known = entries.withColumnRenamed("block", "chain")
    return entries


def pack_windows(
    windows: DataFrame,
    key: str = "row_key",
    max_minutes: float = WINDOW_MAX_MINUTES,
    max_rows: int = WINDOW_MAX_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Batches of windows `(ric, start, end, key)` taken in order of (start, key).

    A batch closes before the row that would make max(end) - min(start) exceed the span or
    its row count exceed `max_rows`; that row opens the next batch. `key` must be unique.

    Which row opens a batch depends on all rows before it, but the batch opened at a row
    depends on the next `max_rows` rows only. So the order is cut into equal blocks, each
    with a short look-ahead; each block maps every possible entry offset to its exit offset;
    the maps are composed; and each block then emits its batches from its known entry. Maps are
    kept as pieces of constant or evenly growing exits, so their size follows how exits differ,
    not `max_rows`.
    """
    block_rows = max(block_rows, max_rows)
    span = round(max_minutes * 60 * 1_000_000)
    ordered = number_rows(
        windows.select(
            F.col(key).alias("_key"),
            "ric",
            F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"),
            F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"),
        ),
        ["start_us", "_key"],
    ).drop("_key")
    last = ordered.agg(F.max("row_no")).first()[0]
    blocks = 0 if last is None else last // block_rows + 1

    home = F.expr(f"row_no div {block_rows}")
    is_lookahead = (F.col("row_no") % block_rows < max_rows) & (home > 0)
    rows = ordered.withColumn(
        "block", F.explode_outer(F.when(is_lookahead, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    exits = rows.groupBy("block").applyInPandas(_exits_job(span, max_rows, block_rows), _TABLE)
    entries = _block_entries(exits, blocks, max_rows)
    batches = (
        rows.groupBy("block")
        .cogroup(entries.groupBy("block"))
        .applyInPandas(
            _batches_job(span, max_rows, block_rows),
            "first_row bigint, start_us bigint, end_us bigint, rows int, syms array<string>, first_ric string",
        )
    )
    return batches.select(
        "first_row",
        F.timestamp_micros("start_us").alias("start"),
        F.timestamp_micros("end_us").alias("end"),
        "rows",
        "syms",
        "first_ric",
    )
