"""Path-ancestry anti-join: drop rows equal to, or below, an excluded path."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from stowline.functions.paths import identity
from stowline.functions.staging import once
from stowline.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEP = "\x00"
# what all broadcast key sets of one exclusion may hold together
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 * 1024 * 1024


def _pieces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit(""))) + 1


def _prefix(text: Column, pieces: Column | int) -> Column:
    count = F.lit(pieces) if isinstance(pieces, int) else pieces
    return F.call_function("substring_index", text, F.lit("/"), count)


def exclusion_keys(exclusions: DataFrame, column: str = "path") -> DataFrame:
    """Distinct exclusions by path identity with their piece count, stored; the root is the empty first piece.

    Schemes and hosts are left out on both sides: a bare exclusion protects qualified paths and the other way round.
    """
    trimmed = exclusions.select(F.trim(F.col(column)).alias("_key")).filter(F.col("_key") != "")
    norm = trimmed.select(identity("_key").alias("_key"))
    keys = norm.select(F.when(F.col("_key") == "/", F.lit("")).otherwise(F.col("_key")).alias("_key"))
    return materialize(keys.distinct().withColumn("_pieces", _pieces(F.col("_key"))))


def split_depths(keys: DataFrame) -> tuple[list[int], list[int]]:
    """(piece counts whose keys fit the broadcast bounds together, the other piece counts).

    One row per path depth comes back, never the keys.
    """
    sizes = keys.groupBy("_pieces").agg(F.count("*").alias("rows"), F.sum(F.octet_length("_key")).alias("bytes"))
    small, large, rows, bytes_ = [], [], 0, 0
    for at in sorted(sizes.collect(), key=lambda at: (at.rows, at.bytes)):
        rows, bytes_ = rows + at.rows, bytes_ + at.bytes
        (small if rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES else large).append(at["_pieces"])
    return sorted(small), sorted(large)


def anti_join_by_depth(df: DataFrame, keys: DataFrame, depths: list[int], path: str = "path") -> DataFrame:
    """One hash anti-join per exclusion depth on the path's prefix; the rows are not shuffled.

    The depths must come from the small part of `split_depths`, which bounds their keys.
    """
    out = once(df, _norm=identity(path))
    for pieces in depths:
        at_depth = keys.filter(F.col("_pieces") == pieces).select("_key")
        out = out.join(F.broadcast(at_depth), _prefix(F.col("_norm"), pieces) == F.col("_key"), "left_anti")
    return out.drop("_norm")


def order_key(norm: Column) -> Column:
    """Text in whose order a path comes directly before all that lies below it: the separator sorts before any other character."""
    bare = F.when(norm == "/", F.lit("")).otherwise(norm)
    for one, other in (("\x01", "\x01\x03"), ("\x00", "\x01\x02"), ("/", _STEP)):
        bare = F.replace(bare, F.lit(one), F.lit(other))
    return bare


def in_path_order(df: DataFrame, keys: DataFrame, path: str = "path") -> DataFrame:
    """Rows and exclusions in one order, range-partitioned on the same bounds; exclusions stand before the rows of their path.

    `_turn` is negative for exclusions and spreads the rows of one path over several partitions.
    """
    rows = df.withColumns({"_order": order_key(identity(path)), "_turn": F.rand(11)})
    blank = [F.lit(None).cast(field.dataType).alias(field.name) for field in df.schema]
    marks = keys.select(*blank, order_key(F.col("_key")).alias("_order"), F.lit(-1.0).alias("_turn"))
    return rows.unionByName(marks).repartitionByRange("_order", "_turn").sortWithinPartitions("_order", "_turn")


def _open_at_start(placed: DataFrame, keys: DataFrame) -> dict[int, str]:
    """Partition -> the outermost exclusion that its first path lies below. One row per partition at most comes back."""
    first = placed.filter(F.col("_order").isNotNull()).groupBy("_part").agg(F.min("_order").alias("_first"))
    pieces = F.length("_first") - F.length(F.replace("_first", F.lit(_STEP), F.lit(""))) + 1
    above = F.transform(F.sequence(F.lit(1), pieces), lambda count: F.call_function("substring_index", "_first", F.lit(_STEP), count))
    spread = first.select("_part", F.explode(above).alias("_order"))
    # a row per partition and depth
    met = keys.select(order_key(F.col("_key")).alias("_order")).join(F.broadcast(spread), "_order")
    return {row["_part"]: row["_outer"] for row in met.groupBy("_part").agg(F.min("_order").alias("_outer")).collect()}


def anti_join_by_order(df: DataFrame, keys: DataFrame, path: str = "path") -> DataFrame:
    """For key sets of any size: rows and exclusions are merged in path order, in one pass over one shuffle.

    A subtree is a contiguous range of the order, so the pass holds only the exclusion that is open. What is open where a
    partition begins is looked up from the partitions' first paths. The placement is stored: both readings, and retries,
    see the same partitions.
    """
    placed = materialize(in_path_order(df, keys, path).withColumn("_part", F.spark_partition_id()))
    opened = _open_at_start(placed, keys)
    names, step = df.columns, _STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                closed, begun = opened.get(batch.column("_part")[0].as_py()), True
            kept = []
            for order, turn in zip(batch.column("_order").to_pylist(), batch.column("_turn").to_pylist()):
                below = closed is not None and order is not None and (order == closed or order.startswith(closed + step))
                if not below and turn < 0:
                    closed = order
                kept.append(not below and turn >= 0)
            rows = pa.RecordBatch.from_arrays([batch.column(name) for name in names], names)
            yield rows.filter(pa.array(kept, pa.bool_()))

    return placed.mapInArrow(run, placed.select(*names).schema)


def exclude_below(
    df: DataFrame,
    exclusions: DataFrame,
    path: str = "path",
    exclusion: str = "path",
) -> DataFrame:
    """Drop the rows whose path is excluded; each exclusion depth goes the way its counted size allows."""
    keys = exclusion_keys(exclusions, exclusion)
    small, large = split_depths(keys)
    kept = anti_join_by_depth(df, keys, small, path) if small else df
    return anti_join_by_order(kept, keys.filter(F.col("_pieces").isin(large)), path) if large else kept
