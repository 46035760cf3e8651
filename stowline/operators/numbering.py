"""Global row numbers without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stowline.session import materialize

_ROW_BITS = 33


def number_rows(df: DataFrame, order_by: Sequence[str], name: str = "row_no") -> DataFrame:
    """Number rows 0, 1, ... in the order of `order_by`, which must be unique.

    Rows are range-partitioned by the whole key, so a hot leading value is split by the
    rest of the key. The placement is stored once; the partition counts (one row per
    partition) give each partition its first number.
    """
    placed = materialize(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_place", _ROW_BITS).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    in_part = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        # one row per partition, so the size is bounded by the partition count
        .join(F.broadcast(first), "_part")
        .withColumn(name, F.col("_first") + in_part)
        .drop("_place", "_part", "_first")
    )
