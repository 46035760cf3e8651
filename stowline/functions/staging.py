"""Keep a derived column from being worked out again by every filter above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that Spark evaluates one time per row.

    A plain derived column is copied into the filters (also inferred NOT NULL tests) that
    Spark pushes below it. Generator output is not, while pruning and the filters on the
    other columns still reach the scan.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(packed)))
