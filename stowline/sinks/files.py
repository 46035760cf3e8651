"""CSV and text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """CSV with header; `mode="errorifexists"` refuses to replace. Without `partitions` Spark sizes the files."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode(mode).option("header", True).csv(path)


def publish_csv(df: DataFrame, folder: str, name: str) -> str:
    """Write a report as the CSV `folder`/`name`, replacing the old one; returns its place.

    It is a folder of part files at every size, written in parallel, each with the header.
    """
    target = f"{folder.rstrip('/')}/{name}"
    write_csv(df, target)
    return target


def write_path_list(df: DataFrame, path: str, mode: str = "overwrite", column: str = "path") -> None:
    df.select(F.make_valid_utf8(F.col(column)).alias("value")).write.mode(mode).text(path)


def append_path_list(df: DataFrame, path: str, column: str = "path") -> None:
    """Add trimmed, non-blank lines; repeats are kept."""
    rows = df.select(F.trim(F.col(column)).alias(column)).filter(F.col(column) != "")
    write_path_list(rows, path, "append", column)


def write_requests(requests: DataFrame, path: str) -> None:
    """One request per line in the order of `position`: part files by name, lines within them."""
    requests.orderBy("position").select(F.col("request").alias("value")).write.mode("overwrite").text(path)


def preview(df: DataFrame, rows: int, *order) -> DataFrame:
    """The first rows in an order, as a DataFrame."""
    return df.orderBy(*order).limit(rows)
