"""Text and CSV inputs: path lists, listings, size lines, quota lines, cycle names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowline.functions.staging import once
from stowline.functions.times import cycle_date, parse_minute
from stowline.operators.numbering import number_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with broken bytes replaced."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))


def _trimmed() -> Column:
    return F.regexp_replace("value", "^\\s+|\\s+$", "")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): lines numbered from 0 through all files, by file path and place in the file."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_line"))
    # a block is read by one task from its start, so the running number orders its lines
    return number_rows(lines, ["_file", "_block", "_line"], "position").select("position", "value")


def path_rows(lines: DataFrame) -> DataFrame:
    """One trimmed path per line, blank lines dropped, repeats kept."""
    return lines.select(_trimmed().alias("path")).filter(F.col("path") != "")


def read_path_list(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    rows = path_rows(read_lines(spark, path))
    return rows.distinct() if distinct else rows


def path_list_or_empty(spark: SparkSession, path: str | None) -> DataFrame:
    """An absent list is an empty one."""
    from stowline.sources.inventory import open_path, qualify

    if path:
        import pyarrow.fs as pafs

        fs, inside, _ = open_path(qualify(spark, path), {})
        if fs.get_file_info(inside).type != pafs.FileType.NotFound:
            return read_path_list(spark, path)
    return spark.createDataFrame([], "path string")


def manifest_rows(lines: DataFrame) -> DataFrame:
    """Lines that are neither empty nor comments."""
    return lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.col("value").alias("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(read_lines(spark, path))


def listing_rows(lines: DataFrame) -> DataFrame:
    """Recursive-listing lines as an inventory; lines with under eight fields or a bad date are dropped.

    The eighth field is the rest of the line, so paths keep their blanks.
    """
    field = lambda index: F.get("f", F.lit(index))
    fields = once(lines.select("value"), f=F.split(_trimmed(), "\\s+", 8)).filter(F.size("f") == 8)
    return once(fields, mtime=parse_minute(field(5), field(6))).filter(F.col("mtime").isNotNull()).select(
        field(7).alias("path"),
        field(0).startswith("d").alias("is_dir"),
        F.coalesce(field(4).try_cast("bigint"), F.lit(0).cast("bigint")).alias("length"),
        "mtime",
        field(2).alias("owner"),
        field(3).alias("owner_group"),
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return listing_rows(read_lines(spark, path))


def files_only(inventory: DataFrame) -> DataFrame:
    return inventory.filter(~F.col("is_dir"))


def directories_only(inventory: DataFrame) -> DataFrame:
    return inventory.filter(F.col("is_dir"))


def size_line_rows(lines: DataFrame) -> DataFrame:
    """`path,size` split at the first comma; blank and comma-less lines dropped."""
    parts = F.split(_trimmed(), ",", 2)
    return lines.filter(F.col("value").contains(",")).select(
        F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).alias("size")
    )


def read_size_lines(spark: SparkSession, path: str) -> DataFrame:
    return size_line_rows(read_lines(spark, path))


def read_size_report(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV `path,size`."""
    return spark.read.csv(path, header=True, schema="path string, size string")


def du_rows(lines: DataFrame) -> DataFrame:
    """Summary lines: first field as bytes (0 when it is no number or stands alone), rest as path."""
    parts = F.split(_trimmed(), "\\s+")
    count = F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)).try_cast("bigint"))
    return lines.select(F.element_at(parts, -1).alias("path"), F.coalesce(count, F.lit(0).cast("bigint")).alias("bytes"))


def cycle_rows(names: DataFrame, column: str = "name") -> DataFrame:
    """Valid cycle dates among directory names."""
    return names.select(cycle_date(F.col(column)).alias("cycle_date")).filter(F.col("cycle_date").isNotNull())
