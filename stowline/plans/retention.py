"""Finders for old data: files, dated directories, archives, markers, versions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from stowline.fixed_values import (
    ARCHIVE_SUFFIX,
    DATE_COMPONENT_PATTERN,
    MARKER_DAYS,
    MARKER_NAME,
    OLD_DISTRIBUTED_DAYS,
    OLD_LOCAL_DAYS,
)
from stowline.functions.paths import embedded_month, file_name, normalize, parent
from stowline.functions.times import age_days, days_before, like_column
from stowline.operators.prefix import exclude_below
from stowline.operators.versions import old_versions, version_directories


def older_than(inventory: DataFrame, now: datetime | str, days: int, only_files: bool = False) -> DataFrame:
    """Rows last changed before now - days; directories count too unless `only_files`."""
    old = inventory.filter(F.col("mtime") < like_column(inventory, "mtime", days_before(now, days)))
    return old.filter(~F.col("is_dir")) if only_files else old


def before_date(inventory: DataFrame, cutoff: datetime | str) -> DataFrame:
    """Files last changed before midnight of the cutoff."""
    return inventory.filter(~F.col("is_dir") & (F.col("mtime") < like_column(inventory, "mtime", cutoff)))


def dated_directories(directories: DataFrame, cutoff: int | str) -> DataFrame:
    """Directories with an eight-digit component below the cutoff number."""
    dated = F.exists(
        F.split("path", "/"),
        lambda part: part.rlike(DATE_COMPONENT_PATTERN) & (part.try_cast("int") < F.lit(int(cutoff))),
    )
    return directories.filter(F.col("path").rlike("[0-9]{8}") & dated)


def archives_before(inventory: DataFrame, month: int | str) -> DataFrame:
    """Archives whose name's first date lies in a month before the cutoff; undated ones are left out."""
    return inventory.filter(
        F.col("path").endswith(ARCHIVE_SUFFIX) & (embedded_month("path").try_cast("int") < F.lit(int(month)))
    )


def old_markers(inventory: DataFrame, now: datetime | str, days: int = MARKER_DAYS) -> DataFrame:
    """Success markers at least `days` whole days old, with their age."""
    is_marker = ~F.col("is_dir") & (file_name("path") == MARKER_NAME)
    return (
        inventory.filter(is_marker)
        .withColumn("age_days", age_days(F.col("mtime"), now))
        .filter(F.col("age_days") >= days)
    )


def in_directories(paths: DataFrame, base: str, names: Sequence[str]) -> DataFrame:
    """Rows whose parent is one of base/{names}."""
    return paths.filter(parent("path").isin(*[f"{base.rstrip('/')}/{name}" for name in names]))


def find_old_in_listing(
    inventory: DataFrame,
    exclusions: DataFrame,
    now: datetime | str,
    days: int = OLD_DISTRIBUTED_DAYS,
    only_files: bool = False,
) -> DataFrame:
    """Old paths outside the exclusions."""
    return exclude_below(older_than(inventory, now, days, only_files), exclusions).select("path")


def find_old(
    inventory: DataFrame,
    exclusions: DataFrame,
    versioned: DataFrame,
    now: datetime | str,
    days: int = OLD_LOCAL_DAYS,
) -> DataFrame:
    """Old files outside the exclusions and the versioned roots, plus those roots' superseded versions."""
    closed = exclusions.select("path").unionByName(versioned.select("path"))
    files = exclude_below(older_than(inventory, now, days, only_files=True), closed).select("path")
    roots = versioned.select(normalize("path").alias("parent")).distinct()
    kept_dirs = exclude_below(version_directories(inventory).join(roots, "parent", "left_semi"), exclusions)
    return files.unionByName(old_versions(kept_dirs).select("path"))


def listed_terms(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms that equal a trimmed line of the list."""
    rows = lines.select(F.trim("path").alias("term"))
    return terms.select(F.trim("term").alias("term")).join(rows, "term", "left_semi")


def is_listed(lines: DataFrame, term: str) -> DataFrame:
    """At most one row: the term, when it is in the list."""
    return lines.select(F.trim("path").alias("term")).filter(F.col("term") == term.strip()).limit(1)
