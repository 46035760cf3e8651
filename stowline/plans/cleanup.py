"""The deletion cycle: schedule, remind, subtract exclusions, delete."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from stowline.fixed_values import GRACE_DAYS, MARKER_DAYS, SIZE_ERROR
from stowline.functions.paths import ancestors, normalize, strip_scheme
from stowline.functions.times import as_utc, days_left, instant
from stowline.operators.directories import listed_sizes, spread
from stowline.operators.filesystem import delete_paths, outcome_counts
from stowline.operators.prefix import exclude_below
from stowline.plans.retention import old_markers
from stowline.plans.usage import size_text
from stowline.session import joinable, materialize
from stowline.sources.inventory import list_tree
from stowline.sources.texts import cycle_rows


def merged_exclusions(*lists: DataFrame) -> DataFrame:
    first, *rest = [paths.select("path") for paths in lists]
    for paths in rest:
        first = first.unionByName(paths)
    return first.distinct()


def final_list(scheduled: DataFrame, *exclusions: DataFrame) -> DataFrame:
    """Distinct scheduled paths outside every exclusion list given; only what is left is made distinct."""
    return exclude_below(scheduled.select("path"), merged_exclusions(*exclusions)).distinct()


def upcoming_cycle(names: DataFrame, now: datetime | str) -> DataFrame:
    """One row: the earliest cycle date from today on, NULL when there is none."""
    today = F.lit(as_utc(now).date().isoformat()).cast("date")
    return cycle_rows(names).filter(F.col("cycle_date") >= today).agg(F.min("cycle_date").alias("cycle_date"))


def cycle_status(names: DataFrame, now: datetime | str, strict_grace: bool = False) -> DataFrame:
    """One row: cycle date, days left, phase, and the date a new cycle would get.

    Days left are rounded down, so the phase turns to `delete` during the day before the
    cycle date; with `strict_grace` it waits for the date itself.
    """
    planned = (as_utc(now) + timedelta(days=GRACE_DAYS)).date().isoformat()
    left = days_left(F.col("cycle_date"), now)
    due = (F.col("cycle_date") <= F.to_date(instant(now))) if strict_grace else (left <= 0)
    phase = F.when(F.col("cycle_date").isNull(), "schedule").when(due, "delete").otherwise("remind")
    return upcoming_cycle(names, now).select(
        "cycle_date",
        left.alias("days_left"),
        phase.alias("phase"),
        F.when(F.col("cycle_date").isNull(), F.lit(planned).cast("date")).alias("planned_date"),
    )


def run_deletion(
    scheduled: DataFrame,
    exclusions: list[DataFrame],
    allowed_root: str,
    dry_run: bool = True,
    protected: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(final list, statuses) of a cycle that is due."""
    paths = final_list(scheduled, *exclusions) if exclusions else scheduled.select("path").distinct()
    return paths, delete_paths(paths, allowed_root, dry_run, protected)


def purge_markers(
    inventory: DataFrame,
    now: datetime | str,
    allowed_root: str,
    days: int = MARKER_DAYS,
    dry_run: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(statuses, counts by status) of the old success markers."""
    statuses = delete_paths(old_markers(inventory, now, days).select("path"), allowed_root, dry_run)
    return statuses, outcome_counts(statuses)


def live_sizes(listed: DataFrame) -> DataFrame:
    """(path, size_bytes, status, size) of listed directories, measured on the file system now.

    A directory with an unreadable place below it is an error, whatever else it holds.
    """
    spark = listed.sparkSession
    found = list_tree(spark, listed, with_roots=True)
    sizes = listed_sizes(found, listed)
    failed = found.filter(F.col("error").isNotNull()).select(normalize(strip_scheme("path")).alias("_dir"))
    broken = spread(failed, ancestors("_dir")).distinct()
    marks = joinable(materialize(broken.select(F.col("path").alias("_dir"), F.lit(True).alias("_failed"))))
    joined = sizes.withColumn("_dir", normalize(strip_scheme("path"))).join(marks, "_dir", "left")
    status = F.when(F.col("_failed"), F.lit(SIZE_ERROR)).otherwise(F.col("status"))
    bytes_ = F.when(F.col("_failed").isNull(), F.col("size_bytes"))
    return joined.select("path", bytes_.alias("size_bytes"), status.alias("status")).withColumn(
        "size", size_text(F.col("size_bytes"), F.col("status"))
    )

