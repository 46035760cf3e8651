"""Whole jobs from live file systems and files to written results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowline.fixed_values import BASE_PATH, DEEP_BASE_PATH, MARKER_DAYS, OLD_DISTRIBUTED_DAYS, OLD_LOCAL_DAYS
from stowline.functions.paths import file_name
from stowline.plans import cleanup, extraction, retention, usage
from stowline.sinks.files import publish_csv, write_csv, write_path_list, write_requests
from stowline.sources import interest, texts
from stowline.sources.inventory import list_tree, one_level_directories

# Settings of the jobs and their defaults.
SETTINGS = {
    "spark.cleanup.basePath": BASE_PATH,
    "spark.cleanup.recursiveLevel": "1",
    "spark.cleanup.outputPath": "/tmp/hdfs_dir_sizes",
    "spark.cleanup.inputPath": None,
    "spark.cleanup.daysThreshold": str(MARKER_DAYS),
}


def setting(spark: SparkSession, name: str) -> str:
    value = spark.conf.get(f"spark.cleanup.{name}", SETTINGS[f"spark.cleanup.{name}"])
    if value is None:
        raise ValueError(f"spark.cleanup.{name} is not set")
    return value


def directory_size_job(spark: SparkSession) -> DataFrame:
    """Sizes of the directories down to the level set, written as CSV."""
    base = setting(spark, "basePath")
    report = usage.directory_report(list_tree(spark, base), base, int(setting(spark, "recursiveLevel")))
    write_csv(report, setting(spark, "outputPath"))
    return report


def listed_size_job(spark: SparkSession, name: str = "directory_sizes.csv") -> str:
    """Live sizes of the listed directories as one `path,size` CSV; returns its place."""
    listed = texts.read_lines(spark, setting(spark, "inputPath")).select(F.col("value").alias("path"))
    sizes = cleanup.live_sizes(listed)
    return publish_csv(sizes.select("path", "size"), setting(spark, "outputPath"), name)


def delete_job(spark: SparkSession, allowed_root: str, dry_run: bool = True, protected: tuple[str, ...] = ()) -> DataFrame:
    """Statuses of the listed paths' deletion."""
    listed = texts.read_path_list(spark, setting(spark, "inputPath"), distinct=False)
    return cleanup.delete_paths(listed, allowed_root, dry_run, protected)


def marker_job(spark: SparkSession, now: datetime | str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """Purge success markers under the base path."""
    base = setting(spark, "basePath")
    return cleanup.purge_markers(list_tree(spark, base), now, base, int(setting(spark, "daysThreshold")), dry_run)


def group_usage_job(spark: SparkSession, base: str = DEEP_BASE_PATH) -> DataFrame:
    """List, measure and pivot in one go, without files in between."""
    return usage.group_wise_usage(list_tree(spark, base), base)


def tick_filter_job(
    spark: SparkSession,
    interest_path: str,
    ticks_path: str,
    output: str,
    partitions: int | None = None,
) -> None:
    """Ticks inside the interest windows, written as CSV; refuses to replace an earlier result."""
    windows = interest.interest_windows(interest.read_named_interest(spark, interest_path))
    kept = extraction.filter_ticks(interest.read_ticks(spark, ticks_path), windows)
    write_csv(kept, output, "errorifexists", partitions)


def window_request_job(spark: SparkSession, interest_path: str, output: str, by_start: bool = False) -> None:
    """Request lines for the packed windows of an interest list."""
    order = extraction.BY_START if by_start else extraction.BY_SYMBOL
    windows = interest.interest_windows(interest.read_raw_interest(spark, interest_path))
    write_requests(extraction.window_requests(windows, order), output)


def cycle_job(
    spark: SparkSession,
    inventory: DataFrame,
    cycle_folder: str,
    now: datetime | str,
    allowed_root: str,
    permanent: str | None = None,
    temporary: str | None = None,
    versioned: str | None = None,
    days: int | None = None,
    dry_run: bool = True,
    protected: tuple[str, ...] = (),
    strict_grace: bool = False,
    journal: str | None = None,
) -> tuple[str, DataFrame | None]:
    """One run of the deletion cycle: (phase, scheduled paths or delete statuses or nothing).

    Without a coming cycle it schedules one and writes its list; on the day it subtracts the
    cycle's own, the temporary and the permanent exclusions and deletes; before it, it reminds.
    `versioned` lists directories of which only the highest version is kept; `days` is then that of local files by
    default, else that of distributed ones. With `strict_grace` the deletion waits for the cycle's date itself. `journal`
    is where the deletes are written down, for a run that goes on after a lost one.
    """
    days = days if days is not None else OLD_LOCAL_DAYS if versioned else OLD_DISTRIBUTED_DAYS
    names = one_level_directories(spark, cycle_folder).select(file_name("path").alias("name"))
    status = cleanup.cycle_status(names, now, strict_grace).first()
    day = (status.cycle_date or status.planned_date).strftime("%Y%m%d")
    place = f"{cycle_folder.rstrip('/')}/scheduled_deletion_{day}"
    kept = texts.path_list_or_empty(spark, permanent)
    if status.phase == "schedule":
        if versioned:
            old = retention.find_old(inventory, kept, texts.path_list_or_empty(spark, versioned), now, days)
        else:
            old = retention.find_old_in_listing(inventory, kept, now, days)
        write_path_list(old, f"{place}/files_scheduled_{day}.txt")
        return status.phase, texts.read_path_list(spark, f"{place}/files_scheduled_{day}.txt")
    if status.phase == "remind":
        return status.phase, None
    scheduled = texts.path_list_or_empty(spark, f"{place}/files_scheduled_{day}.txt")
    lists = [texts.path_list_or_empty(spark, f"{place}/exclusions_{day}.txt"), texts.path_list_or_empty(spark, temporary), kept]
    final = cleanup.final_list(scheduled, *lists)
    write_path_list(final, f"{place}/final_deletion_list_{day}.txt")
    written = texts.path_list_or_empty(spark, f"{place}/final_deletion_list_{day}.txt")
    return status.phase, cleanup.delete_paths(written, allowed_root, dry_run, protected, journal)
