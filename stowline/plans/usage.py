"""Usage reports over file inventories and size lists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from stowline.fixed_values import (
    BASE_PATH,
    DEEP_BASE_PATH,
    OLD_REPORT_DAYS,
    PIVOT_TEAMS,
    SIZE_ERROR,
    SIZE_INVALID,
    SIZE_LINE_TEAM_KEYWORDS,
    TEAM_KEYWORDS,
    TEAM_PATTERNS,
    TOP_DIRECTORIES,
)
from stowline.functions.classify import keyword_in_segments, pattern_in, with_top_and_team, word_in
from stowline.functions.paths import component, leading_pieces, parent, rebase, relative_to
from stowline.functions.sizes import format_binary, format_cell, format_si, parse_size, size_too_large
from stowline.functions.times import days_before, like_column
from stowline.operators.directories import directory_sizes, listed_sizes, tops_and_children

PATHS_PER_LIST = 10_000


def classified(
    inventory: DataFrame,
    tops: Sequence[str] = TOP_DIRECTORIES,
    keywords: Sequence[str] = TEAM_KEYWORDS,
) -> DataFrame:
    """The inventory's rows under the wanted top directories, with `top_dir` and `team`."""
    return with_top_and_team(inventory, keywords).filter(F.col("top_dir").isin(*tops))


def older(inventory: DataFrame, now: datetime | str, days: int) -> DataFrame:
    return inventory.filter(F.col("mtime") < like_column(inventory, "mtime", days_before(now, days)))


def usage_by_team(inventory: DataFrame, **rules) -> DataFrame:
    """Bytes by top directory and team, largest first."""
    return (
        classified(inventory, **rules)
        .groupBy("top_dir", "team")
        .agg(F.sum("length").alias("total_size_bytes"))
        .withColumn("size_human", format_binary(F.col("total_size_bytes")))
        .orderBy(F.desc("total_size_bytes"), "top_dir", "team")
    )


def old_usage_by_team(inventory: DataFrame, now: datetime | str, days: int = OLD_REPORT_DAYS, **rules) -> DataFrame:
    return (
        classified(older(inventory, now, days), **rules)
        .groupBy("top_dir", "team")
        .agg(F.sum("length").alias("old_size_bytes"))
        .withColumn("old_size_human", format_binary(F.col("old_size_bytes")))
        .orderBy(F.desc("old_size_bytes"), "top_dir", "team")
    )


def _old_totals(old: DataFrame) -> DataFrame:
    return old.groupBy("top_dir", "team").agg(
        F.sum("length").alias("old_size_bytes"), F.count("*").alias("old_files")
    )


def old_files_by_team(inventory: DataFrame, now: datetime | str, days: int = OLD_REPORT_DAYS, **rules) -> DataFrame:
    """One row per old file beside its group's bytes."""
    old = classified(older(inventory, now, days), **rules)
    # at most (top directories) x (teams + 1) groups, so the totals always fit a broadcast
    totals = F.broadcast(_old_totals(old).withColumn("old_size_human", format_binary(F.col("old_size_bytes"))))
    return old.select("top_dir", "team", "path").join(totals.drop("old_files"), ["top_dir", "team"])


def old_path_lists(
    inventory: DataFrame,
    now: datetime | str,
    days: int = OLD_REPORT_DAYS,
    paths_per_list: int = PATHS_PER_LIST,
    **rules,
) -> DataFrame:
    """Old paths of each group as arrays, a large group in several parts of about `paths_per_list`."""
    old = classified(older(inventory, now, days), **rules)
    parts = F.ceil(F.col("old_files") / F.lit(paths_per_list)).cast("bigint")
    totals = F.broadcast(_old_totals(old).withColumn("parts", parts))
    return (
        old.select("top_dir", "team", "path")
        .join(totals, ["top_dir", "team"])
        .groupBy("top_dir", "team", F.pmod(F.xxhash64("path"), F.col("parts")).alias("part"), "old_size_bytes")
        .agg(F.array_sort(F.collect_list("path")).alias("old_file_paths"))
        .withColumn("old_size_human", format_binary(F.col("old_size_bytes")))
    )


def _by_level(inventory: DataFrame, base: str) -> DataFrame:
    clean = inventory.select(rebase("path", base).alias("_clean"), "length")
    return clean.groupBy(component("_clean", 3).alias("top_level"), component("_clean", 4).alias("second_level")).agg(
        F.sum("length").alias("total_size_bytes")
    )


def usage_two_level(inventory: DataFrame, base: str = BASE_PATH) -> DataFrame:
    return _by_level(inventory, base).orderBy(F.desc("total_size_bytes"), "top_level", "second_level")


def usage_top_level(inventory: DataFrame, base: str = BASE_PATH) -> DataFrame:
    return (
        inventory.groupBy(component(rebase("path", base), 3).alias("top_level"))
        .agg(F.sum("length").alias("total_size_bytes"))
        .orderBy(F.desc("total_size_bytes"), "top_level")
    )


def usage_levels(inventory: DataFrame, base: str = BASE_PATH) -> DataFrame:
    """Both level reports from one pass: `level` 1 rows total the top directories, level 2 the pairs."""
    sets = [["top_level"], ["top_level", "second_level"]]
    level = F.when(F.grouping("second_level") == 1, F.lit(1)).otherwise(F.lit(2))
    return (
        _by_level(inventory, base)
        .groupingSets([[F.col(name) for name in names] for names in sets], F.col("top_level"), F.col("second_level"))
        .agg(F.sum("total_size_bytes").alias("total_size_bytes"), level.alias("level"))
    )


def directory_report(inventory: DataFrame, base: str = BASE_PATH, levels: int = 1) -> DataFrame:
    """Recursive size of each directory down to `levels`."""
    sizes = directory_sizes(inventory, base, levels)
    return sizes.withColumn("size_human_readable", format_si(F.col("size_bytes"), "k"))


def listed_size_report(inventory: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, size_bytes, status, size): the size text carries the status of unusable paths."""
    sizes = listed_sizes(inventory, listed)
    return sizes.withColumn("size", size_text(F.col("size_bytes"), F.col("status")))


def size_text(size, status):
    return F.when(status.isin(SIZE_INVALID, SIZE_ERROR), status).otherwise(format_si(size, "K"))


def team_pivot(
    sizes: DataFrame,
    teams: Sequence[str] = PIVOT_TEAMS,
    expected: Sequence[str] = (),
    pieces: int = 6,
    formatted: bool = True,
    errors: str | None = None,
) -> DataFrame:
    """Bytes of `(path, size_bytes)` rows by base path, one column per team and `others`.

    Expected base paths enter as zero rows, so the missing ones show up without a join. `errors` names a flag of rows whose
    size is missing; they are counted in a column of that name.
    """
    rows = sizes.select(
        leading_pieces("path", pieces).alias("base_path"),
        word_in(F.col("path"), teams).alias("team"),
        F.coalesce("size_bytes", F.lit(0).cast("bigint")).alias("bytes"),
        (F.col(errors) if errors else F.lit(False)).cast("bigint").alias("_errors"),
    )
    if expected:
        blank = [(path, "others", 0, 0) for path in expected]
        rows = rows.unionByName(sizes.sparkSession.createDataFrame(blank, "base_path string, team string, bytes bigint, _errors bigint"))
    columns = [*teams, "others"]
    sums = [F.sum(F.when(F.col("team") == team, F.col("bytes")).otherwise(F.lit(0))).alias(team) for team in columns]
    table = rows.groupBy("base_path").agg(*sums, F.sum("_errors").alias("_errors"))
    cells = [format_cell(F.col(team)).alias(team) if formatted else F.col(team) for team in columns]
    counted = [F.col("_errors").alias(errors)] if errors else []
    return table.select("base_path", *cells, *counted).orderBy("base_path")


def report_pivot(report: DataFrame, **options) -> DataFrame:
    """The pivot from a `path,size` report with decimal size texts; `too_large` counts the sizes that no cell holds."""
    size = F.col("size")
    sized = report.select("path", parse_size(size, 1000).alias("size_bytes"), size_too_large(size, 1000).alias("too_large"))
    return team_pivot(sized, errors="too_large", **options)


def group_wise_usage(
    inventory: DataFrame,
    base: str = DEEP_BASE_PATH,
    tops: Sequence[str] = TOP_DIRECTORIES,
    teams: Sequence[str] = PIVOT_TEAMS,
    formatted: bool = True,
) -> DataFrame:
    """Sizes of the directories right below base/{tops}, pivoted by team; exact bytes all the way."""
    wanted = [f"{base.rstrip('/')}/{top}" for top in tops]
    sizes = directory_sizes(inventory, base, 2).filter(parent("path").isin(*wanted))
    pieces = len([part for part in base.split("/") if part]) + 2
    return team_pivot(sizes, teams, wanted, pieces, formatted)


def top_child_report(inventory: DataFrame, base: str = BASE_PATH, patterns=TEAM_PATTERNS) -> DataFrame:
    """Each top directory with its immediate children; tops without children are left out."""
    tops, children = tops_and_children(inventory, base)
    return (
        children.join(tops, "top")
        .withColumn("team", pattern_in(F.lower(relative_to("top", base)), patterns))
        .withColumn("top_size", format_binary(F.col("top_bytes")))
        .withColumn("child_size", format_binary(F.col("child_bytes")))
    )


def top_report(inventory: DataFrame, base: str = BASE_PATH, patterns=TEAM_PATTERNS) -> DataFrame:
    sizes = directory_sizes(inventory, base, 1)
    return sizes.withColumn("team", pattern_in(F.lower(relative_to("path", base)), patterns)).withColumn(
        "size", format_binary(F.col("size_bytes"))
    )


def team_totals(inventory: DataFrame, base: str = BASE_PATH, patterns=TEAM_PATTERNS) -> DataFrame:
    return (
        top_report(inventory, base, patterns)
        .groupBy("team")
        .agg(F.sum("size_bytes").alias("total_bytes"))
        .withColumn("total_size", format_binary(F.col("total_bytes")))
    )


def old_directory_summary(
    size_lines: DataFrame,
    base: str = DEEP_BASE_PATH,
    base_index: int = 5,
    keywords: Sequence[str] = SIZE_LINE_TEAM_KEYWORDS,
) -> DataFrame:
    """Bytes by (base directory, team) and by team alone, from `path,size` lines.

    The lines are summed once; the overall totals are grouping sets over that small result. `too_large` counts the lines
    whose size no total holds.
    """
    pieces = F.split("path", "/")
    pairs = size_lines.groupBy(
        F.coalesce(F.get(pieces, F.lit(base_index)), F.lit("unknown")).alias("base_dir"),
        keyword_in_segments(pieces, base_index, keywords).alias("team"),
    ).agg(
        F.coalesce(F.sum(parse_size(F.col("size"), 1024)), F.lit(0)).cast("decimal(38,0)").alias("bytes"),
        F.count_if(size_too_large(F.col("size"), 1024)).alias("large"),
    )
    report = pairs.groupingSets(
        [[F.col("base_dir"), F.col("team")], [F.col("team")]], F.col("base_dir"), F.col("team")
    ).agg(F.sum("bytes").alias("total_bytes"), F.sum("large").alias("too_large"), F.grouping("base_dir").alias("is_total"))
    size = format_binary(F.col("total_bytes"))
    label = F.when(
        F.col("is_total") == 0,
        F.concat(F.col("team"), F.lit(f" size in {base}/"), F.col("base_dir"), F.lit(" = "), size),
    ).otherwise(F.concat(F.col("team"), F.lit(" size for old dirs = "), size))
    return report.withColumn("line", label).orderBy("is_total", "base_dir", "team")
