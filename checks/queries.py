"""Registered queries: each runs one operator or job over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.views import Tables
from stowline.fixed_values import (
    KEY_FUNCTION,
    KEY_GROUP_SYMBOLS,
    KEY_MINUTES,
    KEY_SLOT,
    KEY_SLOT_COUNT,
    KEY_SYMBOLS_PER_REQUEST,
    KEY_TEMPLATE,
)
from stowline.functions.classify import (
    keyword_in,
    keyword_in_segments,
    pattern_in,
    with_top_and_team,
    word_in,
)
from stowline.functions.paths import (
    ancestor,
    component,
    depth,
    embedded_date,
    embedded_month,
    file_name,
    leading_pieces,
    normalize,
    parent,
    rebase,
    relative_to,
    strip_scheme,
)
from stowline.functions.sizes import format_binary, format_cell, format_si, parse_size, size_too_large
from stowline.operators.directories import (
    all_directory_sizes,
    directories,
    directories_at,
    tops_and_children,
)
from stowline.operators.filesystem import delete_paths, journal_rows, outcome_counts, safe_paths
from stowline.operators.grid import day_slots, symbol_batches
from stowline.operators.intervals import covered_ranges, drop_repeats, interval_join, ticks_in_windows
from stowline.operators.packing import pack_windows
from stowline.operators.prefix import anti_join_by_order, exclude_below, exclusion_keys
from stowline.operators.versions import latest_versions, old_versions, version_directories
from stowline.plans import cleanup, extraction, jobs, quota, retention, usage
from stowline.session import materialize, scratch_folder
from stowline.sinks.files import (
    append_path_list,
    preview,
    publish_csv,
    write_csv,
    write_path_list,
    write_requests,
)
from stowline.sources import interest, inventory, texts

NOW = "2003-06-15 09:00:00"
CUTOFF = "2000-01-01"
CYCLE_NOW = "1998-03-01 09:00:00"
# before all cycles, among them, and after all
CYCLE_MOMENTS = ("1980-01-01 00:00:00", "1994-07-01 00:00:00", "1995-02-11 12:30:00", "1998-03-01 09:00:00", "2099-12-30 23:59:59")
TEMPLATE_SETTINGS = {
    KEY_TEMPLATE: "[d:$" + KEY_SLOT + "0;t:$" + KEY_SLOT + "1;e:$" + KEY_SLOT + "2;u:$" + KEY_SLOT
    + "3;s:$" + KEY_SLOT + "4;again:$" + KEY_SLOT + "10]",
    KEY_FUNCTION: "fetch",
    KEY_SLOT_COUNT: "11",
    KEY_GROUP_SYMBOLS: "Y",
    KEY_SYMBOLS_PER_REQUEST: "7",
    KEY_MINUTES: "1440",
    KEY_SLOT + "0_TYPE": "SDATE",
    KEY_SLOT + "0_FORMAT": "yyyy.MM.dd",
    KEY_SLOT + "1_TYPE": "STIME",
    KEY_SLOT + "1_FORMAT": "HH:mm:ss.SSS",
    KEY_SLOT + "2_TYPE": "EDATE",
    KEY_SLOT + "2_FORMAT": "yyyy.MM.dd",
    KEY_SLOT + "3_TYPE": "ETIME",
    KEY_SLOT + "3_FORMAT": "HH:mm:ss.SSS",
    KEY_SLOT + "4_TYPE": "STRING",
    KEY_SLOT + "10_TYPE": "SDATE",
    KEY_SLOT + "10_FORMAT": "yyyyMMdd",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[Tables], DataFrame]):
    QUERIES[run.__name__] = lambda spark, folder: run(Tables(spark, folder))
    return run


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS").alias(column)


# ---- usage -------------------------------------------------------------------


@query
def usage_by_team(t):
    return usage.usage_by_team(t.inventory(raw=True))


@query
def old_usage_by_team(t):
    return usage.old_usage_by_team(t.inventory(raw=True), NOW)


@query
def old_paths_by_team(t):
    return usage.old_files_by_team(t.inventory(raw=True), NOW)


@query
def old_path_lists(t):
    lists = usage.old_path_lists(t.inventory(raw=True), NOW, paths_per_list=500)
    return lists.groupBy("top_dir", "team").agg(
        F.sum(F.size("old_file_paths")).alias("paths"),
        F.min(F.get("old_file_paths", F.lit(0))).alias("first_path"),
        F.max(F.element_at("old_file_paths", -1)).alias("last_path"),
        F.max("old_size_bytes").alias("old_size_bytes"),
    )


@query
def usage_two_level(t):
    levels = usage.usage_two_level(t.inventory(raw=True))
    return levels.withColumn("second_level", F.coalesce("second_level", F.lit("-")))


@query
def usage_top_level(t):
    return usage.usage_top_level(t.inventory(raw=True))


@query
def usage_levels(t):
    levels = usage.usage_levels(t.inventory(raw=True))
    return levels.withColumn("second_level", F.coalesce("second_level", F.lit("-")))


@query
def dir_sizes_depth_n(t):
    return usage.directory_report(t.inventory(), levels=3)


@query
def all_dir_sizes(t):
    return all_directory_sizes(t.inventory())


@query
def listed_dir_sizes(t):
    listed = t.exclusions().unionByName(t.many_exclusions())
    return usage.listed_size_report(t.inventory(), listed).fillna(-1, ["size_bytes"])


@query
def usage_pivot(t):
    return usage.group_wise_usage(t.deep_inventory())


@query
def usage_pivot_bytes(t):
    return usage.group_wise_usage(t.deep_inventory(), teams=["ib", "bm", "fx"], formatted=False)


@query
def report_pivot(t):
    expected = ["/project/abcd/efgh/ijkl/none", "/project/abcd/efgh/ijkl/model"]
    return usage.report_pivot(t.size_lines(), expected=expected)


@query
def top_report(t):
    patterns = [("Models", "(model|mdl)"), ("Flows", "^f|process")]
    return usage.top_report(t.inventory(), patterns=patterns)


@query
def top_child_report(t):
    return usage.top_child_report(t.inventory(), patterns=[("Models", "(model|mdl)"), ("Flows", "^f|process")])


@query
def team_totals(t):
    return usage.team_totals(t.inventory(), patterns=[("Models", "(model|mdl)"), ("Flows", "^f|process")])


@query
def tops_with_children(t):
    tops, _ = tops_and_children(t.inventory(), "/project/abcd")
    return tops


@query
def old_dir_summary(t):
    return usage.old_directory_summary(t.size_lines()).fillna("-", ["base_dir"])


@query
def topk_usage(t):
    sizes = all_directory_sizes(t.inventory())
    return preview(sizes, 50, F.desc("size_bytes"), "path")


@query
def path_distinct(t):
    return directories(t.inventory())


@query
def directories_to_depth(t):
    return directories_at(t.inventory(), "/project/abcd", 1, 2)


@query
def directories_of_interest(t):
    listed = directories_at(t.inventory(), "/project/abcd", 2, 2)
    return retention.in_directories(listed, "/project/abcd", ["model", "alert", "feed", "process"])


@query
def entry_counts(t):
    dirs = directories(t.inventory()).select(F.lit("dir").alias("kind"))
    files = t.inventory().select(F.lit("file").alias("kind"))
    return files.unionByName(dirs).groupBy("kind").agg(F.count("*").alias("entries"))


# ---- functions ---------------------------------------------------------------


@query
def url_levels(t):
    bare = strip_scheme("path")
    return t.urls().select(
        "page_id",
        bare.alias("bare"),
        component(bare, 1).alias("level1"),
        component(bare, 2).alias("level2"),
        component(bare, 5, "unknown").alias("level5"),
        F.coalesce(component(bare, 9), F.lit("-")).alias("level9"),
    )


@query
def path_parts(t):
    path = F.col("path")
    return t.inventory().select(
        "path",
        file_name("path").alias("name"),
        parent("path").alias("parent"),
        depth("path").alias("depth"),
        ancestor(path, 2).alias("second"),
        leading_pieces("path", 6).alias("six"),
        relative_to("path", "/project/abcd").alias("relative"),
        F.coalesce(embedded_date("path"), F.lit("-")).alias("digits"),
        F.coalesce(embedded_month("path"), F.lit("-")).alias("month"),
    )


@query
def path_cleaning(t):
    odd = t.inventory(raw=True).withColumn(
        "path", F.when(F.col("path").contains("/model/"), F.concat("path", F.lit("//"))).otherwise(F.col("path"))
    )
    mounted = F.concat(F.lit("/mnt/project/abcdef"), strip_scheme("path"))
    return odd.select(
        "path",
        strip_scheme("path").alias("bare"),
        normalize("path").alias("norm"),
        rebase("path", "/project/abcd").alias("based"),
        rebase(mounted, "/project/abcd").alias("mounted"),
    )


@query
def size_parse_format(t):
    sized = t.size_lines().withColumns(
        {
            "binary_bytes": parse_size(F.col("size"), 1024),
            "decimal_bytes": parse_size(F.col("size"), 1000),
            "too_large": size_too_large(F.col("size")),
        }
    )
    return sized.select(
        "*",
        format_binary(F.col("binary_bytes")).alias("binary_text"),
        format_si(F.col("decimal_bytes"), "k").alias("si_text"),
        format_si(F.col("binary_bytes"), "K").alias("si_upper"),
        format_cell(F.col("decimal_bytes")).alias("cell"),
    )


@query
def classify_modes(t):
    words = ["ib", "eq", "ld", "bm"]
    keywords = ["bm", "ib", "fx", "fi", "wm", "pcc", "eq"]
    pieces = F.split("path", "/")
    return with_top_and_team(t.size_lines(), keywords).select(
        "path",
        F.col("top_dir").alias("top"),
        "team",
        keyword_in(F.lower(file_name("path")), keywords).alias("by_segment"),
        keyword_in_segments(pieces, 5, keywords).alias("by_segments"),
        word_in(F.col("path"), words).alias("by_word"),
        pattern_in(F.lower("path"), [("First", "/x-(bm|ib)/"), ("Second", "y-(fx|fi)")]).alias("by_pattern"),
    )


# ---- retention ---------------------------------------------------------------


@query
def older_than(t):
    return retention.older_than(t.inventory(), NOW, 2000).select("path", "length")


@query
def before_date(t):
    return retention.before_date(t.inventory(), CUTOFF).select("path", "length")


@query
def date_dirs(t):
    return retention.dated_directories(directories(t.inventory()), 20000101)


@query
def har_before_month(t):
    return retention.archives_before(t.inventory(), 200001).select("path")


@query
def markers_old(t):
    return retention.old_markers(t.inventory(), NOW, 1500).select("path", "age_days")


@query
def prefix_anti_small(t):
    return exclude_below(t.inventory(raw=True), t.exclusions()).select("path", "length")


@query
def prefix_anti_large(t):
    keys = exclusion_keys(t.many_exclusions())
    return anti_join_by_order(t.inventory(raw=True), keys).select("path", "length")


@query
def prefix_anti_nested(t):
    """Exclusions of all depths, one inside the other, and a hot path that a third of the rows share."""
    rows = t.inventory(raw=True)
    hot = F.when(F.col("length") % 3 == 0, F.lit("hdfs://nn:8020/project/abcd/feed/hot")).otherwise(F.col("path"))
    closed = t.many_exclusions().unionByName(t.exclusions())
    return anti_join_by_order(rows.withColumn("path", hot), exclusion_keys(closed)).select("path", "length")


@query
def latest_version(t):
    return latest_versions(version_directories(t.version_dirs()))


@query
def old_version_dirs(t):
    return old_versions(version_directories(t.version_dirs()))


@query
def find_old_local(t):
    extra = t.spark.createDataFrame([("/apps/Brand#4",), ("/apps/Brand#6/",)], "path string")
    closed = t.exclusions().unionByName(extra)
    return retention.find_old(t.application_inventory(), closed, t.versioned_roots(), NOW, 2000)


@query
def find_old_listing(t):
    listing = texts.listing_rows(t.listing_lines())
    return retention.find_old_in_listing(listing, t.exclusions(), NOW, 2000)


@query
def final_list(t):
    scheduled = retention.older_than(t.inventory(raw=True), NOW, 1500)
    dynamic = t.many_exclusions()
    return cleanup.final_list(scheduled.unionByName(scheduled), dynamic, t.exclusions())


@query
def safe_path_rows(t):
    path = F.col("path")
    odd = t.inventory().select(
        F.when(path.contains("/model/"), F.lit(" / "))
        .when(path.contains("/alert/"), F.lit("   "))
        .when(path.contains("/feed/"), F.lit("."))
        .when(path.contains("/process/"), F.lit("/data/keep"))
        .otherwise(F.concat(F.lit("  "), path))
        .alias("path")
    )
    return safe_paths(odd, ("/data/keep",)).groupBy("path").agg(F.count("*").alias("lines"))


@query
def merged_exclusions(t):
    return cleanup.merged_exclusions(t.exclusions(), t.many_exclusions())


@query
def cycle_dates(t):
    cycles = texts.cycle_rows(t.cycle_names()).groupBy("cycle_date").agg(F.count("*").alias("directories"))
    return cycles.select(F.date_format("cycle_date", "yyyy-MM-dd").alias("cycle_date"), "directories")


@query
def cycle_status(t):
    shown = cleanup.cycle_status(t.cycle_names(), CYCLE_NOW)
    return shown.select(
        F.date_format("cycle_date", "yyyy-MM-dd").alias("cycle_date"),
        "days_left",
        "phase",
        F.coalesce(F.date_format("planned_date", "yyyy-MM-dd"), F.lit("-")).alias("planned_date"),
    )


@query
def exact_lookup(t):
    terms = t.many_exclusions().select(F.concat(F.lit(" "), "path").alias("term")).distinct()
    return retention.listed_terms(t.inventory(), terms)


# ---- quota -------------------------------------------------------------------


@query
def quota_report(t):
    return quota.quota_report(t.quota_lines())


@query
def quota_remaining(t):
    return quota.quota_report(t.quota_lines(), fourth_field="remaining")


# ---- ticks -------------------------------------------------------------------


def _ticks(t):
    return interest.with_tick_time(t.tick_rows())


@query
def tick_filter(t):
    kept = extraction.filter_ticks(_ticks(t), interest.interest_windows(t.raw_interest()))
    return kept.withColumn("ts", stamp("ts"))


@query
def ticks_in_any_window(t):
    kept = ticks_in_windows(_ticks(t), interest.interest_windows(t.raw_interest()), slice_seconds=3600)
    return kept.groupBy("sym").agg(F.count("*").alias("ticks"))


@query
def interval_pairs(t):
    pairs = interval_join(_ticks(t), interest.interest_windows(t.raw_interest()))
    return pairs.select("tick_id", "sym", F.col("row_key").alias("window_key"))


@query
def interval_pairs_hot(t):
    """A third of all ticks and windows on one symbol within five minutes."""
    pairs = interval_join(t.hot_ticks(), t.hot_windows())
    return pairs.select("tick_id", "sym", F.col("row_key").alias("window_key"))


@query
def covered_seconds(t):
    ranges = covered_ranges(t.windows())
    length = F.col("to") - F.col("from") + 1
    return ranges.groupBy("sym").agg(F.sum(length).alias("micros"))


@query
def dedup_subset(t):
    return drop_repeats(t.tick_rows())


# ---- requests ----------------------------------------------------------------


@query
def pack_windows_batches(t):
    return pack_windows(t.windows()).select(
        "first_row", stamp("start"), stamp("end"), "rows", F.array_join("syms", ",").alias("syms"), "first_ric"
    )


@query
def pack_windows_by_count(t):
    return pack_windows(t.windows(), max_minutes=600, max_rows=5, block_rows=512).select(
        "first_row", stamp("start"), stamp("end"), "rows", F.array_join("syms", ",").alias("syms"), "first_ric"
    )


@query
def pack_windows_wide(t):
    return pack_windows(t.windows(), max_minutes=60 * 24 * 365, max_rows=100_000).select(
        "first_row", stamp("start"), stamp("end"), "rows", F.array_join("syms", ",").alias("syms"), "first_ric"
    )


@query
def window_requests(t):
    packed = extraction.window_requests(interest.interest_windows(t.raw_interest()))
    return packed.select("position", "first_row", "rows", "request")


@query
def window_requests_by_start(t):
    packed = extraction.window_requests(t.windows(), extraction.BY_START)
    return packed.select("position", "first_row", "rows", "request")


@query
def sym_batches(t):
    batches = symbol_batches(t.raw_interest(), 20)
    return batches.select("batch_id", F.array_join("syms", ",").alias("syms"))


@query
def slot_grid(t):
    days = t.events().select(F.col("ts").cast("date").alias("day")).distinct()
    return day_slots(days, F.col("day"), 7).select(F.col("day").cast("string"), stamp("start"), stamp("end"))


@query
def allday_requests(t):
    return extraction.slot_requests(t.raw_interest(), 240).select("batch_id", "request")


@query
def endpoint_day_requests(t):
    return extraction.endpoint_day_requests(t.raw_interest()).select("batch_id", "day_no", "request")


@query
def all_day_requests(t):
    requests = extraction.endpoint_day_requests(t.raw_interest(), all_days=True)
    return requests.select("batch_id", "day_no", "request")


@query
def templated_requests(t):
    return extraction.templated_requests(t.raw_interest(), TEMPLATE_SETTINGS).select(
        "batch_id", "day_no", "request"
    )


@query
def interest_range(t):
    days = extraction.interest_range(t.raw_interest())
    first = extraction.first_day(t.raw_interest()).scalar()
    return days.select(
        F.date_format("start_day", "yyyy-MM-dd").alias("start_day"),
        F.date_format("end_day", "yyyy-MM-dd").alias("end_day"),
        F.date_format(first, "yyyy-MM-dd").alias("first_day"),
    )


# ---- files: every query writes what Spark derives from the tables and reads it back --


@query
def listing_file(t):
    folder = scratch_folder(t.spark, "listing")
    write_path_list(t.listing_lines(), folder, column="value")
    rows = texts.read_listing(t.spark, folder)
    return rows.select("path", "is_dir", "length", F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("mtime"))


@query
def path_list_file(t):
    folder = scratch_folder(t.spark, "paths")
    write_path_list(t.exclusions(), folder)
    append_path_list(t.many_exclusions().select(F.concat(F.lit("  "), "path", F.lit(" ")).alias("path")), folder)
    append_path_list(t.exclusions(), folder)
    return texts.read_path_list(t.spark, folder)


@query
def manifest_file(t):
    folder = scratch_folder(t.spark, "manifest")
    marked = t.urls().select(
        F.when(F.col("path").contains("page=1"), F.concat(F.lit("#"), "path"))
        .when(F.col("path").contains("/fr/"), F.lit(""))
        .otherwise(F.col("path"))
        .alias("path")
    )
    write_path_list(marked, folder)
    return texts.read_manifest(t.spark, folder)


@query
def size_line_file(t):
    folder = scratch_folder(t.spark, "sizes")
    lines = t.size_lines().select(
        F.when(F.col("path").startswith("/short"), F.col("path"))
        .otherwise(F.concat_ws(",", "path", "size"))
        .alias("path")
    )
    write_path_list(lines, folder)
    return texts.read_size_lines(t.spark, folder)


@query
def quota_file(t):
    folder = scratch_folder(t.spark, "quota")
    write_path_list(t.quota_lines(), folder, column="value")
    return quota.quota_report(texts.read_lines(t.spark, folder))


@query
def size_report_file(t):
    folder = scratch_folder(t.spark, "report")
    write_csv(usage.listed_size_report(t.inventory(), t.exclusions()).select("path", "size"), folder)
    return texts.read_size_report(t.spark, folder)


@query
def single_csv(t):
    folder = scratch_folder(t.spark, "single-report")
    written = publish_csv(usage.usage_by_team(t.inventory(raw=True)), folder, "usage.csv")
    return t.spark.read.csv(
        written, header=True, schema="top_dir string, team string, total_size_bytes bigint, size_human string"
    )


@query
def interest_file(t):
    folder = scratch_folder(t.spark, "interest")
    write_csv(t.interest_csv(), folder)
    by_place = interest.interest_windows(interest.read_raw_interest(t.spark, folder))
    by_name = interest.interest_windows(interest.read_named_interest(t.spark, folder))
    both = by_place.unionByName(by_name)
    return both.groupBy("ric", stamp("start"), stamp("end")).agg(F.count("*").alias("rows"))


@query
def interest_rejects(t):
    return interest.rejected_interest(t.raw_interest())


@query
def tick_file(t):
    folder = scratch_folder(t.spark, "ticks")
    write_csv(t.tick_rows(), folder, mode="errorifexists", partitions=4)
    return interest.read_ticks(t.spark, folder).withColumn("ts", stamp("ts"))


@query
def request_file(t):
    folder = scratch_folder(t.spark, "requests")
    batches = extraction.window_requests(t.windows())
    write_requests(batches, folder)
    return texts.read_numbered_lines(t.spark, folder)


# ---- file-system jobs: on trees that Spark writes from the tables --------------


def _placed(t) -> DataFrame:
    return with_top_and_team(t.inventory(), ["bm", "ib", "fx", "fi", "wm", "pcc"])


def _tree(t) -> str:
    """Text files in top=*/team=* directories: every inventory path is one line of its directory."""
    folder = scratch_folder(t.spark, "tree")
    lines = _placed(t).select(F.col("path").alias("value"), F.col("top_dir").alias("top"), "team")
    # the local file system's checksum files would count as files of the tree
    plain = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    lines.write.options(**plain).partitionBy("top", "team").text(folder)
    return folder


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _relative(column: str, folder: str):
    bare = strip_scheme(column)
    return F.substr(bare, F.lit(len(_local(folder)) + 2))


@query
def live_dir_sizes(t):
    folder = _local(_tree(t))
    place = F.concat(F.lit(f"{folder}/top="), "top_dir", F.lit("/team="), "team")
    known = _placed(t).select(place.alias("path")).distinct()
    tops = known.select(parent("path").alias("path")).distinct()
    gone = t.exclusions().select(F.concat(F.lit(folder), F.lit("/gone"), "path").alias("path")).distinct()
    sizes = cleanup.live_sizes(materialize(known.unionByName(tops).unionByName(gone)))
    return sizes.select(_relative("path", folder).alias("path"), "size_bytes", "status", "size").fillna(-1, ["size_bytes"])


@query
def directory_size_job(t):
    """The job from its settings alone: list, measure, write, and what was written."""
    folder, output = _local(_tree(t)), scratch_folder(t.spark, "dir-sizes")
    settings = {"basePath": folder, "recursiveLevel": "2", "outputPath": output}
    try:
        for name, value in settings.items():
            t.spark.conf.set(f"spark.cleanup.{name}", value)
        jobs.directory_size_job(t.spark)
    finally:
        for name in settings:
            t.spark.conf.unset(f"spark.cleanup.{name}")
    written = t.spark.read.csv(output, header=True, schema="path string, size_bytes bigint, size_human_readable string")
    return written.withColumn("path", _relative("path", folder))


@query
def tree_directories(t):
    folder = _local(_tree(t))
    found = inventory.list_tree(t.spark, folder, max_depth=2).filter(F.col("is_dir"))
    return found.select(_relative("path", folder).alias("path"))


@query
def top_directories(t):
    folder = _local(_tree(t))
    return inventory.one_level_directories(t.spark, folder).select(_relative("path", folder).alias("path"))


@query
def pruned_tree(t):
    folder = _local(_tree(t))
    pruned = t.exclusions().select(
        F.concat(F.lit(f"{folder}/top="), F.split("path", "/")[3], F.lit("/")).alias("path")
    ).filter(~F.col("path").rlike("(model|misc)/$"))
    found = inventory.list_tree(t.spark, folder, pruned=pruned).filter(F.col("path").endswith(".txt"))
    return found.groupBy(_relative(parent("path"), folder).alias("path")).agg(F.sum("length").alias("bytes"))


@query
def binary_file_sizes(t):
    folder = _local(_tree(t))
    found = inventory.binary_listing(t.spark, folder)
    return found.groupBy(_relative(parent(strip_scheme("path")), folder).alias("path")).agg(
        F.sum("length").alias("bytes")
    )


@query
def delete_listed(t):
    folder = _local(_tree(t))
    tops = inventory.one_level_directories(t.spark, folder).filter(F.col("path").rlike("(model|alert)$"))
    gone = t.exclusions().select(F.concat(F.lit(folder), F.lit("/gone"), "path").alias("path")).distinct()
    outside = t.exclusions().select("path").distinct()
    listed = tops.unionByName(gone).unionByName(outside)
    trial = delete_paths(listed, folder, dry_run=True)
    done = delete_paths(listed, folder, dry_run=False)
    left = inventory.one_level_directories(t.spark, folder).withColumn("status", F.lit("left"))
    rows = trial.unionByName(done).unionByName(left)
    shown = F.when(F.col("path").startswith(folder), _relative("path", folder)).otherwise(F.col("path"))
    return rows.select(shown.alias("path"), "status")


def _places(t, folder: str) -> DataFrame:
    """The places of two tops, directories that are not there, and paths outside the folder."""
    place = F.concat(F.lit(f"{folder}/top="), "top_dir", F.lit("/team="), "team")
    there = _placed(t).filter(F.col("top_dir").isin("model", "alert")).select(place.alias("path")).distinct()
    gone = t.exclusions().select(F.concat(F.lit(folder), F.lit("/gone"), "path").alias("path"))
    return materialize(there.unionByName(gone).unionByName(gone).unionByName(t.exclusions().select("path").distinct()))


@query
def delete_resumed(t):
    """One deletion goes through; the other one's tasks fail half-way, and a second run ends it with the first's journal."""

    def stop(path):
        if path.endswith("=fx"):
            raise RuntimeError("stopped by the rehearsal")

    shown = []
    for label in ("plain", "resumed"):
        folder = _local(_tree(t))
        listed, journal = _places(t, folder), scratch_folder(t.spark, "journal")
        if label == "resumed":
            try:
                delete_paths(listed, folder, dry_run=False, journal=journal, before=stop)
                raise AssertionError("the first run was not stopped")
            except PythonException:
                pass
        statuses = delete_paths(listed, folder, dry_run=False, journal=journal)
        left = inventory.list_tree(t.spark, folder, max_depth=2).filter(F.col("is_dir") & F.col("path").contains("/team="))
        rows = statuses.unionByName(left.select("path", F.lit("left").alias("status")))
        bare = F.when(F.col("path").startswith(folder), _relative("path", folder)).otherwise(F.col("path"))
        shown.append(rows.select(F.lit(label).alias("run"), bare.alias("path"), "status"))
    return shown[0].unionByName(shown[1])


@query
def deletion_journal(t):
    """What a deletion wrote down: one intent and one outcome for every path that was there."""
    folder, journal = _local(_tree(t)), scratch_folder(t.spark, "journal")
    delete_paths(_places(t, folder), folder, dry_run=False, journal=journal)
    rows = journal_rows(t.spark, journal).groupBy("path").agg(
        F.count_if(F.col("phase") == "intent").alias("intents"), F.max("status").alias("status"), F.count_distinct("run", "attempt").alias("attempts")
    )
    return rows.withColumn("path", _relative("path", folder))


def _touch_markers(frames):
    """Write a success marker per row, with the time given; on the executors, into the shared folder."""
    for frame in frames:
        for path, seconds in zip(frame["path"], frame["seconds"]):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w"):
                pass
            os.utime(path, (seconds, seconds))
        yield frame[["path"]]


@query
def purge_markers(t):
    """A marker per place and year, as old as the newest file there; the old ones go."""
    folder = _local(scratch_folder(t.spark, "markers"))
    place = F.concat(F.lit(f"{folder}/top="), "top_dir", F.lit("/team="), "team", F.lit("/year="), F.year("mtime"), F.lit("/_SUCCESS"))
    newest = _placed(t).groupBy(place.alias("path")).agg(F.unix_timestamp(F.max("mtime").cast("timestamp")).alias("seconds"))
    materialize(newest.mapInPandas(_touch_markers, "path string"))
    statuses, _ = cleanup.purge_markers(inventory.list_tree(t.spark, folder), NOW, folder, days=1700, dry_run=False)
    left = inventory.list_tree(t.spark, folder).filter(file_name("path") == "_SUCCESS").withColumn("status", F.lit("left"))
    return statuses.unionByName(left.select("path", "status")).select(_relative("path", folder).alias("path"), "status")


@query
def outcome_count(t):
    folder = _local(_tree(t))
    there = inventory.list_tree(t.spark, folder, max_depth=2).filter(F.col("is_dir")).select("path")
    gone = t.many_exclusions().select(F.concat(F.lit(f"{folder}/gone"), "path").alias("path"))
    outside = t.exclusions().select("path")
    return outcome_counts(delete_paths(there.unionByName(gone).unionByName(outside), folder, dry_run=True))


# ---- the same work from text files, and edge settings ---------------------------


@query
def path_list_repeats(t):
    folder = scratch_folder(t.spark, "repeats")
    write_path_list(t.exclusions(), folder)
    append_path_list(t.many_exclusions(), folder)
    append_path_list(t.exclusions(), folder)
    return texts.read_path_list(t.spark, folder, distinct=False).groupBy("path").agg(F.count("*").alias("lines"))


@query
def raw_lines(t):
    folder = scratch_folder(t.spark, "raw-lines")
    write_path_list(t.quota_lines(), folder, column="value")
    return texts.read_lines(t.spark, folder)


@query
def summary_lines(t):
    folder = scratch_folder(t.spark, "summary")
    counted = F.concat_ws("   ", F.col("length").cast("string"), F.lit("12"), "path")
    line = F.when(F.col("path").contains("/alert/"), F.col("path")).when(
        F.col("path").contains("/model/"), F.concat(F.lit("unreadable "), "path")
    ).otherwise(counted)
    write_path_list(t.inventory().select(line.alias("path")), folder)
    return texts.du_rows(texts.read_lines(t.spark, folder))


def _listing_file(t):
    folder = scratch_folder(t.spark, "finder-listing")
    write_path_list(t.listing_lines(), folder, column="value")
    return texts.read_listing(t.spark, folder)


@query
def old_files_in_listing_file(t):
    return retention.before_date(_listing_file(t), CUTOFF).select("path", "length")


@query
def dated_directories_in_listing_file(t):
    return retention.dated_directories(texts.directories_only(_listing_file(t)), 20000101).select("path", "length")


@query
def old_archives_in_listing_file(t):
    return retention.archives_before(texts.files_only(_listing_file(t)), 200001).select("path")


@query
def default_slot_requests(t):
    """Lengths outside a day, and none, mean the usual length."""
    raw = t.raw_interest()
    made = [
        extraction.slot_requests(raw, minutes).select(F.lit(label).alias("minutes"), "batch_id", "request")
        for label, minutes in (("0", 0), ("1441", 1441), ("none", None))
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query
def cycle_phases(t):
    day = lambda name: F.date_format(name, "yyyy-MM-dd").alias(name)
    shown = [
        cleanup.cycle_status(t.cycle_names(), now).select(F.lit(now).alias("moment"), day("cycle_date"), "phase", day("planned_date"))
        for now in CYCLE_MOMENTS
    ]
    return reduce(DataFrame.unionByName, shown)
