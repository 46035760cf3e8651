"""Inputs of the registered queries, derived from the given tables.

`Tables` derives them with Spark; the same shapes are written in SQL in `oracle.py`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowline.session import scratch_folder, use_utc
from stowline.sources.interest import raw_interest

TOP = "CASE {0} % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'alert' WHEN 2 THEN 'feed' WHEN 3 THEN 'process' ELSE 'misc' END"
TEAM = (
    "CASE {0} % 7 WHEN 0 THEN 'bm' WHEN 1 THEN 'ib' WHEN 2 THEN 'fx' WHEN 3 THEN 'fi' WHEN 4 THEN 'wm' "
    "WHEN 5 THEN 'pcc' ELSE 'zz' END"
)
LINE_TOP, LINE_TEAM = TOP.format("l_linenumber"), TEAM.format("l_suppkey")
FILE_TAG = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"


def bare_path(day: str, month: str) -> str:
    """SQL text of a file path, from the engine's own texts for the ship day and month."""
    name = (
        f"CASE WHEN l_orderkey % 50 = 0 THEN 'o' || {FILE_TAG} || '/_SUCCESS' "
        f"WHEN l_orderkey % 70 = 0 THEN 'o' || {FILE_TAG} || '/x' || {month} || '.har' "
        f"ELSE 'o' || {FILE_TAG} || '.csv' END"
    )
    team = f"CASE WHEN l_suppkey % 14 >= 7 THEN upper({LINE_TEAM}) ELSE {LINE_TEAM} END"
    return (
        f"CASE WHEN l_orderkey % 101 = 0 THEN '/data/d' || {FILE_TAG} || '.csv' "
        f"WHEN l_orderkey % 97 = 0 THEN '/project/abcd/' || {LINE_TOP} || '/loose-' || {FILE_TAG} || '.csv' "
        f"ELSE '/project/abcd/' || {LINE_TOP} || '/cd-' || {team} || '-lay/' || {day} || '/' || {name} END"
    )


RAW_PATH = (
    "CASE l_partkey % 11 WHEN 0 THEN 'hdfs://nn:8020' || path WHEN 1 THEN 'file:' || path "
    "WHEN 2 THEN 'file://' || path ELSE path END"
)

EXCLUSION = (
    "CASE n_nationkey % 4 "
    f"WHEN 0 THEN '/project/abcd/' || {TOP.format('n_nationkey')} || '/cd-' || {TEAM.format('n_nationkey')} || '-lay' "
    f"WHEN 1 THEN '/project/abcd/' || {TOP.format('n_nationkey')} || '/cd-' || {TEAM.format('n_nationkey')} || '-lay/' "
    f"WHEN 2 THEN '/project/abcd/' || {TOP.format('n_nationkey')} || '/cd-' || {TEAM.format('n_nationkey')} "
    f"ELSE '/project/abcd/' || {TOP.format('n_nationkey')} || '/cd-' || {TEAM.format('n_nationkey')} || '-lay/' "
    "|| (1995 + n_nationkey % 5) || '0103' END"
)


def order_exclusion(day: str) -> str:
    return f"'/project/abcd/' || {TOP.format('o_orderkey')} || '/cd-' || {TEAM.format('o_custkey')} || '-lay/' || {day}"


def cycle_name(day: str, year: str) -> str:
    """Names of cycle directories, some with an impossible date or another prefix."""
    return (
        f"CASE o_orderpriority WHEN '1-URGENT' THEN 'scheduled_deletion_' || {year} || '1399' "
        f"WHEN '2-HIGH' THEN 'scheduled_' || {day} ELSE 'scheduled_deletion_' || {day} END"
    )


VERSION_PARENT = "'/apps/' || p_brand"
VERSION_NAME = (
    "CASE WHEN p_partkey % 17 = 0 THEN 'v' || p_size "
    "WHEN p_partkey % 19 = 0 THEN '0' || p_size || '.' || p_partkey % 7 "
    "WHEN p_partkey % 23 = 0 THEN '' || p_size "
    "WHEN p_partkey % 29 = 0 THEN p_size || '.' || p_partkey % 7 || '.0' "
    "ELSE p_size || '.' || p_partkey % 7 END"
)

SIZE_PATH = (
    "CASE WHEN o_orderkey % 43 = 0 THEN '/short/' || o_orderkey "
    f"ELSE '/project/abcd/efgh/ijkl/' || {TOP.format('o_orderkey')} || '/x-' || {TEAM.format('o_custkey')} "
    f"|| '/Y-' || {TEAM.format('o_orderkey')} || '-' || o_orderkey END"
)
SIZE_TEXT = (
    "CASE WHEN o_orderkey % 37 = 0 THEN 'INVALID_PATH' WHEN o_orderkey % 53 = 0 THEN 'x GB' "
    "WHEN o_orderkey % 59 = 0 THEN '5GB' WHEN o_orderkey % 61 = 0 THEN (9000000 + o_custkey) || '.7 TB' "
    "WHEN o_orderkey % 67 = 0 THEN (80000 + o_custkey % 100) || '.3e6 GB' WHEN o_orderkey % 71 = 0 THEN '1e40 TB' "
    "ELSE (o_custkey % 100) || '.' || (o_orderkey % 10) || ' ' || "
    "CASE o_orderkey % 7 WHEN 0 THEN 'B' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' WHEN 3 THEN 'GB' WHEN 4 THEN 'TB' "
    "WHEN 5 THEN 'gb' ELSE 'XB' END END"
)

QUOTA_LINE = (
    "CASE WHEN c_custkey % 50 = 0 THEN 'none inf none inf 1 2 3 /p/unset' || c_custkey "
    "WHEN c_custkey % 61 = 0 THEN '10 5 100 50 /p/short' || c_custkey "
    "ELSE '  ' || CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1000 WHEN 2 THEN 2000 ELSE 5000 END || '   ' "
    "|| (c_custkey % 777) || ' ' || ((c_custkey % 3) * 9999999999971) || ' ' "
    "|| CAST(floor(abs(c_acctbal) * 1000000007.0) AS BIGINT) || ' ' || c_nationkey || ' 12 99 /project/c' || c_custkey "
    "|| CASE WHEN c_custkey % 67 = 0 THEN ' extra' ELSE '' END END"
)

RIC = (
    "CASE WHEN event_id % 53 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN ' \"U' || user_id || '\" ' "
    "ELSE 'U' || user_id END"
)
WINDOW_SECONDS = "(60 + event_id % 120)"


HOT_SYM = "CASE WHEN event_id % 3 = 0 THEN 'HOT' ELSE 'U' || user_id END"
HOT_MILLIS = "CASE WHEN event_id % 300 = 0 THEN 20000 ELSE 20 + event_id % 60 END"


def hot_time(otherwise: str, step: str) -> str:
    """SQL text: for a third of the events an instant within five minutes, for some of them the same one."""
    millis = f"CASE WHEN event_id % 30 = 0 THEN 1000 ELSE event_id * {step} % 300000 END"
    return f"CASE WHEN event_id % 3 = 0 THEN timestamp_millis(1600000200000 + {millis}) ELSE {otherwise} END"


_STORED: dict[tuple, str] = {}


def spread_small(rows: DataFrame) -> DataFrame:
    """Rows that fewer tasks than there are cores would read, dealt out to all of them; others as they lie.

    Spark reads such tables in splits of 4 MB (spark.sql.files.openCostInBytes), so what is shuffled is bounded; large
    tables are never shuffled just to be stored.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def stored(build):
    """Write a derived input once per session and folder of tables, and read it as a table from then on."""

    @functools.wraps(build)
    def read(self, *args):
        key = (self.spark.sparkContext.applicationId, self.folder, build.__name__, *args)
        if key not in _STORED:
            path = scratch_folder(self.spark, f"input-{build.__name__}")
            spread_small(build(self, *args)).write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    return read


class Tables:
    """The derived inputs over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = use_utc(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def inventory(self, raw: bool = False) -> DataFrame:
        """File inventory from `lineitem`; `raw` puts schemes before some paths."""
        return self._inventory(raw)

    @stored
    def _inventory(self, raw: bool) -> DataFrame:
        path = bare_path("date_format(l_shipdate, 'yyyyMMdd')", "date_format(l_shipdate, 'yyyyMM')")
        rows = self.table("lineitem").selectExpr(
            f"{path} AS path",
            "CAST(round(l_extendedprice * 100) AS BIGINT) AS length",
            "l_shipdate AS mtime",
            "false AS is_dir",
            "l_partkey",
        )
        return (rows.withColumn("path", F.expr(RAW_PATH)) if raw else rows).drop("l_partkey")

    @stored
    def deep_inventory(self) -> DataFrame:
        """The inventory moved two directories down."""
        deep = F.regexp_replace("path", "^/project/abcd/", "/project/abcd/efgh/ijkl/")
        return self.inventory().withColumn("path", deep)

    @stored
    def exclusions(self) -> DataFrame:
        return self.table("nation").selectExpr(f"{EXCLUSION} AS path")

    @stored
    def many_exclusions(self) -> DataFrame:
        """Date directories from `orders` and the inventory's oldest files."""
        dirs = self.table("orders").selectExpr(f"{order_exclusion("date_format(o_orderdate, 'yyyyMMdd')")} AS path")
        files = self.inventory().filter(F.col("mtime") < F.lit("1996-01-01").cast("timestamp_ntz")).select("path")
        return dirs.unionByName(files)

    @stored
    def version_dirs(self) -> DataFrame:
        rows = self.table("part").selectExpr(f"{VERSION_PARENT} AS parent", f"{VERSION_NAME} AS name").distinct()
        return rows.select(F.concat_ws("/", "parent", "name").alias("path"), F.lit(True).alias("is_dir"))

    @stored
    def application_inventory(self) -> DataFrame:
        """The inventory, the version directories and old files inside and beside them."""
        dirs = self.version_dirs().selectExpr("path", "0L AS length", "TIMESTAMP_NTZ'1990-01-01' AS mtime", "is_dir")
        files = self.table("part").selectExpr(
            f"{VERSION_PARENT} || CASE WHEN p_partkey % 2 = 0 THEN '/' || {VERSION_NAME} ELSE '.d' END"
            " || '/f' || p_partkey AS path",
            "1L AS length",
            "TIMESTAMP_NTZ'1990-01-01' AS mtime",
            "false AS is_dir",
        )
        return self.inventory().unionByName(dirs).unionByName(files)

    def versioned_roots(self) -> DataFrame:
        return self.table("part").selectExpr(
            f"{VERSION_PARENT} || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END AS path"
        ).filter(F.col("path").rlike("[02468]/?$")).distinct()

    @stored
    def size_lines(self) -> DataFrame:
        return self.table("orders").selectExpr(f"{SIZE_PATH} AS path", f"{SIZE_TEXT} AS size")

    def quota_lines(self) -> DataFrame:
        return self.table("customer").selectExpr(f"{QUOTA_LINE} AS value")

    @stored
    def listing_lines(self) -> DataFrame:
        """Recursive-listing text: files, directory lines beside those of `model`, lines to skip."""
        rows = self.inventory()
        files = rows.select(
            F.concat(
                F.lit("-rw-r--r--   3 u g "),
                F.col("length").cast("string"),
                F.date_format("mtime", "' 'yyyy-MM-dd HH:mm' '"),
                F.col("path"),
                F.when(F.col("path").contains("/alert/"), F.lit(" copy 2")).otherwise(F.lit("")),
            ).alias("value")
        )
        dirs = rows.filter(F.col("path").contains("/model/")).select(
            F.concat(
                F.lit("drwxr-xr-x   - u g          0"),
                F.date_format("mtime", "' 'yyyy-MM-dd HH:mm' '"),
                F.regexp_replace("path", "/[^/]*$", ""),
            ).alias("value")
        )
        odd = rows.filter(F.col("path").endswith(".har")).select(
            F.concat(F.lit("-rw-r--r-- 3 u g 1 2022-99-01 00:00 "), F.col("path")).alias("value")
        )
        short = rows.filter(F.col("path").endswith("_SUCCESS")).select(
            F.concat(F.lit("Found items "), F.col("path")).alias("value")
        )
        return files.unionByName(dirs).unionByName(odd).unionByName(short)

    def cycle_names(self) -> DataFrame:
        return self.table("orders").selectExpr(
            f"{cycle_name("date_format(o_orderdate, 'yyyyMMdd')", "date_format(o_orderdate, 'yyyy')")} AS name"
        )

    def events(self, kind: str | None = None) -> DataFrame:
        rows = self.table("events")
        return rows.filter(F.col("event_type") == kind) if kind else rows

    @stored
    def windows(self) -> DataFrame:
        """A window per event."""
        return self.events().selectExpr(
            "event_id AS row_key",
            "'U' || user_id AS ric",
            "CAST(ts AS TIMESTAMP) AS start",
            f"CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, 0, {WINDOW_SECONDS}) AS end",
        )

    @stored
    def hot_ticks(self) -> DataFrame:
        return self.events().selectExpr(f"{HOT_SYM} AS sym", f"{hot_time('CAST(ts AS TIMESTAMP)', '7919')} AS ts", "event_id AS tick_id")

    @stored
    def hot_windows(self) -> DataFrame:
        start = hot_time("CAST(ts AS TIMESTAMP)", "104729")
        rows = self.events().selectExpr("event_id AS row_key", f"{HOT_SYM} AS ric", f"{start} AS start", f"{HOT_MILLIS} AS length")
        return rows.select("row_key", "ric", "start", F.expr("start + make_dt_interval(0, 0, 0, length / 1000.0)").alias("end"))

    @stored
    def interest_csv(self) -> DataFrame:
        """An interest row per event as CSV columns, with quoted, blank and unreadable fields."""
        end = f"ts + make_dt_interval(0, 0, 0, {WINDOW_SECONDS})"
        iso = "yyyy-MM-dd''T''HH:mm:ss.SSS''Z''"
        return self.events().selectExpr(
            "event_type AS c0",
            "event_id AS c1",
            f"{RIC} AS RIC",
            "'' AS c3",
            "'' AS c4",
            f"date_format(ts, '{iso}') AS Execution_Start_Time",
            f"CASE WHEN event_id % 41 = 0 THEN 'bad' ELSE date_format({end}, '{iso}') END AS Execution_End_Time",
        )

    def raw_interest(self) -> DataFrame:
        rows = self.interest_csv()
        return raw_interest(rows, "RIC", "Execution_Start_Time", "Execution_End_Time", F.col("c1"))

    @stored
    def tick_rows(self) -> DataFrame:
        """Tick text columns; clicks come twice."""
        columns = [
            "date_format(ts, 'yyyy-MM-dd') AS date_column",
            "date_format(ts, 'HH:mm:ss.SSS') AS time_column",
            "'U' || user_id AS sym",
            "CAST(event_id AS STRING) AS tick_id",
            "CAST(value AS STRING) AS price",
        ]
        return self.events().unionByName(self.events("click")).selectExpr(*columns)

    def urls(self) -> DataFrame:
        return self.table("pages").select("page_id", F.col("url").alias("path"))
