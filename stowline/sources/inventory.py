"""File inventories: (path, is_dir, length, mtime[, error])."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stowline.functions.paths import ancestors, identity, normalize, parent
from stowline.operators.prefix import exclude_below, exclusion_keys
from stowline.session import joinable, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("mtime", T.TimestampType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)
TASKS_PER_CORE = 4
PATHS_PER_TASK = 2_000
_ROWS_PER_FRAME = 50_000


def open_path(uri: str, opened: dict):
    """(file system, path inside it, text to put before its paths); handles are kept per prefix."""
    import pyarrow.fs as pafs

    if uri.startswith("/"):
        return opened.setdefault("", pafs.LocalFileSystem()), uri, ""
    inner = uri.split(":", 1)[1]
    inside = "/" + inner[2:].partition("/")[2] if inner.startswith("//") else inner
    prefix = uri[: len(uri) - len(inside)]
    if prefix not in opened:
        opened[prefix] = pafs.FileSystem.from_uri(uri)[0]
    return opened[prefix], inside, prefix


def _row(info, prefix: str) -> list[tuple]:
    import pyarrow.fs as pafs

    if info.type == pafs.FileType.Directory:
        return [(prefix + info.path, True, 0, info.mtime, None)]
    if info.type == pafs.FileType.File:
        return [(prefix + info.path, False, info.size or 0, info.mtime, None)]
    return []


def _roots(uri: str, opened: dict) -> list[tuple]:
    """The path's own row; a missing path has none."""
    fs, inside, prefix = open_path(uri, opened)
    return _row(fs.get_file_info(inside), prefix)


def _children(uri: str, opened: dict) -> list[tuple]:
    import pyarrow.fs as pafs

    fs, inside, prefix = open_path(uri, opened)
    return [row for info in fs.get_file_info(pafs.FileSelector(inside)) for row in _row(info, prefix)]


def _list_job(rows_of):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict = {}
        columns = ["path", "is_dir", "length", "mtime", "error"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            return out.assign(mtime=pd.to_datetime(out["mtime"], utc=True))

        pending: list[tuple] = []
        for directories in frames:
            for uri in directories["path"]:
                try:
                    pending.extend(rows_of(uri, opened))
                except Exception as problem:
                    # one unreadable directory becomes a row of its own and never fails the job
                    pending.append((uri, True, 0, None, str(problem) or type(problem).__name__))
                if len(pending) >= _ROWS_PER_FRAME:
                    for first in range(0, len(pending), _ROWS_PER_FRAME):
                        yield frame(pending[first : first + _ROWS_PER_FRAME])
                    pending = []
        if pending:
            yield frame(pending)

    return run


def qualify(spark: SparkSession, path: str) -> str:
    """Put the cluster's default file system before a bare path, unless it is the local one."""
    return default_file_system(spark) + path if path.startswith("/") else path


def default_file_system(spark: SparkSession) -> str:
    """The default file system of the Hadoop configuration; empty when it is local."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or ""
    return "" if default.startswith("file:") else default.rstrip("/")


def qualified(spark: SparkSession, path: Column | str) -> Column:
    """`qualify` for a column."""
    column = F.col(path) if isinstance(path, str) else path
    default = default_file_system(spark)
    return F.when(column.startswith("/"), F.concat(F.lit(default), column)).otherwise(column) if default else column


def spread_tasks(paths: DataFrame, rows: int) -> DataFrame:
    """Hash the paths over several tasks per core: fewer when there are only a few paths, more when a task would get too many."""
    tasks = paths.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE
    return paths.repartition(max(1, min(tasks, rows), -(-rows // PATHS_PER_TASK)), "path")


def list_tree(
    spark: SparkSession,
    roots: DataFrame | Sequence[str] | str,
    pruned: DataFrame | None = None,
    max_depth: int | None = None,
    with_roots: bool = False,
) -> DataFrame:
    """Everything below the root directories, listed on the executors one level at a time.

    Each level's directories are spread evenly over the tasks, so one deep or wide branch
    does not end in one task. Every level is stored, so retries and later reads see one
    snapshot. Subtrees of `pruned` paths are never visited. Missing roots give no rows; an
    unreadable directory gives a row with `error` set.
    """
    if isinstance(roots, DataFrame):
        frontier = outermost(roots.withColumn("path", qualified(spark, "path")))
    else:
        given = [roots] if isinstance(roots, str) else list(roots)
        rows = [(qualify(spark, path),) for path in given]
        frontier = outermost(spark.createDataFrame(rows, "path string"))
    closed = None
    if pruned is not None:
        frontier = exclude_below(frontier, pruned)
        # nothing below an excluded directory is visited, so equality is enough from here on
        closed = joinable(exclusion_keys(pruned).select("_key"))
    jobs = _list_job(_roots), _list_job(_children)
    own = materialize(spread_tasks(frontier, frontier.count()).mapInPandas(jobs[0], INVENTORY))
    found = own.filter(F.col("error").isNotNull() | (F.col("is_dir") & F.lit(with_roots)))
    frontier, level = _walkable(own), 0
    while max_depth is None or level < max_depth:
        waiting = frontier.count()
        if waiting == 0:
            break
        listed = spread_tasks(frontier, waiting).mapInPandas(jobs[1], INVENTORY)
        if closed is not None:
            listed = listed.join(closed, identity("path") == F.col("_key"), "left_anti")
        listed = materialize(listed)
        found = found.unionByName(listed)
        frontier, level = _walkable(listed), level + 1
    return found


def _walkable(listed: DataFrame) -> DataFrame:
    return listed.filter(F.col("is_dir") & F.col("error").isNull()).select("path")


def outermost(roots: DataFrame) -> DataFrame:
    """Distinct roots that are not below another root, so that no tree is walked twice."""
    given = materialize(roots.select(normalize("path").alias("path")).distinct())
    path = F.col("path")
    over = ancestors(parent(path))
    over = F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), over)).otherwise(over)
    above = given.filter(path != "/").select("path", F.explode_outer(over).alias("outer"))
    outer = joinable(given.select(F.col("path").alias("outer")))
    inner = materialize(above.join(outer, "outer", "left_semi").select("path").distinct())
    return given.join(joinable(inner), "path", "left_anti")


def one_level_directories(spark: SparkSession, base: str) -> DataFrame:
    """Immediate subdirectories; a missing base has none."""
    return list_tree(spark, base, max_depth=1).filter(F.col("is_dir") & F.col("error").isNull()).select("path")


def binary_listing(spark: SparkSession, base: str) -> DataFrame:
    """(path, length) from the built-in file source, content unread. Hidden and empty files do not show."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")


def inventory_from_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A small inventory from driver rows (path, is_dir, length, mtime)."""
    schema = T.StructType([field for field in INVENTORY if field.name != "error"])
    return spark.createDataFrame(rows, schema)
