"""Deletes as a distributed job."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowline.fixed_values import (
    DELETE_ERROR_PREFIX,
    DELETE_FAILED,
    DELETE_MISSING,
    DELETED_DIRECTORY,
    DELETED_FILE,
)
from stowline.functions.paths import identity, is_under
from stowline.session import joinable, materialize, scratch_folder
from stowline.sources.inventory import open_path, qualified, qualify, spread_tasks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WOULD_DELETE_DIRECTORY = "Directory Would Be Deleted"
WOULD_DELETE_FILE = "File Would Be Deleted"
JOURNAL_CHUNK = 500  # paths between two journal files
_JOURNAL = "path string, is_dir boolean, status string, attempt string, phase string"
OUTSIDE_ROOT = DELETE_ERROR_PREFIX + "outside the allowed root"


def safe_paths(paths: DataFrame, protected: tuple[str, ...] = (), column: str = "path") -> DataFrame:
    """Trimmed paths without blanks, `/`, `.` and the protected ones (exact match)."""
    trimmed = F.regexp_replace(F.col(column), "^\\s+|\\s+$", "")
    cleaned = paths.withColumn(column, trimmed)
    return cleaned.filter(~F.col(column).isin("", "/", ".", *protected))


def _kind_of(uri: str, opened: dict):
    """Whether the path is a directory (True), a file (False) or missing (None)."""
    import pyarrow.fs as pafs

    fs, inside, _ = open_path(uri, opened)
    kind = fs.get_file_info(inside).type
    return None if kind == pafs.FileType.NotFound else kind == pafs.FileType.Directory


def _delete_one(uri: str, is_dir: bool, opened: dict) -> str:
    import pyarrow.fs as pafs

    fs, inside, _ = open_path(uri, opened)
    if is_dir:
        fs.delete_dir(inside)
    else:
        fs.delete_file(inside)
    if fs.get_file_info(inside).type != pafs.FileType.NotFound:
        return DELETE_FAILED
    return DELETED_DIRECTORY if is_dir else DELETED_FILE


class _Journal:
    """What this task's attempts meant to delete and have deleted, as JSON lines in the shared folder.

    An attempt writes its intents before the deletes of a chunk and the outcomes after them, into files of its own.
    `earlier` holds what other attempts of the task wrote: path -> (was a directory, status or None).
    """

    def __init__(self, folder: str, opened: dict) -> None:
        from pyspark import TaskContext

        context = TaskContext.get()
        self.folder, self.opened = folder, opened
        self.part = f"part-{context.partitionId() if context else 0:06d}"
        self.attempt = f"{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex}"
        self.files = 0
        self.claimed: set[str] = set()
        self.earlier = self.read()

    def read(self) -> dict[str, tuple[bool, str | None]]:
        import pyarrow.fs as pafs

        fs, inside, _ = open_path(f"{self.folder}/{self.part}", self.opened)
        found: dict[str, tuple[bool, str | None]] = {}
        for info in sorted(fs.get_file_info(pafs.FileSelector(inside, allow_not_found=True)), key=lambda info: info.path):
            if not info.path.endswith(".json") or info.base_name.startswith(self.attempt):
                continue
            with fs.open_input_stream(info.path) as stream:
                for line in stream.readall().decode().splitlines():
                    row = json.loads(line)
                    was, status = found.get(row["path"], (row["is_dir"], None))
                    found[row["path"]] = (was, row["status"] or status)
        return found

    def removed(self, path: str, was: bool | None) -> str | None:
        """The status of a missing path that another attempt or run removed; for its first row only."""
        if path in self.claimed:
            return None
        is_dir, status = self.earlier.get(path, (was, None))
        if is_dir is None:
            return None
        self.claimed.add(path)
        return status or (DELETED_DIRECTORY if is_dir else DELETED_FILE)

    def write(self, phase: str, rows: list[tuple[str, bool, str | None]]) -> None:
        if not rows:
            return
        fs, inside, _ = open_path(f"{self.folder}/{self.part}", self.opened)
        fs.create_dir(inside, recursive=True)
        name = f"{inside}/{self.attempt}-{self.files:06d}-{phase}"
        self.files += 1
        lines = [json.dumps({"path": path, "is_dir": is_dir, "status": status, "attempt": self.attempt, "phase": phase}) for path, is_dir, status in rows]
        # readers take whole files only
        with fs.open_output_stream(f"{name}.open") as stream:
            stream.write("".join(line + "\n" for line in lines).encode())
        fs.move(f"{name}.open", f"{name}.json")


def _delete_job(dry_run: bool, journal: str, before: Callable[[str], None] | None = None):
    def chunk(paths: list[str], allowed: list[bool], was: list, book: _Journal | None, opened: dict) -> list[str]:
        """Statuses of some paths; a path that an earlier attempt removed is reported as that attempt would have done."""
        statuses, plan = [], []
        for path, inside in zip(paths, allowed):
            try:
                plan.append(_kind_of(path, opened) if inside else None)
                statuses.append(None if inside else OUTSIDE_ROOT)
            except Exception as problem:
                plan.append(None)
                statuses.append(DELETE_ERROR_PREFIX + str(problem))
        if dry_run:
            texts = {None: DELETE_MISSING, True: WOULD_DELETE_DIRECTORY, False: WOULD_DELETE_FILE}
            return [status or texts[is_dir] for status, is_dir in zip(statuses, plan)]
        book.write("intent", [(path, is_dir, None) for path, is_dir in zip(paths, plan) if is_dir is not None])
        done: list[tuple[str, bool, str | None]] = []
        fresh = False
        for at, (path, is_dir) in enumerate(zip(paths, plan)):
            if statuses[at]:
                continue
            if is_dir is not None and before is not None:
                before(path)
            try:
                if is_dir is not None:
                    is_dir = _kind_of(path, opened)  # an earlier row of the list may have taken it along
                if is_dir is None:
                    if not fresh and path not in book.earlier:  # another attempt may run at the same time
                        book.earlier, fresh = book.read(), True
                    statuses[at] = book.removed(path, was[at]) or DELETE_MISSING
                    continue
                book.claimed.add(path)
                statuses[at] = _delete_one(path, is_dir, opened)
                done.append((path, is_dir, statuses[at]))
            except Exception as problem:
                statuses[at] = DELETE_ERROR_PREFIX + str(problem)
        book.write("outcome", done)
        return statuses

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict = {}
        book = None if dry_run else _Journal(journal, opened)
        for frame in frames:
            frame = frame.astype({"was": object}).where(frame.notna(), None)
            for first in range(0, len(frame), JOURNAL_CHUNK):
                some = frame.iloc[first : first + JOURNAL_CHUNK]
                statuses = chunk(some["path"].tolist(), some["allowed"].tolist(), some["was"].tolist(), book, opened)
                yield pd.DataFrame({"path": some["path"], "status": statuses})

    return run


def journal_rows(spark: SparkSession, journal: str) -> DataFrame:
    """(run, part, attempt, phase, path, is_dir, status) of every line that the runs of a journal wrote; none without runs."""
    try:
        lines = spark.read.schema(_JOURNAL).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(journal)
    except AnalysisException:
        return spark.createDataFrame([], f"run string, part string, {_JOURNAL}")
    place = F.split(F.input_file_name(), "/")
    return lines.select(F.get(place, F.size(place) - 3).alias("run"), F.get(place, F.size(place) - 2).alias("part"), "*")


def journal_statuses(spark: SparkSession, journal: str) -> DataFrame:
    """(path, is_dir, status, attempts): one row per path that some attempt meant to delete.

    The status is that of an outcome, else null: the attempt ended between the intent and the outcome.
    """
    rows = journal_rows(spark, journal)
    deleted = F.max(F.when(F.col("status").isin(DELETED_DIRECTORY, DELETED_FILE), F.col("status")))
    return rows.groupBy("path").agg(
        F.bool_or("is_dir").alias("is_dir"), F.coalesce(deleted, F.max("status")).alias("status"), F.count_distinct("attempt").alias("attempts")
    )


def delete_paths(
    paths: DataFrame,
    allowed_root: str,
    dry_run: bool = True,
    protected: tuple[str, ...] = (),
    journal: str | None = None,
    before: Callable[[str], None] | None = None,
) -> DataFrame:
    """(path, status) per listed path; directories go with everything below them.

    Runs once, here: the statuses are stored, so reading the result again deletes nothing. Only paths strictly below
    `allowed_root` and without `..` are touched.

    Every attempt of a task writes what it is about to delete, and then what it deleted, below `journal` (a folder that all
    executors share; one of its own by default). A retried task, and a new run with the journal of one that was cut off,
    therefore report paths that are gone by their own deletes as deleted, not as missing. Rows of one path go to one task;
    of several rows of a path the first one is reported as deleted. `before` is called on the executor before each delete;
    what it raises stops the task.
    """
    spark = paths.sparkSession
    root = qualify(spark, allowed_root).rstrip("/")
    safe = safe_paths(paths.select("path"), protected)
    # protected paths are met under any spelling; bare paths belong to the cluster's default file system
    safe = safe.filter(~identity("path").isin("/", *(path.rstrip("/") or "/" for path in protected)))
    safe = safe.withColumn("path", qualified(spark, "path"))
    inside = is_under("path", root) & (F.rtrim("path", F.lit("/")) != root) & ~F.col("path").rlike("(^|/)[.][.](/|$)")
    listed = safe.withColumn("allowed", inside)
    if journal is None or dry_run:
        listed = listed.withColumn("was", F.lit(None).cast("boolean"))
    else:
        known = journal_statuses(spark, journal).select("path", F.col("is_dir").alias("was"))
        listed = listed.join(joinable(materialize(known)), "path", "left")
    listed = materialize(listed.select("path", "allowed", "was"))
    spread = spread_tasks(listed, listed.count())
    folder = f"{journal or scratch_folder(spark, 'deletions')}/run-{uuid.uuid4().hex}"
    return materialize(spread.mapInPandas(_delete_job(dry_run, folder, before), "path string, status string"))


def outcome_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("paths"))
