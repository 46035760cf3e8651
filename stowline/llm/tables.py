"""Reading the tables, and tables written to the folder all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from stowline.session import scratch_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet under spark.checkpoint.dir and read back: later jobs and retries read the files."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, as a URI that pyarrow's file systems understand."""
    folder = scratch_folder(spark, name)
    return "file://" + os.path.abspath(folder) if "://" not in folder and not folder.startswith("file:") else folder


def attempt_file(folder: str, stem: str, suffix: str) -> str:
    """A name of its own for every task attempt, so a retried or doubled task never overwrites a file."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def opened(uri: str):
    """(file system, path inside it) of a URI."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)
