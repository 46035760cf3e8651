"""Recursive directory sizes and directory listings from a file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowline.fixed_values import SIZE_INVALID
from stowline.functions.paths import ancestor, ancestors, depth, is_under, normalize, parent, strip_scheme
from stowline.functions.staging import once
from stowline.operators.subtrees import subtree_parts
from stowline.session import is_small, materialize


def _owned(inventory: DataFrame, base: str | None = None) -> DataFrame:
    """(directory, bytes) of each row: a directory row stands for itself, a file for its parent."""
    bytes_ = F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("length"))
    bare = inventory.select(strip_scheme("path").alias("_bare"), "is_dir", bytes_.cast("bigint").alias("_bytes"))
    norm = bare.select(normalize("_bare").alias("_bare"), "is_dir", "_bytes")
    owner = F.when(F.col("is_dir"), F.col("_bare")).otherwise(parent("_bare"))
    owned = once(norm, _dir=owner).select("_dir", "_bytes")
    return owned if base is None else owned.filter(is_under("_dir", base))


def _levels(base: str) -> int:
    return len([part for part in base.split("/") if part])


def spread(df: DataFrame, directories: Column, keep: list[str] | None = None) -> DataFrame:
    """One row per element of `directories` as `path`.

    The outer form, because for the inner one Spark pushes a size test below and works the
    array out twice. Rows without an element leave through the NULL test.
    """
    rows = df.select(F.explode_outer(directories).alias("path"), *(keep or []))
    return rows.filter(F.col("path").isNotNull())


def directory_sizes(inventory: DataFrame, base: str, levels: int = 1) -> DataFrame:
    """Bytes below every directory 1..levels under `base`; empty directories listed in the inventory give 0.

    Rows are first summed at the deepest reported level, so only directories, not files,
    are spread over their ancestors.
    """
    if levels < 1:
        return _owned(inventory).select(F.col("_dir").alias("path"), F.col("_bytes").alias("size_bytes")).limit(0)
    first, last = _levels(base) + 1, _levels(base) + levels
    deepest = (
        _owned(inventory, base)
        .groupBy(ancestor("_dir", last).alias("_dir"))
        .agg(F.sum("_bytes").alias("_bytes"))
    )
    return (
        spread(deepest, ancestors("_dir", first, last), ["_bytes"])
        .groupBy("path")
        .agg(F.sum("_bytes").alias("size_bytes"))
    )


def all_directory_sizes(inventory: DataFrame) -> DataFrame:
    """Bytes below every directory of the inventory."""
    own = _owned(inventory).groupBy("_dir").agg(F.sum("_bytes").alias("_bytes"))
    return subtree_parts(own).groupBy("path").agg(F.sum("_bytes").alias("size_bytes"))


def listed_sizes(inventory: DataFrame, listed: DataFrame, column: str = "path") -> DataFrame:
    """(path, size_bytes, status) for every listed line, repeats kept; unknown directories are invalid.

    Only directories that are listed go on to the second sum. Few listed ones are broadcast and met before any
    further shuffle; for many the sums come from the path order, so no row is shuffled once per ancestor.
    """
    wanted = listed.select(F.col(column).alias("path"), normalize(strip_scheme(column)).alias("_dir"))
    keys = materialize(wanted.select("_dir").distinct())
    own = _owned(inventory).groupBy("_dir").agg(F.sum("_bytes").alias("_bytes"))
    few = is_small(keys)
    parts = spread(own, ancestors("_dir"), ["_bytes"]) if few else subtree_parts(own)
    met = F.broadcast(keys) if few else keys.hint("merge")
    hits = parts.withColumnRenamed("path", "_dir").join(met, "_dir", "left_semi")
    sizes = hits.groupBy("_dir").agg(F.sum("_bytes").alias("size_bytes"))
    return wanted.join(sizes.hint("merge"), "_dir", "left").select(
        "path",
        "size_bytes",
        F.when(F.col("size_bytes").isNull(), F.lit(SIZE_INVALID)).otherwise(F.lit("OK")).alias("status"),
    )


def directories(inventory: DataFrame) -> DataFrame:
    """Distinct directories that hold an inventory row at any depth."""
    own = _owned(inventory).select("_dir").distinct()
    return spread(own, ancestors("_dir")).distinct()


def directories_at(inventory: DataFrame, base: str, first: int = 1, last: int = 1) -> DataFrame:
    """Directories `first`..`last` levels under `base`."""
    level = _levels(base)
    own = _owned(inventory, base).select(ancestor("_dir", level + last).alias("_dir")).distinct()
    return spread(own, ancestors("_dir", level + first, level + last)).distinct()


def tops_and_children(inventory: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(top directories with bytes, second-level directories with bytes and their top).

    Both come from one aggregate; neither filters on its keys, so Spark runs it once.
    """
    level = _levels(base)
    owned = _owned(inventory, base).withColumn("_depth", depth("_dir")).filter(F.col("_depth") > level)
    second = F.when(F.col("_depth") > level + 1, ancestor("_dir", level + 2))
    pairs = owned.groupBy(ancestor("_dir", level + 1).alias("top"), second.alias("child")).agg(
        F.sum("_bytes").alias("bytes"), F.max((F.col("_depth") > level + 1).cast("int")).alias("is_child")
    )
    tops = pairs.groupBy("top").agg(F.sum("bytes").alias("top_bytes"), F.sum("is_child").alias("children"))
    return tops, pairs.filter(F.col("is_child") == 1).select("top", "child", F.col("bytes").alias("child_bytes"))
