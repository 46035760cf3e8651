"""Highest and superseded version directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowline.fixed_values import VERSION_PATTERN
from stowline.functions.paths import file_name, parent


def version_key(name: Column) -> Column:
    """Numbers of a version name in order; arrays compare element by element, shorter first.

    A number of any length is its count of digits, then the digits, without leading zeros.
    """
    digits = F.transform(F.split(name, "[.]"), lambda part: F.ltrim(part, F.lit("0")))
    return F.transform(digits, lambda part: F.struct(F.length(part).alias("length"), part.alias("digits")))


def version_directories(inventory: DataFrame) -> DataFrame:
    """(parent, name, path) of the directories with a version name."""
    return (
        inventory.filter(F.col("is_dir"))
        .select(parent("path").alias("parent"), file_name("path").alias("name"), "path")
        .filter(F.col("name").rlike(VERSION_PATTERN))
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """One row per parent; of equal versions the smallest name wins."""
    named = versions.groupBy("parent", version_key(F.col("name")).alias("version")).agg(F.min("name").alias("name"))
    return named.groupBy("parent").agg(F.max_by("name", "version").alias("name"))


def old_versions(versions: DataFrame) -> DataFrame:
    """All version directories but the highest of each parent.

    The key is (parent, name), so a parent with very many versions is still spread out.
    """
    return versions.join(latest_versions(versions), ["parent", "name"], "left_anti").select("parent", "name", "path")
