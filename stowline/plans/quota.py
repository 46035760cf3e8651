"""Quota report from eight-field count lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowline.fixed_values import ALERT_PERCENT

_TB = float(1024**4)


def quota_rows(lines: DataFrame) -> DataFrame:
    """The numbers of each line; `error` marks lines without eight fields or without whole numbers."""
    parts = F.split(F.regexp_replace("value", "^\\s+|\\s+$", ""), "\\s+")
    number = lambda index: F.get("_f", F.lit(index)).try_cast("bigint")
    read = lines.select("value", parts.alias("_f")).select(
        F.coalesce(F.get("_f", F.lit(7)), F.col("value")).alias("location"),
        number(0).alias("ns_quota"),
        number(1).alias("ns_remaining"),
        number(2).alias("space_quota"),
        number(3).alias("fourth"),
        (F.size("_f") == 8).alias("_complete"),
    )
    wanted = ("ns_quota", "ns_remaining", "space_quota", "fourth")
    good = F.col("_complete")
    for name in wanted:
        good = good & F.col(name).isNotNull()
    return read.withColumn("error", ~good).drop("_complete")


def quota_report(lines: DataFrame, fourth_field: str = "used", alert: float = ALERT_PERCENT) -> DataFrame:
    """Use and percentages per location. `fourth_field` says whether field four is used or remaining space."""
    if fourth_field not in ("used", "remaining"):
        raise ValueError("fourth_field is 'used' or 'remaining'")
    ns_used = F.col("ns_quota") - F.col("ns_remaining")
    space_used = F.col("fourth") if fourth_field == "used" else F.col("space_quota") - F.col("fourth")

    def percent(used, quota):
        return F.when(quota == 0, F.lit(0.0)).otherwise(F.round(used / F.nullif(quota, F.lit(0)) * 100, 2))

    def usable(value, kind):
        return F.when(F.col("error"), F.lit(0).cast(kind)).otherwise(value.cast(kind))

    report = quota_rows(lines).select(
        "location",
        usable(F.col("ns_quota"), "bigint").alias("ns_quota"),
        usable(ns_used, "bigint").alias("ns_used"),
        usable(percent(ns_used, F.col("ns_quota")), "double").alias("ns_pct"),
        usable(F.round(F.col("space_quota") / _TB, 2), "double").alias("space_quota_tb"),
        usable(F.round(space_used / _TB, 2), "double").alias("space_used_tb"),
        usable(percent(space_used, F.col("space_quota")), "double").alias("space_pct"),
        "error",
    )
    return report.withColumn("ns_alert", F.col("ns_pct") > alert).withColumn("space_alert", F.col("space_pct") > alert)
