"""Counts and sums for dashboards, each in one pass."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import rounded_mean


def posted_kpis(df: DataFrame, active: Column, applicants: Column, views: Column, by: list[str] | None = None) -> DataFrame:
    """Active rows, applicants, views, and the mean number of applicants rounded; sums of no rows are 0, their mean null."""
    total = F.coalesce(F.sum(applicants), F.lit(0)).cast("long")
    return df.groupBy(*(by or [])).agg(
        F.count_if(active).alias("active"),
        total.alias("applicants"),
        F.coalesce(F.sum(views), F.lit(0)).cast("long").alias("views"),
        rounded_mean(total, F.count(F.lit(1))).alias("mean_applicants"),
    )


def active_by_type(df: DataFrame, active: Column, kind: str) -> DataFrame:
    return df.where(active).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values on more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rollups(df: DataFrame, keys: list[str], sets: list[list[str]], distinct: str, name: str, having: Column | None = None) -> DataFrame:
    """(keys, level, n, `name`): rows and distinct values of `distinct` for each group of each of the grouping sets.

    Keys that a set lacks are null, as are null keys that it has; level, the grouping id, tells them apart. One scan: each
    row is expanded to one for each set, and counts and distinct values are reduced before they move. An empty table has no
    groups, not even for an empty set. having: a condition on these columns.
    """
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias(name)
    )
    return out if having is None else out.where(having)
