"""Parents with their children, and tests of membership."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parent(df: DataFrame, parent: DataFrame, fk: str, name: str, key: str = "id", how: str = "inner") -> DataFrame:
    """Each row with the row that its foreign key names, as a struct column; null where there is none and how is left."""
    inside = parent.select(F.col(key).alias("_key"), F.struct(*parent.columns).alias(name))
    return df.join(inside, F.col(fk) == F.col("_key"), how).drop("_key")


def with_children(df: DataFrame, children: DataFrame, fk: str, name: str, columns: list[str], key: str = "id") -> DataFrame:
    """Each row with the array of its children's `columns`, sorted by them; an empty array where there are none.

    Children are grouped before the join, so it sees one row for each parent.
    """
    grouped = children.groupBy(F.col(fk).alias("_fk")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return df.join(grouped, F.col(key) == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, F.array()))


def child_counts(df: DataFrame, children: DataFrame, fk: str, name: str, key: str = "id") -> DataFrame:
    counts = children.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, F.col(key) == F.col("_fk"), "left").drop("_fk").fillna(0, [name])


def members(df: DataFrame, others: DataFrame, on: Column | str | list[str]) -> DataFrame:
    return df.join(others, on, "left_semi")


def missing(df: DataFrame, others: DataFrame, on: Column | str | list[str]) -> DataFrame:
    return df.join(others, on, "left_anti")


def with_flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Whether each row's key is among `keys`, which has one column."""
    marks = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    return df.join(marks, F.col(key) == F.col("_key"), "left").withColumn(name, F.col("_key").isNotNull()).drop("_key")


def first_group(users: DataFrame, bridge: DataFrame, groups: DataFrame, default: str | None = None) -> DataFrame:
    """users with account_type: the name of the group with the smallest id, else the default.

    bridge: utilisateur_id, groupe_id; groups: id, name.
    """
    named = bridge.join(groups.select(F.col("id").alias("groupe_id"), "name"), "groupe_id")
    first = named.groupBy(F.col("utilisateur_id").alias("_user")).agg(F.min_by("name", "groupe_id").alias("account_type"))
    out = users.join(first, F.col("id") == F.col("_user"), "left").drop("_user")
    return out if default is None else out.fillna(default, ["account_type"])
