"""Rules as frames of violations, which must be empty."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.kpi import repeated_keys


def broken(df: DataFrame, rule: Column) -> DataFrame:
    """Rows that do not meet the rule."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return repeated_keys(df, keys)


def orphans(df: DataFrame, fk: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose foreign key names no parent; null keys name none and are not orphans."""
    return df.where(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(fk) == F.col("_key"), "left_anti")


def errors(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a row is valid if there are none."""
    return F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in one of the columns, and which: NOT NULL."""
    nulls = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.withColumn("missing", nulls).where(F.size("missing") > 0)


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with a text beyond its column's length, and which: what stands in the way of a narrower column."""
    over = F.filter(F.array(*[F.when(F.length(c) > n, F.lit(c)) for c, n in limits.items()]), lambda x: x.isNotNull())
    return df.withColumn("too_long", over).where(F.size("too_long") > 0)
