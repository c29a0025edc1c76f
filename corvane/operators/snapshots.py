"""Snapshots whose columns become narrower, and snapshots in buckets of a key."""
from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.validate import too_long


class TooLong(ValueError):
    """A text that a narrower column cannot hold."""


def narrow(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """`df` with text columns of `limits` characters at most: TooLong names columns where some text is longer, none is cut."""
    found = too_long(df, limits).select(F.explode("too_long").alias("name")).distinct().collect()  # a row for each column at most
    if found:
        raise TooLong(", ".join(sorted(f"{r.name} > {limits[r.name]}" for r in found)))
    return df


class Bucketed:
    """Versions of a table in `root`, each in `buckets` buckets of `key`, sorted by it.

    Joins and groups by the key read a version without an exchange, as buckets meet buckets: tables that are to meet need
    the same number. A version is written once, with one shuffle, and never changed; columns may differ between versions.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def _name(self, version: int) -> str:
        return f"bucketed_{hashlib.sha256(self._path(version).encode()).hexdigest()[:24]}"

    def save(self, df: DataFrame, version: int) -> None:
        """Writes a version; an error where there is one. A file for each bucket."""
        rows = df.repartition(self.buckets, self.key)
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self._path(version)).format("parquet").saveAsTable(self._name(version))

    def load(self, versions: list[int]) -> DataFrame:
        """The rows of all `versions`, with nulls in columns that a version lacks; of one version, in its buckets.

        A version that another session has written is known by its files.
        """
        for v in versions:
            if not self.spark.catalog.tableExists(self._name(v)):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self._path(v)).schema)
                where = self._path(v).replace("\\", "\\\\").replace("'", "\\'")
                self.spark.sql(f"create table {self._name(v)} ({columns}) using parquet clustered by (`{self.key}`) sorted by (`{self.key}`) into {self.buckets} buckets location '{where}'")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.table(self._name(v)) for v in versions])
