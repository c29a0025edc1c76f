"""What differs between two snapshots, as a log of changes, and snapshots after a log.

A log has a row for each change: the key, `seq` (larger is later), `op`, the names of the columns that changed, the row
after the change, null for a delete, and the row's digest. Nothing depends on the order in which log rows are stored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


class Conflict(ValueError):
    """A log that does not fit its snapshot."""


def digest(columns: list[str]) -> Column:
    """A digest of a row: SHA-256 over the columns as JSON, null fields included, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, key: str = "id", seq: int = 1) -> DataFrame:
    """(key, seq, op, changed, row, digest): what makes `new` of `old`; both have unique keys that are not null.

    A column that only one side has counts as null in the other. Each row moves once, for one full outer join by key.
    """
    names = [*new.columns, *[c for c in old.columns if c not in new.columns]]
    values = [c for c in names if c != key]
    old, new = (df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(dict(o.dtypes)[c]).alias(c) for c in names]) for df, o in ((old, new), (new, old)))
    a = old.select(F.col(key).alias("_old"), F.struct(*names).alias("_before"))
    b = new.select(F.col(key).alias("_new"), F.struct(*names).alias("_after"), digest(names).alias("_digest"))
    both = a.join(b, F.col("_old") == F.col("_new"), "full")
    gone, fresh = F.col("_new").isNull(), F.col("_old").isNull()
    each = [F.when(~F.col(f"_before.{c}").eqNullSafe(F.col(f"_after.{c}")), F.lit(c)) for c in values]
    names_of = F.filter(F.array(*each), lambda x: x.isNotNull()) if values else F.array().cast("array<string>")
    rows = both.select(
        F.coalesce("_new", "_old").alias(key),
        F.lit(seq).cast("long").alias("seq"),
        F.when(gone, DELETE).when(fresh, INSERT).otherwise(UPDATE).alias("op"),
        F.when(gone | fresh, F.array().cast("array<string>")).otherwise(names_of).alias("changed"),
        F.col("_after").alias("row"),
        F.col("_digest").alias("digest"),
    )
    return rows.where((F.col("op") != UPDATE) | (F.size("changed") > 0))


def latest(log: DataFrame, key: str = "id") -> DataFrame:
    """The last change of each key: of equal seq the larger digest, a delete last of all, so that the result is one.

    A partially aggregated maximum, so a key that changes very often costs one row a task.
    """
    last = F.struct(F.col("seq"), (F.col("op") == DELETE), F.coalesce("digest", F.lit("")))
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), last).alias("_last")).select(key, "_last.*")


def apply_log(snapshot: DataFrame, log: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """`snapshot` after the log: the last change of a key wins, a delete leaves a tombstone in the log and no row here.

    With the log of diff(old, new) and `old` it gives `new`, with the columns of both. strict: a first change that does not
    fit (an insert of a key that is there, or an update or delete of one that is not) and a row that is not what its
    digest says are errors.
    """
    columns = log.select("row.*").columns
    if strict:
        first = log.groupBy(key).agg(F.min_by("op", F.struct("seq", (F.col("op") == DELETE))).alias("op"))
        there = first.join(snapshot.select(F.col(key).alias("_there")), F.col(key) == F.col("_there"), "left")
        wrong = there.where((F.col("op") == INSERT) == F.col("_there").isNotNull())
        broken = log.select("row.*", "digest", "op").where(F.col("op") != DELETE).where(digest(columns) != F.col("digest"))
        if not wrong.isEmpty() or not broken.isEmpty():
            raise Conflict("the log does not fit the snapshot")
    last = latest(log, key)
    kept = snapshot.join(last.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
    return kept.unionByName(last.where(F.col("op") != DELETE).select("row.*"), allowMissingColumns=True).select(
        *columns, *[c for c in snapshot.columns if c not in columns]
    )
