"""Joins and groups along time: the last row before a time, points within intervals, sessions.

Each works on time buckets of a key, so that the history of one key, however hot, is spread over tasks. Times are
timestamps or dates; rows with a null key or time match nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MICROS = 1_000_000
PART_ROWS = 1 << 19  # rows of both sides that meet in one task


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def as_of(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    name: str,
    width: int,
    equal: bool = False,
    tie: str | None = None,
) -> DataFrame:
    """Each row of `left` with the struct column `name`: the last row of `right` before it with the same `by`, or null.

    width: seconds of a bucket. With `equal` a row at the same time counts as before. Of rows of `right` at one time the
    one with the largest `tie` is taken, and any of those that share that too. No theta join: both sides are reduced to
    the distinct times of each key, which are sorted within their bucket; the last row of a bucket is carried over to
    the next by a window with one row for each bucket; rows of `left` find their time by an equi-join. Rows are spread by
    key and time into partitions of some PART_ROWS before anything is grouped, so that what a task holds does not grow
    with the tables; the rows of each side are counted for that.
    """
    parts = (left.count() + right.count()) // PART_ROWS + 1
    key = lambda df: [df[c].alias(f"_k{i}") for i, c in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    events = right.where(right[right_time].isNotNull()).select(*key(right), micros(right[right_time]).alias("_t"), F.struct(*[right[c] for c in right.columns]).alias("_row"))
    bucket = F.expr(f"_t div {width * MICROS}")
    spread = lambda df: df.repartition(parts, *keys, "_t")
    events = spread(events).groupBy(*keys, "_t").agg(F.max_by("_row", F.struct(f"_row.{tie}") if tie else F.lit(0)).alias("_row"))
    at = spread(left.select("*", *key(left), micros(left[left_time]).alias("_t")))
    asked = at.where("_t is not null").select(*keys, "_t").distinct()
    # at one time a question comes before the answer, unless equal times count
    both = events.withColumn("_side", F.lit(0 if equal else 1)).unionByName(asked.withColumn("_side", F.lit(1 if equal else 0)), allowMissingColumns=True)
    both = both.withColumn("_bucket", bucket).repartition(parts, *keys, "_bucket")
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_found", F.last("_row", ignorenulls=True).over(so_far)).where(F.col("_side") == (1 if equal else 0))
    answers = inside.join(carried.repartition(parts, *keys, "_bucket"), [*keys, "_bucket"]).select(*keys, "_t", F.coalesce("_found", "_carried").alias(name))
    return at.join(spread(answers), [*keys, "_t"], "left").select(*left.columns, name)


def within_intervals(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, unit: int = 86400) -> DataFrame:
    """Pairs of a point and an interval of the same `by` with start <= time <= end, as structs `point` and `interval`.

    An interval of length up to unit * 2^k seconds lies in two bins of that size at most, and is sent to these; a point is
    sent to its bin of each size that occurs. Key, size and bin are an equi-join, the times are checked behind it. Sizes
    that occur are collected, some forty at most. A null or reversed bound makes an interval empty.
    """
    length = micros(intervals[end]) - micros(intervals[start])
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), length / F.lit(unit * MICROS)))).cast("int")
    spans = intervals.where(length >= 0).select(
        *[intervals[c].alias(f"_k{i}") for i, c in enumerate(by)], level.alias("_level"), micros(intervals[start]).alias("_from"), micros(intervals[end]).alias("_to"),
        F.struct(*intervals.columns).alias("interval"),
    )
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    size = F.lit(unit * MICROS) * F.pow(F.lit(2.0), F.col("_level")).cast("long")
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_to") / size))))
    at = points.where(points[time].isNotNull()).select(*[points[c].alias(f"_k{i}") for i, c in enumerate(by)], micros(points[time]).alias("_t"), F.struct(*points.columns).alias("point"))
    at = at.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", F.floor(F.col("_t") / size))
    met = at.join(binned, [*[f"_k{i}" for i in range(len(by))], "_level", "_bin"])
    return met.where("_t between _from and _to").select("point", "interval")


def sessions(events: DataFrame, by: list[str], time: str, gap: int, width: int) -> DataFrame:
    """(by, start, end, n): the sessions of each key, stretches in which no two neighbours are more than `gap` seconds apart.

    width: seconds of a block, more than `gap`. Events are cut into sessions within the blocks of a key; only the first
    and the last session of a block can go on in another, so these alone, two for each block at most, meet by key.
    Events at one time are counted together first. Null keys are keys; rows with a null time belong to no session.
    """
    if width <= gap:
        raise ValueError("a block must be longer than the gap")
    once = events.where(F.col(time).isNotNull()).groupBy(*by, micros(F.col(time)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    once = once.withColumn("_block", F.expr(f"_t div {width * MICROS}"))
    block = Window.partitionBy(*by, "_block").orderBy("_t")
    new = F.when(F.col("_t") - F.lag("_t").over(block) <= gap * MICROS, 0).otherwise(1)
    inside = once.withColumn("_new", new).withColumn("_s", F.sum("_new").over(block))
    inside = inside.withColumn("_last", F.max("_s").over(Window.partitionBy(*by, "_block")))
    parts = inside.groupBy(*by, "_block", "_s", "_last").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.sum("_n").alias("_n"))
    edge = (F.col("_s") == 1) | (F.col("_s") == F.col("_last"))
    along = Window.partitionBy(*by).orderBy("_from")
    joined = parts.where(edge).withColumn("_new", F.when(F.col("_from") - F.lag("_to").over(along) <= gap * MICROS, 0).otherwise(1))
    joined = joined.withColumn("_g", F.sum("_new").over(along))
    merged = joined.groupBy(*by, "_g").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"))
    whole = parts.where(~edge).select(*by, "_from", "_to", "_n").unionByName(merged.select(*by, "_from", "_to", "_n"))
    return whole.select(*by, F.timestamp_micros("_from").alias("start"), F.timestamp_micros("_to").alias("end"), F.col("_n").alias("n"))

