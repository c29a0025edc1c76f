"""Queries on groups: roll-ups in one scan, and counts from daily sketches."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import kpi, sketches
from corvane.plans import board
from corvane.plans.registry import query


@query("""
    select type_opportunite, statut, source_id, grouping(type_opportunite, statut, source_id) as level, count(*) as n, count(distinct organisation_id) as organisations
    from sourced group by grouping sets ((type_opportunite, statut, source_id), (type_opportunite, statut), (type_opportunite), (statut), (source_id), ())
    having count(*) >= 40
""")
def facet_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Opportunities and their organisations by type, status and source and by some of them, groups of forty or more."""
    t, s, o = "type_opportunite", "statut", "source_id"
    return kpi.rollups(board.with_source_id(spark, d), [t, s, o], [[t, s, o], [t, s], [t], [s], [o], []], "organisation_id", "organisations", F.col("n") >= 40)


@query("""
    select cast((day(date_creation) - 1) // 10 as bigint) as span, count(*) as n, true as distinct_close, true as median_close
    from notification group by all
""")
def sketched_spans(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and the median user id of ten days each, from daily sketches, and whether the exact ones are within the bounds."""
    rows = board.notifications(spark, d).select("utilisateur_id", F.floor((F.dayofmonth("date_creation") - 1) / 10).alias("span"), F.to_date("date_creation").alias("day"))
    days = sketches.daily(rows, F.col("day"), "utilisateur_id", "utilisateur_id")
    spans = sketches.merged(days, [F.floor((F.dayofmonth("day") - 1) / 10).alias("span")])
    told = spans.select(F.col("span").alias("_span"), sketches.distinct_count("distinct_sketch").alias("about"), sketches.quantile("measure_sketch", 0.5).alias("median"))
    # a row for each span meets the rows
    met = rows.join(told, F.col("span") == F.col("_span")).groupBy("span", "about", "median")
    exact = met.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("utilisateur_id").alias("users"), F.count_if(F.col("utilisateur_id") < F.col("median")).alias("below"), F.count_if(F.col("utilisateur_id") <= F.col("median")).alias("upto"))
    return exact.select(
        F.col("span").cast("long").alias("span"),
        "n",
        (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("distinct_close"),
        ((F.col("below") <= 0.53 * F.col("n")) & (F.col("upto") >= 0.47 * F.col("n"))).alias("median_close"),
    )
