"""Queries along time: the last notification before an application, those within an opportunity's days, sessions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import temporal
from corvane.plans import board
from corvane.plans.registry import query
from corvane.sources.shared import shared_folder
from corvane.streaming import reminders

DAY = 86400


def moved(day: Column, minutes: Column | int = 0) -> Column:
    """A time in the one month that the supplied notifications are of: the day's number modulo 30, and some minutes."""
    since = F.datediff(day, F.lit("1992-01-01").cast("date")) % 30 * 1440 + minutes
    return F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + since.cast("long") * 60_000_000)


_MOVED = "timestamp '2024-01-01' + to_minutes(cast(date_diff('day', date '1992-01-01', {day}) % 30 * 1440 + {minutes} as bigint))"


def applications_in_month(spark: SparkSession, d: str) -> DataFrame:
    """opportunite_id, line, candidat_id, at."""
    a = board.applications(spark, d)
    return a.select("opportunite_id", "line", "candidat_id", moved(F.col("date_creation"), F.col("opportunite_id") * 37 % 1440 + F.col("line")).alias("at"))


@query(f"""
    , asked as (
        select opportunite_id, line, candidat_id, {_MOVED.format(day="date_creation", minutes="opportunite_id * 37 % 1440 + line")} as asked_at from candidature
    ), told as (
        select utilisateur_id, date_creation, max(id) as id from notification group by all
    )
    select opportunite_id, line, candidat_id, t.id as notification_id, (epoch_us(asked_at) - epoch_us(t.date_creation)) // 1000000 as seconds_before
    from asked a asof left join told t on a.candidat_id = t.utilisateur_id and a.asked_at > t.date_creation
""")
def last_notice(spark: SparkSession, d: str) -> DataFrame:
    """J12 as-of join: each application with its candidate's last notification before it."""
    told = board.notifications(spark, d).select("utilisateur_id", "id", "date_creation").withColumnRenamed("utilisateur_id", "candidat_id")
    rows = temporal.as_of(applications_in_month(spark, d), told, ["candidat_id"], "at", "date_creation", "notice", width=DAY, tie="id")
    before = temporal.micros(F.col("at")) - temporal.micros(F.col("notice.date_creation"))
    return rows.select("opportunite_id", "line", "candidat_id", F.col("notice.id").alias("notification_id"), F.floor(before / 1_000_000).cast("long").alias("seconds_before"))


@query(f"""
    , spans as (
        select id, organisation_id, {_MOVED.format(day="date_publication", minutes="0")} as opens,
               {_MOVED.format(day="date_publication", minutes="0")} + to_days(cast(date_limite - date_publication as integer)) as closes
        from opportunite
    )
    select s.id as opportunite_id, n.id as notification_id from spans s join notification n on n.utilisateur_id = s.organisation_id and n.date_creation between opens and closes
""")
def notices_while_open(spark: SparkSession, d: str) -> DataFrame:
    """J12 interval join: the notifications of an organisation between publication and deadline of each of its opportunities."""
    o = board.opportunities(spark, d)
    opens = moved(F.col("date_publication"))
    days = F.datediff("date_limite", "date_publication").cast("long")
    spans = o.select("id", "organisation_id", opens.alias("opens"), F.timestamp_micros(F.unix_micros(opens) + days * DAY * 1_000_000).alias("closes"))
    points = board.notifications(spark, d).select("id", F.col("utilisateur_id").alias("organisation_id"), "date_creation")
    met = temporal.within_intervals(points, spans, ["organisation_id"], "date_creation", "opens", "closes")
    return met.select(F.col("interval.id").alias("opportunite_id"), F.col("point.id").alias("notification_id"))


@query("""
    , apart as (
        select utilisateur_id, date_creation, case when date_creation - lag(date_creation) over w <= interval 12 hours then 0 else 1 end as new
        from notification window w as (partition by utilisateur_id order by date_creation)
    ), numbered as (
        select *, sum(new) over (partition by utilisateur_id order by date_creation) as s from apart
    )
    select utilisateur_id, (epoch_us(min(date_creation)) - epoch_us(timestamp '2024-01-01')) // 1000000 as begins, count(*) as n,
           (epoch_us(max(date_creation)) - epoch_us(min(date_creation))) // 1000 as millis
    from numbered group by utilisateur_id, s
""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's notifications, apart by more than twelve hours: when they begin, how many, how long."""
    s = temporal.sessions(board.notifications(spark, d), ["utilisateur_id"], "date_creation", gap=DAY // 2, width=3 * DAY)
    zero = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return s.select(
        "utilisateur_id",
        F.floor((F.unix_micros("start") - zero) / 1_000_000).cast("long").alias("begins"),
        "n",
        F.floor((F.unix_micros("end") - F.unix_micros("start")) / 1000).cast("long").alias("millis"),
    )


@query("""
    , named as (
        select utilisateur_id, date_trunc('hour', date_creation) + to_hours(cast(1 + cast(json_extract_string(props, '$.k') as integer) % 72 as bigint)) as deadline, date_creation
        from notification
    )
    select distinct utilisateur_id, (epoch_us(deadline) - epoch_us(timestamp '2024-01-01')) // 3600000000 as hours
    from named where deadline - interval 6 hours < (select max(date_creation) from notification) - interval 1 hour
""")
def streamed_reminders(spark: SparkSession, d: str) -> DataFrame:
    """hook J14: a reminder once for each user and deadline, from the notifications as a stream in event time."""
    # a stream's path is a folder or, as here, a pattern
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.[p]arquet")
    at = F.col("ts").cast("timestamp")
    hours = F.get_json_object("props", "$.k").cast("int") % 72 + 1
    deadline = F.timestamp_micros(F.unix_micros(F.date_trunc("hour", at)) + hours.cast("long") * 3_600_000_000)
    events = stream.select(F.col("user_id").alias("utilisateur_id"), at.alias("at"), deadline.alias("deadline"))
    done = reminders.run_available(spark, events, shared_folder(spark), lead=6 * 3600, delay="1 hour")
    zero = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return done.select("utilisateur_id", F.floor((F.unix_micros("deadline") - zero) / 3_600_000_000).cast("long").alias("hours"))
