"""Reminders of deadlines from a stream of events, once for each user and deadline."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "utilisateur_id long, deadline timestamp"
BAND = 1 << 16  # users whose state for a deadline is one row


def reminders(events: DataFrame, lead: int, delay: str) -> DataFrame:
    """(utilisateur_id, deadline) of a stream of events (utilisateur_id, at, deadline), `lead` seconds before each deadline.

    A reminder is due when the watermark, `delay` behind the latest event, has passed its time; by event time, so a run
    over old events gives what the run at the time gave. State is kept by deadline and band of users, which are BAND
    neighbouring ids: the users that events have named with the deadline, until the watermark passes it; later events for
    these give nothing. All of a band are due at once, so a band is one call and not one for each user. Events with a null
    among the three are left out, as are events behind the watermark. `due_now` is the same for a table.
    """

    def remind(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end = int(key[0].timestamp() * 1000)
        due, now = end - lead * 1000, state.getCurrentWatermarkMs()
        if state.hasTimedOut and state.get[1]:
            state.remove()
            return
        known, sent = state.get if state.exists else ([], False)
        known = np.array(known, np.int64)
        named = [r["utilisateur_id"].unique() for r in rows]
        fresh = np.setdiff1d(np.concatenate([np.zeros(0, np.int64), *(named if end >= now else [])]), known)
        if not len(known) + len(fresh):
            return
        known = np.concatenate([known, fresh])
        if due < now:
            told = fresh if sent else known
            if len(told):
                yield pd.DataFrame({"utilisateur_id": told, "deadline": key[0]})
            sent = True
        state.update((known.tolist(), sent))
        state.setTimeoutTimestamp(max(end if sent else due, now))

    whole = events.select(F.col("utilisateur_id").cast("long").alias("utilisateur_id"), F.col("at").cast("timestamp").alias("at"), F.col("deadline").cast("timestamp").alias("deadline"))
    whole = whole.where("utilisateur_id is not null and at is not null and deadline is not null").withWatermark("at", delay)
    banded = whole.withColumn("band", F.floor(F.col("utilisateur_id") / BAND))
    return banded.groupBy("deadline", "band").applyInPandasWithState(remind, _OUT, "known array<long>, sent boolean", "append", GroupStateTimeout.EventTimeTimeout)


def due_now(events: DataFrame, lead: int, delay: int) -> DataFrame:
    """What `reminders` has given once all of a table has been seen; delay in seconds."""
    whole = events.where("utilisateur_id is not null and at is not null and deadline is not null")
    latest = whole.agg((F.floor(F.max(F.unix_micros(F.col("at").cast("timestamp"))) / 1000) - delay * 1000).alias("_now"))  # one row
    due = F.unix_micros(F.col("deadline").cast("timestamp")) / 1000 - lead * 1000
    return whole.select("utilisateur_id", "deadline").distinct().join(F.broadcast(latest), due < F.col("_now")).drop("_now")


def run_available(spark: SparkSession, events: DataFrame, out: str, lead: int, delay: str) -> DataFrame:
    """Runs `reminders` over what there is of `events` and returns all that `out` holds by now.

    The log lies in `out`, so that another run goes on where this one ended and repeats nothing.
    """
    writer = reminders(events, lead, delay).writeStream.format("parquet").outputMode("append")
    writer.option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{out}/rows")
