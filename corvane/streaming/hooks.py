"""The hook that gives each new user a profile, on a stream of users."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corvane.operators.nest import missing


def on_new_users(users: DataFrame, read_profiles: Callable[[], DataFrame], append: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """For each micro-batch of users, append(rows, batch) gets a profile for each user that has none yet.

    Profiles are read again for every batch, so a batch that is run twice finds its own rows and appends nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        known = read_profiles().select(F.col("utilisateur_id").alias("id"))
        append(missing(df.select("id").distinct(), known, "id").select(F.col("id").alias("utilisateur_id")), number)

    return users.writeStream.foreachBatch(batch)
