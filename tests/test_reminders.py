"""The stream of reminders in pieces, against the batch result."""
import random
from datetime import datetime, timedelta

from corvane.streaming import reminders

T0 = datetime(2024, 1, 1)
DDL = "utilisateur_id long, at timestamp, deadline timestamp"


def events(seed, first, last):
    """Events of the days first to last; half of them of one user, deadlines named again and again, some nulls."""
    rng, rows = random.Random(seed), []
    for _ in range(150):
        at = T0 + timedelta(days=first, minutes=rng.randrange((last - first) * 1440))
        deadline = (at + timedelta(hours=rng.randint(1, 60))).replace(minute=0, second=0)
        rows.append((0 if rng.random() < 0.5 else rng.randrange(9), at, deadline))
    rows += [(None, rows[0][1], rows[0][2]), (1, rows[0][1], None), *rows[:20]]
    return sorted(rows, key=lambda r: r[1])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pieces_and_restarts_give_the_batch_result(spark, tmp_path):
    source, out, seen = str(tmp_path / "events"), str(tmp_path / "out"), []
    for k in range(4):
        part = events(k, 3 * k, 3 * k + 3)
        seen += part
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
        got = reminders.run_available(spark, stream, out, lead=6 * 3600, delay="30 minutes")
        want = rows(reminders.due_now(spark.createDataFrame(seen, DDL), 6 * 3600, 1800))
        assert rows(got) == want and len(set(want)) == len(want) > 50 * k
        again = reminders.run_available(spark, spark.readStream.schema(DDL).parquet(source), out, lead=6 * 3600, delay="30 minutes")
        assert rows(again) == want


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "events"))
    assert reminders.run_available(spark, stream, str(tmp_path / "out"), 60, "1 minute").collect() == []
    assert reminders.due_now(spark.createDataFrame([], DDL), 60, 60).collect() == []


def test_state_is_a_row_for_a_band_of_users(spark, tmp_path, monkeypatch):
    """3,000 users of one deadline, some below zero, in two pieces: each is told once, and their state is a row for each band."""
    monkeypatch.setattr(reminders, "BAND", 1000)
    source, out, seen = str(tmp_path / "events"), str(tmp_path / "out"), []
    for k, (first, last) in enumerate(((-1500, 1000), (0, 1500))):
        part = [(u, T0 + timedelta(minutes=60 * k), T0 + timedelta(hours=20)) for u in range(first, last)] + [(7, T0 + timedelta(hours=15 + k), T0 + timedelta(hours=90))]
        seen += part
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        got = reminders.run_available(spark, spark.readStream.schema(DDL).parquet(source), out, lead=6 * 3600, delay="30 minutes")
        assert spark.read.format("statestore").load(f"{out}/log").count() <= 4 + 1
    want = rows(reminders.due_now(spark.createDataFrame(seen[:2501], DDL), 6 * 3600, 1800))
    assert rows(got) == want and len(want) == 2500
