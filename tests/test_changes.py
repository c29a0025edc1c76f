"""Change logs, narrower columns and bucketed snapshots."""
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import changelog, snapshots

DDL = "id long, a string, b double, c array<int>"


def table(spark, n, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(3 * n), n)
    return spark.createDataFrame([(i, rng.choice([None, "", "x", "y"]), rng.choice([None, 0.5, 1.5]), rng.choice([None, [], [1], [1, 2]])) for i in ids], DDL).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("n, m", [(300, 250), (0, 50), (50, 0), (0, 0), (40, 40)])
def test_the_difference_makes_the_second_of_the_first(spark, n, m):
    old, new = table(spark, n, 1), table(spark, m, 2)
    log = changelog.diff(old, new)
    for strict in (False, True):
        assert rows(changelog.apply_log(old, log, strict=strict)) == rows(new)
    have, want = {r.id: r for r in old.collect()}, {r.id: r for r in new.collect()}
    for r in log.collect():
        assert r.op == ("insert" if r.id not in have else "delete" if r.id not in want else "update")
        assert r.changed == ([c for c in "abc" if have[r.id][c] != want[r.id][c]] if r.op == "update" else [])
        assert (r.row is None) == (r.op == "delete") == (r.digest is None)
    assert log.count() == len({k for k in have | want if have.get(k) != want.get(k)})
    assert changelog.diff(new, new.orderBy("a")).isEmpty()


def test_columns_that_come_and_go(spark):
    old = table(spark, 60, 1)
    new = old.drop("b").withColumn("d", F.when(F.col("id") % 2 == 0, F.lit(7)))
    out = changelog.apply_log(old, changelog.diff(old, new))
    assert set(out.columns) == set("id a b c d".split())
    assert rows(out.select("id", "a", "c", "d")) == rows(new.select("id", "a", "c", "d")) and out.where("b is not null").isEmpty()


def test_the_last_change_wins(spark):
    """A key with most of the log, deletes and returns, and entries stored in any order."""
    base, rng, entries = table(spark, 50, 3), random.Random(9), []
    ids = [r.id for r in base.collect()]
    for seq in range(2, 2000):
        key = ids[0] if rng.random() < 0.6 else rng.choice(ids)
        entries.append((key, seq, None if rng.random() < 0.3 else (key, f"s{seq}", 0.5, [seq])))
    log = spark.createDataFrame([(k, s, "delete" if r is None else "update", [], r, None) for k, s, r in entries], f"id long, seq long, op string, changed array<string>, row struct<{DDL.replace(' ', ': ').replace(',:', ',')}>, digest string")
    last = {k: r for k, _, r in entries}
    want = [tuple(r) for r in base.collect() if r.id not in last] + [r for r in last.values() if r is not None]
    assert rows(changelog.apply_log(base, log.orderBy(F.rand(1)))) == sorted(want, key=repr)
    assert rows(changelog.apply_log(base, log.limit(0))) == rows(base)


def test_logs_that_do_not_fit(spark):
    old, new = table(spark, 60, 1), table(spark, 60, 2)
    log = changelog.diff(old, new)
    with pytest.raises(changelog.Conflict):
        changelog.apply_log(new, log, strict=True)
    with pytest.raises(changelog.Conflict):
        changelog.apply_log(old, log.withColumn("digest", F.lit("no")), strict=True)


def test_narrow(spark):
    df = spark.createDataFrame([("abc", "de"), (None, "ééé")], "a string, b string")
    assert rows(snapshots.narrow(df, {"a": 3, "b": 3})) == rows(df) and snapshots.narrow(df.limit(0), {"a": 0}).count() == 0
    with pytest.raises(snapshots.TooLong, match="a > 2, b > 2"):
        snapshots.narrow(df, {"a": 2, "b": 2})


def test_bucketed_versions(spark, tmp_path):
    parents = snapshots.Bucketed(spark, str(tmp_path / "p"), "id", 4)
    parents.save(spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id long, titre string"), 1)
    parents.save(spark.createDataFrame([(i, 5) for i in range(200, 220)], "id long, annees int"), 2)
    children = snapshots.Bucketed(spark, str(tmp_path / "c"), "fk", 4)
    children.save(spark.createDataFrame([(i % 150 if i % 3 else 7, i) for i in range(900)], "fk long, n long"), 1)
    with pytest.raises(Exception, match="(?i)exist"):
        parents.save(spark.createDataFrame([(1, "x")], "id long, titre string"), 1)
    both = parents.load([1, 2])
    assert both.columns == ["id", "titre", "annees"] and both.count() == 220 and both.where("titre is null and annees = 5").count() == 20
    sums = children.load([1]).groupBy("fk").agg(F.sum("n").alias("s"), F.count("n").alias("k"))
    out = parents.load([1]).join(sums.hint("merge"), F.col("id") == F.col("fk"), "left")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and out.agg(F.sum("k")).first()[0] == 900
    # as another session finds them
    for v, t in ((1, parents), (2, parents), (1, children)):
        spark.sql(f"drop table {t._name(v)}")
    assert parents.load([1, 2]).count() == 220
    again = children.load([1]).groupBy("fk").count()
    again.collect()
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
