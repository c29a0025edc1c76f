"""Search by trigrams, matches of word lists, roll-ups, sketches and pages in the middle, against plain versions."""
import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.operators import kpi, listing, search, sketches

TEXTS = "id long, title string, organization string, tags array<string>"


def texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcABC é%_") for _ in range(rng.randint(1, 9)))
    rows = [(i, rng.choice([None, "", word()]), word(), rng.choice([None, [], [word(), None, word()], ["ab"]])) for i in range(400)]
    return spark.createDataFrame(rows, TEXTS).repartition(3)


@pytest.mark.parametrize("needle", ["", "a", "ab", "abc", "ABc", "bca ", "é%_", "aaaa", "abcabc", "zzz", "cab", "%%%"])
def test_search_finds_what_contains_finds(spark, tmp_path, needle):
    df = texts(spark)
    index = search.trigram_index(df, ["title", "organization"], ["tags"])
    contains = lambda x: P.board_search(x, F.col("title"), F.col("organization"), F.col("tags"))
    want = sorted(r.id for r in df.where(contains(needle)).collect())
    assert sorted(r.id for r in search.indexed_search(df, index, needle, contains).collect()) == want
    if needle == "abc":
        search.save_index(index, str(tmp_path / "index"))
        stored = spark.read.parquet(str(tmp_path / "index"))
        assert sorted(r.id for r in search.indexed_search(df, stored, needle, contains).collect()) == want and want
        plan = search.indexed_search(df, stored, "abc", contains)._jdf.queryExecution().toString()
        assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)" in plan or "In(gram" in plan or "EqualTo(gram" in plan
        assert search.indexed_search(df.limit(0), index.limit(0), needle, contains).collect() == []
        assert index.count() == index.distinct().count()


def test_an_index_has_parts_by_its_size(spark, monkeypatch):
    """Pairs are told apart within partitions of a bounded size, by id, and never in the task that reads the rows."""
    df = texts(spark).unionByName(texts(spark).limit(50))
    chars = sum(len(r.title or "") + len(r.organization) + sum(len(t or "") for t in r.tags or []) for r in df.collect())
    assert search.index_parts(df, ["title", "organization"], ["tags"]) == 1 and search.index_parts(df.limit(0), ["title"], ["tags"]) == 1
    monkeypatch.setattr(search, "PART_PAIRS", 100)
    assert search.index_parts(df, ["title", "organization"], ["tags"]) == chars // 100 + 1
    index = search.trigram_index(df, ["title", "organization"], ["tags"])
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and f", {chars // 100 + 1})" in plan and plan.count("hashpartitioning") == 1
    assert index.count() == index.distinct().count() > 100


def lists(spark, n, seed, hot):
    rng = random.Random(seed)
    pick = lambda: ["the"] * hot + [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(0, 8))]
    rows = [(i, rng.choice([pick(), pick(), pick(), None]), rng.choice([1, 2, None])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, words array<string>, level int"), rows


@pytest.mark.parametrize("at_least, hot", [(0.2, 0), (0.34, 1), (0.5, 1), (1.0, 0)])
def test_best_matches(spark, at_least, hot):
    (left, a), (right, b) = lists(spark, 80, 1, hot), lists(spark, 300, 2, hot)
    got = sorted((r.left_id, r["rank"], r.right_id, round(r.score, 9)) for r in search.best_matches(left, right, "words", "level", at_least, 5).collect())
    want = []
    for i, x, lx in a:
        scored = []
        for j, y, ly in b:
            x_, y_ = set(x or []), set(y or [])
            if x_ & y_ and len(x_ & y_) >= at_least * len(x_ | y_):
                scored.append((-(len(x_ & y_) / len(x_ | y_) + (0.1 if lx is not None and lx == ly else 0)), j))
        want += [(i, k, j, round(-s, 9)) for k, (s, j) in enumerate(sorted(scored)[:5], 1)]
    assert got == sorted(want) and want
    assert search.best_matches(left.limit(0), right, "words", "level", at_least, 5).collect() == []
    assert search.best_matches(left, right.limit(0), "words", "level", at_least, 5).collect() == []


def test_a_word_that_all_share_meets_nobody(spark):
    """Every list holds one common word: only rows that share a rare one meet."""
    left = spark.range(2000).select("id", F.array(F.lit("all"), F.concat(F.lit("l"), "id"), F.concat(F.lit("m"), "id")).alias("words"), F.lit(1).alias("level"))
    right = spark.range(2000).select("id", F.array(F.lit("all"), F.concat(F.lit("l"), "id"), F.concat(F.lit("r"), "id")).alias("words"), F.lit(1).alias("level"))
    out = search.best_matches(left, right, "words", "level", 0.5, 3)
    assert out.count() == 2000 and out.where("left_id <> right_id").isEmpty()


def test_lists_that_all_rows_have(spark):
    """20,000 rows of one list on each side: 400 million pairs, if rows met instead of lists."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 2, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("x"), F.lit(None), F.lit("y"))).alias("words"), (F.col("id") % 2).cast("int").alias("level"))
    out = search.best_matches(rows, rows, "words", "level", 0.5, 4)
    got = out.groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("rank", "right_id", "score"))).alias("r"))
    want = F.when(F.col("left_id") % 2 == 0, F.array(*map(F.lit, (0, 2, 4, 6)))).otherwise(F.array(*map(F.lit, (1, 3, 5, 7)))).cast("array<bigint>")
    assert got.count() == 20_000 and got.where(F.col("r.right_id") != want).isEmpty()
    assert [(r.rank, r.score) for r in got.first().r] == [(k, 1.1) for k in (1, 2, 3, 4)]


def test_copies_among_others(spark):
    """Copies and equal scores interleave by id; levels are null, and the same list has several."""
    data = [(i, [["a", "b"], ["a", "c"], ["a", "b", "c"]][i * 7 % 3], [None, 1, 2][i // 3 % 3]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, words array<string>, level int")
    got = {}
    for r in search.best_matches(df, df, "words", "level", 0.3, 7).orderBy("rank").collect():
        got.setdefault(r.left_id, []).append(r.right_id)
    for i, x, lx in data:
        score = lambda y, ly: len({*x} & {*y}) / len({*x} | {*y}) + (0.1 if lx is not None and lx == ly else 0)  # noqa: B023, E731
        assert got[i] == [j for _, j in sorted((-round(score(y, ly), 9), j) for j, y, ly in data)[:7]]


def test_words_meet_as_numbers(spark):
    """Prefixes hold numbers, rarest first, and say where in the list a word stands."""
    rows = spark.createDataFrame([(1, None, ["a", "b", "c", "d"]), (2, 1, ["b", "d"]), (3, 1, ["d"])], "_id long, _level int, _list array<string>")
    numbers = search._numbers(rows)
    order = [r._w for r in numbers.orderBy("_i").collect()]
    assert order == ["a", "c", "b", "d"]
    out = search._rare_first(rows, numbers, 0.5, "a")
    assert dict(out.dtypes)["_words_a"] == "array<bigint>"
    word = {r._i: r._w for r in numbers.collect()}
    got = sorted((r._id_a, r._at_a, word[r._i], [word[i] for i in r._words_a]) for r in out.collect())
    assert got == [(1, 0, "a", order), (1, 1, "c", order), (1, 2, "b", order), (2, 0, "b", ["b", "d"]), (2, 1, "d", ["b", "d"]), (3, 0, "d", ["d"])]


def test_rollups(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", None]), rng.choice(["x", "y", None]), rng.randrange(30)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, l string, v long")
    got = {(r.k, r.l, r.level): (r.n, r.u) for r in kpi.rollups(df, ["k", "l"], [["k", "l"], ["k"], []], "v", "u").collect()}
    want = {}
    for level, key in ((0, lambda k, m: (k, m)), (1, lambda k, m: (k, None)), (3, lambda k, m: (None, None))):
        for k, m, v in data:
            want.setdefault((*key(k, m), level), []).append(v)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    few = kpi.rollups(df, ["k", "l"], [["k", "l"], ["k"], []], "v", "u", F.col("n") > 100)
    assert {(r.k, r.l, r.level) for r in few.collect()} == {k for k, v in want.items() if len(v) > 100}
    assert kpi.rollups(df.limit(0), ["k"], [["k"], []], "v", "u").collect() == []
    plan = few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan ExistingRDD") == 1 and "Expand" in plan


def test_sketches(spark):
    """Half of all rows are of one day and of one user; spans of days are within the bounds of exact counts."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 10).cast("int").alias("d"),
        F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("id") % 7001).alias("u"),
        (F.col("id") * 7919 % 10_007).cast("double").alias("m"),
    )
    days = sketches.daily(df, F.col("d"), "u", "m")
    for span in ([3], [0, 1, 2], list(range(10))):
        row = sketches.merged(days.where(F.col("day").isin(span)), []).select("n", sketches.distinct_count("distinct_sketch").alias("u"), *[sketches.quantile("measure_sketch", q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).first()
        part = df.where(F.col("d").isin(span))
        n, u = part.count(), part.select(F.count_distinct("u")).first()[0]
        assert row.n == n and abs(row.u - u) <= 4 * 1.04 / math.sqrt(2**sketches.PRECISION) * u + 1
        for i, q in enumerate((0.1, 0.5, 0.99)):
            rank = part.where(F.col("m") <= row[f"q{i}"]).count() / n
            assert abs(rank - q) < 0.03
    again = sketches.merged(sketches.merged(days, [(F.col("day") % 2).alias("odd")]), [])
    assert again.select(sketches.distinct_count("distinct_sketch")).first()[0] == sketches.merged(days, []).select(sketches.distinct_count("distinct_sketch")).first()[0]
    assert sketches.daily(df.limit(0), F.col("d"), "u", "m").collect() == []
    assert days.select(F.length("measure_sketch").alias("b")).agg(F.max("b")).first()[0] < 20_000


@pytest.mark.parametrize("queue", [0, 10, 100, 10**6])
def test_pages_in_the_middle(spark, queue):
    rng = random.Random(6)
    data = [(i, rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([None, "", "a", "b", "é"])) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, a int, b string").repartition(4)
    for spec in ("-a,b", "b,-a", "id"):
        by = listing.terms(spec, ["a", "b"], "id")
        whole = [r.id for r in df.orderBy(*listing.sorting(by)).collect()]
        for offset in (0, 20, 1480, 2980, 2990, 3000):
            got = [r.id for r in listing.page_at(df, by, offset, 3000, queue=queue).collect()]
            assert got == whole[offset : offset + 20], (spec, offset)


def test_pages_of_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("id"))
    assert listing.page_at(df, [("id", True)], 300, 500, queue=10).count() == 20
    assert listing.page_at(df.limit(0), [("id", True)], 0, 0).collect() == []


def test_paginate_looks_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(listing, "QUEUE", 50)
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("a"))
    by = listing.terms("-a", ["a"], "id")
    whole = [r.id for r in df.orderBy(*listing.sorting(by)).collect()]
    for number in (1, 3, 25, 48, 50):
        assert [r.id for r in listing.paginate(df, by, number).results.collect()] == whole[20 * number - 20 : 20 * number]
