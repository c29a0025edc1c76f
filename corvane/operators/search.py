"""Text search over an index of trigrams, and matches of word lists over an inverted index."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.sources.shared import stored

GRAM = 3
RAREST = 4  # grams of a needle whose posting lists are intersected
PART_PAIRS = 1 << 21  # pairs of a gram and an id, or ids on posting lists, that meet in one task


def grams(text: Column) -> Column:
    """The distinct stretches of three characters of a text in lower case; none of a shorter or null text."""
    t = F.lower(text)
    places = F.when(F.length(t) >= GRAM, F.sequence(F.lit(1), F.length(t) - (GRAM - 1)))
    return F.array_distinct(F.coalesce(F.transform(places, lambda i: F.substring(t, i, F.lit(GRAM))), F.array().cast("array<string>")))


def index_parts(df: DataFrame, texts: list[str], lists: list[str]) -> int:
    """Partitions for the index of `df`: PART_PAIRS characters each, as a field has no more grams than characters."""
    chars = [F.coalesce(F.length(c), F.lit(0)) for c in texts] + [F.coalesce(F.length(F.array_join(c, "")), F.lit(0)) for c in lists]
    some = df.agg(F.sum(sum(chars, F.lit(0)).cast("long"))).first()[0]  # one row
    return (some or 0) // PART_PAIRS + 1


def trigram_index(df: DataFrame, texts: list[str], lists: list[str], key: str = "id", parts: int | None = None) -> DataFrame:
    """(gram, id), each pair once: the posting lists of all fields. A common gram is many rows, not one long list.

    Rows are spread by id before their grams are listed, so a task holds the pairs of one of `parts` (by default as
    `index_parts` says) and not those of all that it reads.
    """
    df = df.select(key, *texts, *lists).repartition(parts or index_parts(df, texts, lists), F.col(key))
    fields = [grams(F.col(c)) for c in texts]
    fields += [F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), grams)) for c in lists]
    return df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*fields)))).alias("gram")).distinct()


def save_index(index: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes the index by ranges of grams, `parts` if given, sorted, so that a look-up reads the row groups of its grams only."""
    ranges = index.repartitionByRange(parts, "gram", "id") if parts else index.repartitionByRange("gram", "id")
    ranges.sortWithinPartitions("gram", "id").write.parquet(path)


def indexed_search(df: DataFrame, index: DataFrame, needle: str, contains: Callable[[str], Column], key: str = "id") -> DataFrame:
    """The rows of `df` for which contains(needle) holds, found by the index of its fields.

    The posting lists of the needle's rarest grams are intersected, and `contains` is asked of the rows that are on all;
    a needle of less than three characters has no gram, and is asked of all rows. Nothing is missed: every text with the
    needle has all its grams. The counts of the needle's grams are collected, a row for each.
    """
    spark = df.sparkSession
    asked = spark.range(1).select(grams(F.lit(needle)).alias("g")).first()["g"]
    if not asked:
        return df.where(contains(needle))
    counts = {r.gram: r.n for r in index.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < len(asked):
        return df.limit(0)
    rarest = sorted(asked, key=lambda g: (counts[g], g))[:RAREST]
    parts = sum(counts[g] for g in rarest) // PART_PAIRS + 1
    on_all = index.where(F.col("gram").isin(rarest)).repartition(parts, "id").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(rarest))
    return df.join(on_all.select("_id"), F.col(key) == F.col("_id"), "left_semi").where(contains(needle))


def _lists(df: DataFrame, words: str, level: str, key: str) -> DataFrame:
    """(_id, _level, _list): the distinct words of each row in order; rows without any go."""
    some = F.array_sort(F.array_distinct(F.array_compact(F.col(words))))
    return df.select(F.col(key).alias("_id"), F.col(level).alias("_level"), some.alias("_list")).where(F.size("_list") > 0)


def _classes(rows: DataFrame, best: int) -> DataFrame:
    """(_id, _level, _list, _ids): rows of one list and level are one class, with its `best` smallest ids, of which _id is the first.

    Each task keeps `best` rows of a class before they move, so a list that a third of all rows have is a few rows.
    """
    alike = ("_hash", "_list", "_level")  # the hash first, so that sorts seldom compare lists
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("_id"))
    few = rows.withColumn("_hash", F.xxhash64("_list", "_level")).withColumn("_nth", nth).where(F.col("_nth") <= best)
    return few.groupBy(*alike).agg(F.array_sort(F.collect_list("_id")).alias("_ids")).select(F.element_at("_ids", 1).alias("_id"), "_level", "_list", "_ids")


def _numbers(lists: DataFrame) -> DataFrame:
    """(_w, _i): the words of `_list` numbered, rarest first, in the shared folder."""
    counts = lists.select(F.explode("_list").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    return stored(counts.orderBy("_n", "_w").select("_w", F.monotonically_increasing_id().alias("_i")))


def _rare_first(classes: DataFrame, numbers: DataFrame, at_least: float, side: str) -> DataFrame:
    """(_id, level, words, size, _at, _i) for each word of the prefix, of which a match of `at_least` must share one.

    words are numbers, rarest first; _at is the place of _i among them.
    """
    each = classes.select("_id", "_level", F.explode("_list").alias("_w"))
    rows = each.join(numbers, "_w").groupBy("_id", "_level").agg(F.array_sort(F.collect_list("_i")).alias("_s"))
    prefix = F.posexplode(F.expr(f"slice(_s, 1, cast(size(_s) - ceil({at_least}D * size(_s)) + 1 as int))")).alias(f"_at_{side}", "_i")
    return rows.select(F.col("_id").alias(f"_id_{side}"), F.col("_level").alias(f"_level_{side}"), F.col("_s").alias(f"_words_{side}"), F.size("_s").alias(f"_size_{side}"), prefix)


def best_matches(left: DataFrame, right: DataFrame, words: str, level: str, at_least: float, best: int, bonus: float = 0.1, key: str = "id") -> DataFrame:
    """(left_id, right_id, score, rank): for each row of `left` its `best` rows of `right` that share enough words.

    Two lists match if their common words are `at_least` of all their words (0 < at_least <= 1). score is that share, and
    `bonus` more for an equal level; ties go to the smaller id. Repeated words count once; null, empty lists match nothing.
    Ids are unique on each side.

    Rows with one list and level are one class, and classes meet, not rows: the `best` rows lie in the `best` classes, of
    each its smallest ids. Words are put rarest first. Lists that match share a word among the first n - ceil(at_least * n) + 1
    of each, and their lengths differ by a factor of at_least at most, so only classes that share a rare word meet, once, at
    the first one that they share; if too few words stand behind it on a side, they are not compared. Words move as numbers. Matches are reduced to the best of each task before they move. The classes and the words' numbers,
    which are read more than once, are written to the shared folder.
    """
    mine = _lists(left, words, level, key)
    asking, asked = stored(_classes(mine, 1)), stored(_classes(_lists(right, words, level, key), best))
    numbers = _numbers(asking.select("_list").unionByName(asked.select("_list")))
    a, b = _rare_first(asking, numbers, at_least, "a"), _rare_first(asked, numbers, at_least, "b")
    met = a.join(b, "_i").where((F.col("_size_a") >= at_least * F.col("_size_b")) & (F.col("_size_b") >= at_least * F.col("_size_a")))
    # where the first shared word stands, so many words at most are left to share
    left_over = F.least(F.col("_size_a") - F.col("_at_a"), F.col("_size_b") - F.col("_at_b"))
    met = met.where(left_over * (1 + at_least) >= at_least * (F.col("_size_a") + F.col("_size_b")) - 1e-9)
    both = F.size(F.array_intersect("_words_a", "_words_b"))
    met = met.withColumn("_share", both / (F.col("_size_a") + F.col("_size_b") - both)).where(F.col("_share") >= at_least)
    met = met.where(F.array_intersect("_words_a", "_words_b")[0] == F.col("_i"))
    score = F.col("_share") + F.when(F.col("_level_a") == F.col("_level_b"), bonus).otherwise(0.0)
    first = lambda by: F.row_number().over(Window.partitionBy("_id_a").orderBy(F.desc("score"), by))
    near = met.select("_id_a", "_id_b", score.alias("score")).withColumn("_nth", first("_id_b")).where(F.col("_nth") <= best)
    rows = near.join(asked.select(F.col("_id").alias("_id_b"), "_ids"), "_id_b").select("_id_a", "score", F.explode("_ids").alias("right_id"))
    rows = rows.withColumn("rank", first("right_id")).where(F.col("rank") <= best)
    same = (F.col("m._list") == F.col("c._list")) & F.col("m._level").eqNullSafe(F.col("c._level"))
    members = mine.alias("m").join(asking.alias("c"), same).select(F.col("m._id").alias("left_id"), F.col("c._id").alias("_id_a"))
    return members.join(rows, "_id_a").select("left_id", "right_id", "score", "rank")
