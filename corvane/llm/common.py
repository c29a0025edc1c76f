"""What several operators share: the shared folder, running sums, keys of rows and connected components."""
from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUM_ROWS = 4096
FILE_ROWS = 50_000


def use_shared_folder(spark: SparkSession) -> None:
    """Point checkpoint() at spark.checkpoint.dir. Where that is unset, a local session (tests) gets a folder of its own.

    A cluster without the setting is an error: executors would not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvane-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that lost executors cost no recomputation beyond it.

    rows: about how many there are, if known; a file for each FILE_ROWS of them is written then.
    """
    use_shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint()


def starts(sizes: DataFrame, keys: list[str], at: str, size: str, rows: int = SUM_ROWS) -> DataFrame:
    """(keys, at, start): the sum of `size` before each `at`, by keys (never null).

    Sums of blocks of `rows` numbers come first, so that a task orders `rows` rows, or one row for each of so many.
    """
    blocks = cut(sizes.select(*keys, at, size, F.expr(f"{at} div {rows}").alias("_block")))
    before = lambda col, by, order: F.coalesce(
        F.sum(col).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    whole = blocks.groupBy(*keys, "_block").agg(F.sum(size).alias("_sum"))
    whole = whole.select(*keys, "_block", before("_sum", keys, "_block").alias("_before"))
    inside = blocks.select(*keys, at, "_block", before(size, [*keys, "_block"], at).alias("_inside"))
    return inside.join(whole, [*keys, "_block"]).select(*keys, at, (F.col("_before") + F.col("_inside")).alias("start"))


def text_digest(text: Column) -> Column:
    """The SHA-256 of a text in hex; a null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def one_row_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of `docs` for each pair (doc_id, text_digest of text) in `wanted`, which has each pair once; ids may be null.

    A semi-join, so that texts are neither sorted nor moved beyond it. Only pairs that several rows of `docs` have are
    reduced to one row each, in each task before they move, so that they cannot gather in one.
    """
    key = lambda i, d: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), d)
    names = docs.columns
    keyed = docs.select(
        key(F.col("doc_id"), text_digest(F.col("text"))).alias("_key"),
        F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]).alias("_row"),
    )
    kept = wanted.select(key(F.col("doc_id"), F.col("text_digest")).alias("_key"))
    repeated = cut(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key").join(kept, "_key", "left_semi"))
    if repeated.isEmpty():
        out = keyed.join(kept, "_key", "left_semi")
    else:
        out = keyed.join(kept.join(repeated, "_key", "left_anti"), "_key", "left_semi")
        again = keyed.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row"))
        out = out.unionByName(again)
    return out.select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(names)])


def _state(edges: DataFrame) -> tuple:
    # wrapping sums of two independent hashes say whether the edge set has changed
    h = lambda seed: F.sum((F.xxhash64(F.lit(seed), "u", "v") / F.lit(2.0**20)).cast("long"))
    return tuple(edges.agg(F.count(F.lit(1)), h(1), h(2)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    edges: columns a, b (long); self-loops, repeats and nulls are ignored. Returns (node, root), one row for each
    node that has an edge; root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes. Every step is a partially aggregated minimum
    and an equi-join back to it, so a hub costs one row a task before its join, and the join may be split.
    """
    edges = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), state[0])
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
