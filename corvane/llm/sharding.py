"""Two-pass external shuffle into shards.

First pass: rows are scattered over buckets that fit in memory, by a seeded hash. Second pass: each bucket is put in an
order that does not depend on the run, Fisher-Yates shuffled with a generator seeded by the bucket, and laid behind the
buckets before it. The resulting order is cut into shards whose row counts differ by one at most.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, starts

BUCKET_BYTES = 4 << 20
TASK_BYTES = 64 << 20
LEAST_BUCKETS = 64
REPEATS = 1000  # rows with one id and text that may share a bucket
FEW = 100_000  # rows of 16 bytes that may be broadcast


def shuffle_to_shards(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    repeats: int = REPEATS,
) -> DataFrame:
    """(shard, slot, row) for each row of `docs`: shard from 0, slot gapless from 0 within it, row a struct of all columns.

    Shard sizes in rows differ by one at most. The order depends on ids, texts, the seed and the number of buckets, not
    on partitions or retries. A bucket holds about `bucket_bytes` of texts, or one longer text: rows that repeat id and text
    more than `repeats` times, or with more bytes, are dealt to neighbouring buckets by their place in the input, so that they
    do not gather in one; they alone are written to the shared folder. Null ids are scattered by text. An empty table gives
    none. The struct keeps extra columns apart, so that names such as shard or slot do not clash.
    """
    text, spark = F.col(text_col), docs.sparkSession
    told = F.xxhash64(F.lit(seed), F.col(id_col), text)
    # rows that share id and text, with their number and the bytes of one: all counts follow from them, without the texts
    kinds = cut(docs.groupBy(told.alias("_order")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("_bytes")))
    total = kinds.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") * F.col("_bytes")), F.lit(0)).alias("bytes")).first()
    n, n_bytes = total["rows"], total["bytes"]
    buckets = max(LEAST_BUCKETS, -(-n_bytes // bucket_bytes))
    parts = F.greatest(F.ceil(F.col("_n") / repeats), F.ceil(F.col("_n") * F.col("_bytes") / bucket_bytes)).cast("long")
    often = cut(kinds.select(F.col("_order").alias("_often"), F.least("_n", parts).alias("_parts")).where("_parts > 1"))
    bucket = F.pmod(F.xxhash64(F.lit(~seed), "_order"), F.lit(buckets))
    rows = docs.select(told.alias("_order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once, repeated = F.col("_order") == F.col("_often"), often.count()
    if repeated:
        often = F.broadcast(often) if repeated <= FEW else often
        # their places are fixed in the shared folder, as counts and rows must agree on them
        hot = rows.join(often, once).withColumn("_nth", F.pmod(F.monotonically_increasing_id(), "_parts"))
        hot = cut(hot.select(F.pmod(bucket + F.col("_nth"), F.lit(buckets)).alias("_bucket"), "_order", "row"))
        rows, kinds = (df.join(often, once, "left_anti") for df in (rows, kinds))
    sizes = kinds.groupBy(bucket.alias("_bucket")).agg(F.sum("_n").alias("_n"))
    rows = rows.select(bucket.alias("_bucket"), "_order", "row")
    if repeated:
        rows = rows.unionByName(hot)
        sizes = sizes.unionByName(hot.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))).groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    before = starts(sizes, [], "_bucket", "_n")

    def fisher_yates(table: pa.Table, place: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_order").to_numpy(), kind="stable")
        rng = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, place.column("_bucket")[0].as_py()]))
        rng.shuffle(order)  # numpy's shuffle is Fisher and Yates's
        start = place.column("start")[0].as_py()
        return pa.table(
            {
                "place": pa.array(np.arange(start, start + table.num_rows), pa.int64()),
                "row": table.column("row").combine_chunks().take(pa.array(order)),
            }
        )

    schema = spark.createDataFrame([], rows.schema).select(F.lit(0).cast("long").alias("place"), "row").schema
    # as many partitions as tasks of TASK_BYTES need, whatever the session's number; each takes several buckets
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    placed = rows.repartition(spread, "_bucket").groupBy("_bucket").cogroup(before.groupBy("_bucket")).applyInArrow(fisher_yates, schema)
    shard = F.expr(f"cast((place * {shards}) div {max(n, 1)} as int)")
    return placed.select(shard.alias("shard"), "place", "row").select(
        "shard", F.expr(f"place - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"), "row"
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet files under path/shard=N, each in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
