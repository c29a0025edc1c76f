import zlib
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import queries, sharding
from tests.llm import fixtures as fx


def check(docs, shards, **how):
    got = sharding.shuffle_to_shards(docs, shards, **how).collect()
    assert Counter(map(repr, (r.row for r in got))) == Counter(map(repr, docs.collect()))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    n = docs.count()
    sizes = [len(slots.get(i, ())) for i in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {repr(r.row): (r.shard, r.slot) for r in got}


def test_laws(spark):
    docs = fx.awkward_docs(spark)
    check(docs, 24)
    check(docs, 3, bucket_bytes=500)
    check(fx.clashing(docs), 5)
    check(spark.read.parquet(f"{fx.SF}/documents.parquet"), 24)
    assert sharding.shuffle_to_shards(spark.createDataFrame([], fx.DOCS), 4).collect() == []


def test_repeated_rows_are_spread(spark):
    hot = spark.range(3000).selectExpr("7L as doc_id", "'same text' as text", "id as n").repartition(6)
    more = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as doc_id", "concat('t', id % 5) as text", "id as n")
    docs = hot.unionByName(more)
    got = check(docs, 10, repeats=50)
    assert len(got) == 3300
    shards = Counter(r.shard for r in sharding.shuffle_to_shards(docs, 10, repeats=50).where("row.doc_id = 7").select("shard").collect())
    assert len(shards) == 10 and max(shards.values()) < 400


def test_long_repeated_rows_are_spread(spark, monkeypatch):
    """900 rows without an id and with one text of 200 KB: buckets are bounded in bytes."""
    text = fx.words(50_000, 1)[:200_000]
    docs = spark.range(900).selectExpr("cast(null as long) as doc_id", "id as n").withColumn("text", F.lit(text)).repartition(6)
    got = sharding.shuffle_to_shards(docs, 10).select("shard", "slot", "row.n")
    rows = got.collect()
    assert set(Counter(r.shard for r in rows).values()) == {90} and sorted(r.n for r in rows) == list(range(900))
    largest, original = [], sharding.starts
    monkeypatch.setattr(sharding, "starts", lambda sizes, *more: (largest.append(sizes.agg(F.max("_n")).first()[0]), original(sizes, *more))[1])
    sharding.shuffle_to_shards(docs, 10)
    assert largest[0] * 200_000 <= 16 << 20


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op2_shuffled_shards"](spark, "/root/testdata/sf0.01").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots[i]) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_order_depends_on_the_seed_only(spark):
    docs = spark.read.parquet(f"{fx.SF}/documents.parquet")
    first = check(docs, 7, seed=1)
    assert check(docs.repartition(13).orderBy("text"), 7, seed=1) == first
    assert check(docs, 7, seed=2) != first


def test_shuffled_well(spark):
    docs = spark.range(2400).selectExpr("id doc_id", "cast(id as string) text")
    got = check(docs, 24)
    tens = Counter()
    for r in sharding.shuffle_to_shards(docs, 24).select("shard", "row.doc_id").collect():
        tens[r.shard, r.doc_id // 240] += 1
    assert len(got) == 2400 and len(tens) == 240 and max(tens.values()) < 30


def test_written_shards(spark, tmp_path):
    docs = fx.awkward_docs(spark)
    sharding.write_shards(sharding.shuffle_to_shards(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
