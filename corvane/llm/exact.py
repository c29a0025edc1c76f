"""Exact dedup by composable polynomial fingerprints.

The fingerprint of bytes b_0 .. b_(n-1) is the sum of b_i * B^(n-1-i) modulo two primes. Fingerprints compose: that of
two parts in a row is left * B^(length of right) + right. So a text is hashed in chunks; those of a huge document go
to different tasks, are shifted by what follows them and added up. Texts with equal fingerprints and lengths are then
compared with one of them, chunk by chunk; those that differ form groups of their own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, one_row_of_each

CHUNK_BYTES = 1 << 16
HUGE_BYTES = 1 << 20
ROWS_A_SALT = 512


@dataclass(frozen=True)
class Polynomial:
    """Primes below 2^31 and a base for each. Chunks of up to 2^24 bytes can be summed before they are reduced."""

    primes: tuple[int, int] = (2**31 - 1, 2**31 - 19)
    bases: tuple[int, int] = (911_382_323, 972_663_749)
    _powers: dict = field(default_factory=dict, compare=False, repr=False)

    def _weights(self, n: int) -> np.ndarray:
        """Powers n-1 .. 0 of both bases, by doubling."""
        have = self._powers.get("w")
        if have is None or have.shape[1] < n:
            rows = []
            for p, base in zip(self.primes, self.bases):
                w = np.ones(1, np.uint64)
                while len(w) < n:
                    w = np.concatenate([w, w * np.uint64(pow(base, len(w), p)) % np.uint64(p)])
                rows.append(w[::-1])
            have = self._powers["w"] = np.stack(rows)
        return have[:, have.shape[1] - n :]

    def chunk(self, data: bytes) -> tuple[int, int]:
        if not data:
            return 0, 0
        x = np.frombuffer(data, np.uint8).astype(np.uint64)
        a, b = (x * w for w in self._weights(len(x)))
        return int(a.sum()) % self.primes[0], int(b.sum()) % self.primes[1]

    def shift(self, h: tuple[int, int], n: int) -> tuple[int, int]:
        """The part that `h` has in the fingerprint of a text in which n bytes follow it."""
        return tuple(x * pow(b, n, p) % p for x, b, p in zip(h, self.bases, self.primes))

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
        return tuple((x + y) % p for x, y, p in zip(self.shift(left, right_bytes), right, self.primes))

    def of(self, data: bytes, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
        h = (0, 0)
        for at in range(0, len(data), chunk_bytes):
            h = self.combine(h, self.chunk(part := data[at : at + chunk_bytes]), len(part))
        return h


def _chunks(data: Column, n_bytes: Column, chunk_bytes: int) -> Column:
    """An array of structs (k, chunk); one empty chunk for an empty text."""
    last = F.greatest(F.lit(0), F.floor((n_bytes - 1) / chunk_bytes)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("k"), F.substring(data, k * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk")),
    )


def fingerprints(
    docs: DataFrame, poly: Polynomial, chunk_bytes: int = CHUNK_BYTES, huge_bytes: int = HUGE_BYTES
) -> DataFrame:
    """(doc_id, sha, n_bytes, h1, h2) for each row of docs(doc_id, data), where data is binary and not null."""
    sized = docs.select(
        "doc_id", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n_bytes"), "data"
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [poly.of(x.as_py(), chunk_bytes) for x in b.column("data")]
            cols = [b.column(0), b.column(1), b.column(2), *(pa.array([h[i] for h in hs], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sha", "n_bytes", "h1", "h2"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = (b.column(c).to_pylist() for c in ("n_bytes", "k"))
            follow = [max(0, x - (y + 1) * chunk_bytes) for x, y in zip(n, k)]
            hs = [poly.shift(poly.chunk(x.as_py()), f) for x, f in zip(b.column("chunk"), follow)]
            cols = [*b.columns[:4], *(pa.array([h[i] for h in hs], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "sha", "n_bytes", "h1", "h2"])

    small = sized.where(F.col("n_bytes") <= huge_bytes).mapInArrow(
        whole, "doc_id long, sha string, n_bytes long, h1 long, h2 long"
    )
    spread = docs.sparkSession.sparkContext.defaultParallelism
    huge = (
        sized.where(F.col("n_bytes") > huge_bytes)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "sha", "n_bytes", F.explode(_chunks(F.col("data"), F.col("n_bytes"), chunk_bytes)).alias("c"))
        .select("row", "doc_id", "sha", "n_bytes", "c.k", "c.chunk")
        .repartition(spread, "row", "k")
        .mapInArrow(parts, "row long, doc_id long, sha string, n_bytes long, h1 long, h2 long")
        .groupBy("row", "doc_id", "sha", "n_bytes")
        .agg((F.sum("h1") % poly.primes[0]).alias("h1"), (F.sum("h2") % poly.primes[1]).alias("h2"))
        .drop("row")
    )
    return small.unionByName(huge)


def _compare(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """(doc_id, sha, same): whether each text equals the one that its group has chosen, by chunks side by side.

    texts: doc_id, sha, data, h1, h2, n_bytes, size, lead (doc_id, sha of the chosen row). The chosen text is repeated
    once for every ROWS_A_SALT rows of its group, so no task gets a whole group.
    """
    key = ["h1", "h2", "n_bytes", "salt", "k"]
    salts = F.ceil(F.col("size") / ROWS_A_SALT).cast("int")
    cols = lambda df: df.select(
        "h1", "h2", "n_bytes", "salt", "doc_id", "sha", F.explode(_chunks(F.col("data"), F.col("n_bytes"), chunk_bytes)).alias("c")
    ).select(*key[:4], "doc_id", "sha", "c.k", "c.chunk")
    is_lead = F.struct("doc_id", "sha").eqNullSafe(F.col("lead"))
    lead = cols(texts.where(is_lead).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))))
    member = cols(texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), salts).cast("int")))
    lead = lead.select(*key, F.col("chunk").alias("wanted"))
    return (
        member.join(lead, key)
        .groupBy("doc_id", "sha", "h1", "h2", "n_bytes")
        .agg(F.bool_and(F.col("chunk") == F.col("wanted")).alias("same"))
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    poly: Polynomial | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    huge_bytes: int = HUGE_BYTES,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; a null counts as the empty text. The row with the largest doc_id stays;
    a null doc_id counts as smaller than any other. Of rows repeated with id and text, one stays. Columns other than
    the two named are not read, so their names cannot clash.
    """
    poly = poly or Polynomial()
    data = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    )
    rows = cut(fingerprints(data, poly, chunk_bytes, huge_bytes).withColumn("row", F.monotonically_increasing_id()))
    group = ["h1", "h2", "n_bytes"]

    def led(members: DataFrame) -> DataFrame:
        lead = members.groupBy(*group).agg(F.max(F.struct("doc_id", "sha")).alias("lead"), F.count(F.lit(1)).alias("size"))
        return members.join(lead.where("size > 1"), group)

    # the texts of rows that share fingerprint and length with another row; rows repeated with their id count once. The
    # join comes last, so that it can be split where a group is large
    wanted = led(rows.select("doc_id", "sha", *group).distinct()).select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), *group
    )
    texts = (
        data.withColumn("sha", F.sha2("data", 256))
        .join(wanted.hint("shuffle_hash"), F.col("sha").eqNullSafe(F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .drop("_id", "_sha")
        .dropDuplicates(["doc_id", "sha"])
    )
    open_texts, turn, split = cut(texts), 0, None
    while True:
        verdict = cut(_compare(led(open_texts), chunk_bytes).where("not same").select("doc_id", "sha"))
        if verdict.isEmpty():
            break
        turn += 1  # equal fingerprints, other texts: these go on to a group of their own
        apart = verdict.withColumn("turn", F.lit(turn))
        split = apart if split is None else split.unionByName(apart)
        names = verdict.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"))
        match = F.col("sha").eqNullSafe(F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        open_texts = cut(open_texts.join(names, match, "left_semi"))
    if split is None:
        rows = rows.withColumn("turn", F.lit(0))
    else:
        last = split.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(F.max("turn").alias("turn"))
        match = F.col("sha").eqNullSafe(F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        rows = rows.join(last, match, "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    classes = rows.groupBy(*group, "turn").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )
    return rows.join(classes, [*group, "turn"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact dedup keeps, with their columns."""
    kept = exact_duplicates(docs).where("kept")
    return one_row_of_each(docs, kept.select("doc_id", F.col("text_sha256").alias("text_digest")))
