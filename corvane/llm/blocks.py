"""Distinct texts in blocks, and which keys of a block other blocks have too.

Whether a key repeats is settled without a row for each key: a block sends its distinct keys as sorted numbers of four
bytes, one blob for each range of keys, and gets two bits for each back. A key comes once from each block, so no key is
larger than the number of blocks, however often it occurs. Keys are cut to 32 bits within their range; where two fall
together by chance, texts are compared that need not be, and nothing else changes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20  # of texts
LEAST_BLOCKS = 64
RANGE_BYTES = 4 << 20  # of keys that meet in one task
LARGEST = 2**63 - 1  # stands for a null id


def text_ids(text) -> list:
    """Two hashes that tell texts apart, 95 bits."""
    return [F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(7), text).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("u2")]


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def number_of_blocks(size: int, block_bytes: int | None = None) -> int:
    return max(LEAST_BLOCKS, -(-size // (block_bytes or BLOCK_BYTES)))


def block_of(u1, blocks: int):
    return F.pmod(u1, F.lit(blocks)).cast("int")


def text_blocks(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(block, u1, u2, least, copies, data): each text once, with the least id and the number of rows that have it.

    size: bytes of all texts. Ids that are null or no numbers count as the largest, null texts as empty. A block has about BLOCK_BYTES, or one
    longer text. Copies within a task are joined before the shuffle, those of other tasks meet one by one behind it.
    Whatever reads it should read all columns: then Spark shuffles the texts once for all its uses.
    """
    blocks = number_of_blocks(size, block_bytes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*text_ids(text), F.coalesce(F.col(id_col).try_cast("long"), F.lit(LARGEST)).alias("least"), text.cast("binary").alias("data"))

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # of texts this task has sent; when it is too large, texts are sent again
        for b in batches:
            new, best, count = [], {}, {}
            for i, (u1, u2, least) in enumerate(zip(*(b.column(c).to_pylist() for c in ("u1", "u2", "least")))):
                k = u1, u2
                if k not in seen:
                    seen.add(k)
                    new.append(i)
                best[k] = min(least, best.get(k, least))
                count[k] = count.get(k, 0) + 1
            if len(seen) > 200_000:
                seen.clear()
            texts = b.column("data").take(pa.array(new, pa.int32()))
            sent = list(zip(*(b.column(c).take(pa.array(new, pa.int32())).to_pylist() for c in ("u1", "u2"))))
            told = set(sent)
            rest = [k for k in best if k not in told]  # sent before: these go on without the text
            keys = sent + rest
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32())]
            cols += [pa.array([x[k] for k in keys], pa.int64()) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([texts, pa.nulls(len(rest), texts.type)])], ["u1", "u2", "least", "copies", "data"])

    sent = rows.mapInArrow(first_of_each, "u1 long, u2 int, least long, copies long, data binary")
    block = block_of(F.col("u1"), blocks).alias("block")
    # joins would add this filter to some uses and not to others; with the same plan everywhere the texts move once
    sent = sent.where("u1 is not null and u2 is not null").select(block, "*").where("block is not null").repartition("block")
    return sent.groupBy("block", "u1", "u2").agg(
        F.min("least").alias("least"), F.sum("copies").alias("copies"), F.first("data", ignorenulls=True).alias("data")
    )


def in_order(texts: pa.Table) -> pa.Table:
    """The texts of a block in the order that numbers them; it follows from the texts alone."""
    return texts.sort_by([("u1", "ascending"), ("u2", "ascending")]).combine_chunks()


class Ranges:
    """Keys of 64 bits, cut to a range and 32 bits within it."""

    def __init__(self, expected: int):
        self.bits = min(24, max(6, (4 * expected // RANGE_BYTES).bit_length()))

    def cut(self, keys: np.ndarray) -> np.ndarray:
        # least hashes are small numbers, so they are spread over all ranges first
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32 - self.bits)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, bounds) of sorted keys that are cut."""
        own = (keys >> np.uint64(32)).astype(np.int64)
        ranges, begin = np.unique(own, return_index=True)
        return ranges, np.append(begin, len(keys))

    def rows(self, block: int, keys: np.ndarray, crowded: np.ndarray) -> pa.Table:
        """What a block sends; keys: cut, sorted, each once; crowded: those that the block alone makes common."""
        ranges, at = self.split(keys)
        low = keys.astype("<u4")
        blobs = [low[i:j].tobytes() for i, j in zip(at, at[1:])]
        bits = [np.packbits(crowded[i:j]).tobytes() if crowded[i:j].any() else None for i, j in zip(at, at[1:])]
        cols = [pa.array(ranges, pa.int32()), pa.array(np.full(len(ranges), block), pa.int32()), pa.array(blobs, pa.binary()), pa.array(bits, pa.binary())]
        return pa.table(cols, ["range", "block", "keys", "crowded"])

    def flags(self, keys: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(in other blocks too, common) for the keys that a block has sent."""
        out = np.zeros((2, len(keys)), bool)
        ranges, at = self.split(keys)
        for r, *bits in zip(*(answers.column(c).to_pylist() for c in ("range", "repeated", "common"))):
            i = np.searchsorted(ranges, r)
            for o, x in zip(out, bits):
                if x is not None:
                    o[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(x, np.uint8))[: at[i + 1] - at[i]]
        return out[0], out[1]


SENT = "range int, block int, keys binary, crowded binary"


def answers(sent: DataFrame, common: int) -> DataFrame:
    """(block, range, repeated, common), bits for the keys of a row of `sent`: whether two blocks or more have a key, and
    whether `common` blocks do or it is crowded in one. No row where all bits are 0; null for `common` where its are."""

    def meet(t: pa.Table) -> pa.Table:
        blobs, crowded = (t.column(c).to_pylist() for c in ("keys", "crowded"))
        keys = np.frombuffer(b"".join(blobs), "<u4")
        size = [len(x) // 4 for x in blobs]
        full = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] if x else np.zeros(n, np.uint8) for x, n in zip(crowded, size)])
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        count = np.diff(np.append(begin, len(keys)))
        repeated, many = np.empty(len(keys), bool), np.empty(len(keys), bool)
        repeated[order] = np.repeat(count > 1, count)
        many[order] = np.repeat((count >= common) | (np.maximum.reduceat(full[order], begin) > 0), count)
        out, j = [], 0
        for block, r, n in zip(t.column("block").to_pylist(), t.column("range").to_pylist(), size):
            i, j = j, j + n
            if repeated[i:j].any() or many[i:j].any():
                out.append((block, r, np.packbits(repeated[i:j]).tobytes(), np.packbits(many[i:j]).tobytes() if many[i:j].any() else None))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "range", "repeated", "common"])

    return sent.groupBy("range").applyInArrow(meet, "block int, range int, repeated binary, common binary")
