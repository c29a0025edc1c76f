"""Exact substring dedup over suffix arrays, sorted deep and shallow.

A byte goes if a string of `window` bytes covers it that also starts in a document with a smaller id. One suffix array of
the corpus fits nowhere, and most suffixes repeat nothing, so suffixes are first dealt out by what repeats can share:

1. Texts are put once each into blocks (see blocks). The anchor of a suffix is the least gram, by hash, of `gram` bytes in
   its window; it follows from the window alone, and neighbouring suffixes mostly share it. Blocks send their distinct
   anchors and learn which of them other blocks have too.
2. Suffixes behind an anchor that repeats are sent to its group as runs of neighbours with their bytes. Of equal runs in
   a block only those of the least id go, so a group gets some rows from each block, however often a passage occurs.
3. A group merges equal runs, and sorts the suffixes of those that differ to the depth of a window: multikey quicksort to
   a shallow depth, blind tries below. Suffixes that are equal to that depth are neighbours then, and each learns the
   least id among them.
4. Suffixes with a larger id than that go back to their block, where the bytes that they cover are taken out.

An anchor that `COMMON` blocks have, or one block `HERE` times, would make a large group, as at the ends of a passage its
runs differ from text to text. There each window is a row by itself, and the least id of equal windows is a partially
aggregated minimum with a join back to it, which may be split.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import blocks
from corvane.llm.arrays import pieces_of, runs_of_rows, stretches
from corvane.llm.common import cut
from corvane.llm.deepshallow import deep_shallow_sort

WINDOW = 50
GRAM = 24
COMMON, HERE = 1024, 64  # blocks with an anchor, and runs with it in one block
PART_BYTES = 4 << 20  # of a block that are looked at side by side
RUN = 1024  # windows of a run
GROUP_BYTES = 8 << 20  # of runs that are sorted side by side

_HASHED = 1 << 16
_BYTE = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes, never 0, of the `gram` bytes from each place on: those of twice as many bytes from two halves."""
    out = np.zeros(max(0, len(data) - gram + 1), np.uint64)
    for at in range(0, len(out), _HASHED):
        x, size, whole, done = _BYTE[data[at : at + _HASHED + gram - 1]], 1, None, 0
        while True:
            if gram & size:
                power = np.uint64(pow(_FACTOR, size, 2**64))
                whole = x if whole is None else whole[: len(x) - done] * power + x[done : done + len(whole)]
                done += size
            if 2 * size > gram:
                break
            x = x[:-size] * np.uint64(pow(_FACTOR, size, 2**64)) + x[size:]
            size *= 2
        n = min(_HASHED, len(out) - at)
        out[at : at + n] = _mix(whole[:n])
    return out


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, text) of the runs of neighbouring windows of a text that share an anchor."""
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    least = _sliding_min(_gram_hashes(data, gram), window - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[: len(least)] == text[window - 1 :]
    start, n = stretches(whole, least, text[: len(least)])
    if len(n) and n.max() > RUN:
        more = -(-n // RUN)
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        start, n = np.repeat(start, more) + k * RUN, np.minimum(np.repeat(n, more) - k * RUN, RUN)
    return start, n, least[start], text[start]


def _parts(texts: pa.Table, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(number of the first text, bytes, offsets, place of the first byte in its text) of a block in parts.

    A text of more than PART_BYTES comes in parts of its own that overlap, so that each window is in one of them.
    """
    column = texts.column("data").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    for at, _, data, offsets in runs_of_rows(column, PART_BYTES):
        if len(data) <= PART_BYTES:
            yield at, data, offsets, 0
        else:
            for base in range(0, len(data) - window + 1, PART_BYTES):
                part = data[base : base + PART_BYTES + window - 1]
                yield at, part, np.array([0, len(part)]), base


def _scan(texts: pa.Table, window: int, gram: int) -> list[tuple]:
    """(number of the first text, bytes, offsets, place of the first byte in its text, runs by anchor) of a block's parts."""
    return [(*part, _anchors(part[1], part[2], window, gram)) for part in _parts(texts, window)]


def _block_keys(parts: list[tuple], ranges: blocks.Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors of a block, cut and sorted, which of them two of its texts have, and which are crowded."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(ranges.cut(found[2]) for *_, found in parts)])
    texts = np.concatenate([np.zeros(0, np.int64), *(first + found[3] for first, *_, found in parts)])
    order = np.argsort(keys, kind="stable")  # texts ascend
    keys, texts = keys[order], texts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    end = np.append(begin[1:], len(keys))[: len(begin)]
    return keys[begin], texts[begin] != texts[end - 1], end - begin >= HERE


_RUNS = "key long, least long, block int, text int, at int, n int, bytes binary"


def _single(start: np.ndarray, n: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Runs as single windows."""
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return [np.repeat(start, n) + inside, np.ones(len(inside), np.int64), *(np.repeat(x, n) for x in more)]


def _runs(texts: pa.Table, answers: pa.Table, ranges: blocks.Ranges, window: int, gram: int, common: bool) -> pa.Table:
    """Runs of windows behind anchors that repeat, with their bytes; without, where a smaller id in the block has them.

    Of windows behind common anchors only runs without bytes are given; or with `common` only those with bytes, one by one.
    """
    texts = blocks.in_order(texts)
    some = not common or answers.column("common").null_count < answers.num_rows
    parts = _scan(texts, window, gram) if some else []
    keys, here, _ = _block_keys(parts, ranges)
    elsewhere, many = ranges.flags(keys, answers) if some else (here, here)
    rare = (elsewhere | here) & ~many
    own, block, out = texts.column("least").to_numpy(), texts.column("block")[0].as_py(), []

    def row(key, least, text, at, n, spelled) -> pa.Table:
        cols = [np.asarray(key, np.uint64).view(np.int64), least, np.full(len(n), block, np.int32), text.astype(np.int32), at.astype(np.int32), n.astype(np.int32)]
        spelled = pa.nulls(len(n), pa.binary()) if spelled is None else spelled
        return pa.table([*map(pa.array, cols), spelled], ["key", "least", "block", "text", "at", "n", "bytes"])

    for first, data, offsets, base, found in parts if (rare | many).any() else ():
        at = np.searchsorted(keys, ranges.cut(found[2]))
        for single in (True,) if common else (False, True):
            keep = (many if single else rare)[at]
            start, n, anchor, text = (x[keep] for x in found)
            if single:
                start, n, anchor, text = _single(start, n, anchor, text)
            spelled = pieces_of(data, start, start + n + window - 1)
            same, least, place = spelled.dictionary_encode().indices.to_numpy(), own[first + text], base + start - offsets[:-1][text]
            low = np.full(int(same.max(initial=-1)) + 1, blocks.LARGEST)
            np.minimum.at(low, same, least)
            known = least > low[same]
            if common or not single:
                i = np.flatnonzero(~known)
                out.append(row(anchor[i], least[i], first + text[i], place[i], n[i], spelled.take(pa.array(i))))
            if not common:  # these need no group, so they are spread by their place; single neighbours become one row
                i, size = stretches(known, start - np.arange(len(start))) if single else (np.flatnonzero(known), n[known])
                out.append(row(_mix(place[i].astype(np.uint64) * np.uint64(_FACTOR) + start[i].astype(np.uint64)), least[i], first + text[i], place[i], size, None))
    none = np.zeros(0, np.int64)
    return pa.concat_tables([row(none, none, none, none, none, None), *out])


_FOUND = "block int, text int, at int, n int"


def _least_of_windows(data: np.ndarray, starts: np.ndarray, least: np.ndarray, window: int, sizes: np.ndarray) -> np.ndarray:
    """For each window the least id among the windows of its group with the same bytes; sizes: of the groups, in a row."""
    order, new = deep_shallow_sort(data, starts, window, sizes=sizes)
    out = np.empty(len(starts), np.int64)
    group = np.cumsum(new) - 1
    out[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[group] if len(starts) else 0
    return out


def _meet_groups(t: pa.Table, window: int) -> pa.Table:
    """(block, text, at, n): the windows with a larger id than equal ones; `t` holds whole groups of runs, by key."""
    spelled = t.column("bytes").combine_chunks()
    spelled = spelled.chunk(0) if isinstance(spelled, pa.ChunkedArray) else spelled
    coded = spelled.dictionary_encode()
    same, runs = coded.indices.to_numpy(), coded.dictionary
    key, least, n, at = (t.column(c).to_numpy() for c in ("key", "least", "n", "at"))
    low = np.full(len(runs), blocks.LARGEST)
    np.minimum.at(low, same, least)
    # runs that differ meet in a group: their suffixes are sorted
    key_of, size = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    key_of[same], size[same] = key, n
    _, group, members = np.unique(key_of, return_inverse=True, return_counts=True)
    mixed = members[group] > 1
    met = np.flatnonzero(mixed)[np.argsort(group[mixed], kind="stable")]
    m = size[met]
    begin = np.zeros(len(runs), np.int64)
    begin[met] = np.cumsum(m) - m
    offsets, data = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset :], np.frombuffer(runs.buffers()[2], np.uint8)
    inside = np.arange(m.sum()) - np.repeat(begin[met], m)
    sizes = np.bincount(group[met], weights=m).astype(np.int64) if len(met) else m
    lows = _least_of_windows(data, np.repeat(offsets[:-1][met], m) + inside, np.repeat(low[met], m), window, sizes)
    # rows whose run is alone in its group: all windows or none
    alone = ~mixed[same]
    rows = [np.flatnonzero(alone & (least > low[same]))]
    starts, sizes = [at[rows[0]]], [n[rows[0]]]
    some = np.flatnonzero(~alone)
    m = n[some]
    inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    row = np.repeat(some, m)
    gone = lows[np.repeat(begin[same[some]], m) + inside] < least[row]
    s, k = stretches(gone, row)
    rows.append(row[s])
    starts.append(at[row[s]] + inside[s])
    sizes.append(k)
    rows = pa.array(np.concatenate(rows))
    cols = [t.column("block").take(rows), t.column("text").take(rows), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32))]
    return pa.table(cols, ["block", "text", "at", "n"])


def _meet(runs: DataFrame, window: int) -> DataFrame:
    """Windows with a larger id than equal ones; each key's rows are in one partition, in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole groups, but for the last

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t = pa.concat_tables(held).combine_chunks()
            key = t.column("key").to_numpy()
            end = t.num_rows if last else int(np.searchsorted(key, key[-1]))
            if end:
                yield from _meet_groups(t.slice(0, end).combine_chunks(), window).to_batches()
                held, size = [t.slice(end)], 0

        for b in batches:
            t = pa.Table.from_batches([b])
            known = t.filter(pc.is_null(t.column("bytes")))
            if known.num_rows:
                yield from known.select(["block", "text", "at", "n"]).to_batches()
                t = t.filter(pc.is_valid(t.column("bytes")))
            if t.num_rows:
                held.append(t)
                size += t.column("bytes").nbytes
                if size > GROUP_BYTES:
                    yield from groups(False)
        if held:
            yield from groups(True)

    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def repeated_windows(texts: DataFrame, size: int, window: int = WINDOW, gram: int = GRAM, common: int | None = None) -> DataFrame:
    """(block, text, at, n): n windows from byte `at` of a text on whose bytes also start in a text with a smaller least id.

    texts: of blocks.text_blocks; size: bytes of all. Texts are numbered in the order of their hashes in their block.
    """
    ranges = blocks.Ranges(2 * size // (window - gram + 2))

    def send(t: pa.Table) -> pa.Table:
        t = blocks.in_order(t)
        keys, _, crowded = _block_keys(_scan(t, window, gram), ranges)
        return ranges.rows(t.column("block")[0].as_py(), keys, crowded)

    told = cut(blocks.answers(texts.groupBy("block").applyInArrow(send, blocks.SENT), common or COMMON))

    def runs(common: bool) -> DataFrame:
        both = texts.groupBy("block").cogroup(told.groupBy("block"))
        return both.applyInArrow(lambda t, a: _runs(t, a, ranges, window, gram, common), _RUNS)

    found = _meet(runs(False), window)
    if not told.where("common is not null").isEmpty():
        rows = runs(True)
        low = rows.groupBy("bytes").agg(F.min("least").alias("low"))
        later = rows.join(low, "bytes").where("least > low")
        found = found.unionByName(later.select("block", "text", "at", "n"))
    return found


def _taken_out(t: pa.Table, found: pa.Table, window: int, keep: bool) -> pa.Table:
    """For the texts of a block: bytes, bytes removed, removed runs, the digest of what is left, and what is left."""
    t = blocks.in_order(t)
    text, at, n = (found.column(c).to_numpy() for c in ("text", "at", "n"))
    order = np.lexsort((at, text))
    text, start, end = text[order], at[order].astype(np.int64), (at[order].astype(np.int64) + n[order] + window - 1)
    first, out = np.searchsorted(text, np.arange(t.num_rows + 1)), []
    for i, value in enumerate(t.column("data")):
        data = memoryview(value.as_buffer())
        begin, stop = start[first[i] : first[i + 1]], np.maximum.accumulate(end[first[i] : first[i + 1]])
        gap = np.flatnonzero(begin[1:] > stop[:-1])
        begin, stop = np.append(begin[:1], begin[gap + 1]).tolist(), np.append(stop[gap], stop[-1:]).tolist()
        sha, left = hashlib.sha256(), []
        for a, b in zip([0, *stop], [*begin, len(data)]):
            sha.update(data[a:b])
            if keep:
                left.append(bytes(data[a:b]))
        out.append((len(data), sum(stop) - sum(begin), len(begin), sha.hexdigest(), b"".join(left) if keep else None))
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
    cols = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
    return pa.table([*t.select(["u1", "u2", "least"]).columns, *cols], ["u1", "u2", "least", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_copies(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_bytes: bool = True, common: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_bytes, kept.

    Texts are UTF-8 bytes, null texts empty. A byte goes if `window` bytes cover it that also start in a row with a smaller
    id; repeats within a document and among rows that share an id stay. A null id counts as larger than any other, and
    null ids as one. `kept` is binary, as a cut may fall into a character. An empty table gives none; columns other than
    the two named are not read, so their names cannot clash. The part of a text that is in memory at a time is
    bounded but for the text itself and its windows that repeat.
    """
    size = blocks.total_bytes(docs, text_col)
    texts = blocks.text_blocks(docs, size, id_col, text_col)
    found = repeated_windows(texts, size, window, gram, common)
    schema = "u1 long, u2 int, least long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda t, f: _taken_out(t, f, window, keep_bytes), schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = docs.select(F.col(id_col).alias("doc_id"), *blocks.text_ids(text))
    # a later copy of a whole text
    gone = (F.coalesce(F.col("doc_id").cast("long"), F.lit(blocks.LARGEST)) > F.col("least")) & (F.col("n_bytes") >= window)
    none = F.lit("").cast("binary")
    out = names.join(done, ["u1", "u2"]).select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(none, 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, none).otherwise(F.col("kept")).alias("kept"),
    )
    return out if keep_bytes else out.drop("kept")
