"""Substring dedup over prefix-partitioned suffix trees of words.

A window is `window` words of one text. Every suffix of a text that is long enough starts with a window; in a suffix
tree of all texts the windows that occur more than once are the internal nodes at that depth, and runs of them along a
text are its maximal repeats. One tree of all suffixes fits nowhere, so suffixes are dealt out by prefixes of variable
length, and each group grows its own subtree down to the depth of a window:

1. The prefix of a suffix ends with the least gram (by hash) of `gram` words in its window, so its length, between `gram`
   and `window`, follows from the window's words alone. Prefixes with one end are dealt to one group, as neighbouring
   suffixes mostly share it. The first pass is over the ends only, about two in every window - gram + 2 words: texts lie
   in blocks, and a block sends its distinct ends and learns which of them other blocks have too (see blocks).
2. Ends that occur once lead to leaves: nothing that starts there repeats. Of the others blocks know which are common.
3. Suffixes behind a repeated end are sent to its group as runs, with their words. A group of a common end would be
   large, so there each prefix is lengthened to the whole window, which is then a node by itself: rows with equal windows
   are counted, partially aggregated, and joined to the counts, which may be split.
4. Each group sorts its suffixes by their words: the names of all prefixes of 1, 3, 9 .. words are worked out from
   those of the shorter ones, up to the depth of a window. Suffixes with one name there meet in a deep internal node.

Words are compared, not hashes of them; hashes only deal them out. Copies of a whole text are set aside first, by 95
bits of hashes. Within a block, what is seen to repeat is not sent more than once, so a group has a few rows for each
block at most, and no more than COMMON blocks, however many rows share a passage. Very long texts are taken in parts that overlap by a window.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import blocks
from corvane.llm.arrays import SPACE, bounds, stretches
from corvane.llm.common import cut

WINDOW = 35
GRAM = 12
BATCH_BYTES = 4 << 20
#: An end is common if it occurs so often in one block, or in so many blocks.
COMMON_HERE, COMMON = 64, 1024
_SENT_WORDS = 1 << 18  # words in a batch of suffixes

_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
# odd, so they have inverses modulo 2^64
_FACTOR, _WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        row = np.full(max(n, 1 << 20), base, np.uint64)
        row[0] = 1
        _POWERS[base] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i modulo 2^64; see _between."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=out[1:])
    return out


def _between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The sum of values[start + i] * base^i up to end, for each start and end."""
    return (sums[end] - sums[start]) * _powers(pow(base, -1, 2**64), len(sums))[start]


def _sliding(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """f over every n values in a row, by doubling."""
    size = 1
    while 2 * size <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal keys: the first row of each class, the class of each row, the size of each class."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.bincount(which)


def _word_numbers(column: pa.Array) -> np.ndarray:
    """The same number for the same word."""
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _names(words: np.ndarray, depth: int) -> np.ndarray:
    """For each place the name of the `depth` words from there on, names in the order of the words' numbers.

    A level of the tree at a time: a name at depth d is a node there, and the name of a longer stretch follows from
    those of the two or more stretches that it is made of, the last of which may overlap the one before.
    """
    names, d = words, 1
    while d < depth:
        bits = max(1, int(names.max(initial=0)).bit_length())
        at = sorted({min(k * d, depth - d) for k in range(max(2, 63 // bits))})
        n = max(0, len(names) - at[-1])
        key = np.zeros(n, np.int64)
        for k in at:
            key = key << bits | names[k : k + n]
        names, d = np.unique(key, return_inverse=True)[1], at[-1] + d
    return names


class _Texts:
    """Words and hashes of some texts that lie one behind the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.window, self.gram, self.data = window, gram, data
        starts, ends = self.starts, self.ends_of_words = bounds(data, offsets)
        self.first = np.searchsorted(starts, offsets)  # of each text, and an end
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # bytes in blocks: eight times their size is needed meanwhile
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20))))
            base = starts[at]
            sums = _sums(_BYTE[data[base : ends[to - 1]]], _FACTOR)
            hashes[at:to] = _between(sums, starts[at:to] - base, ends[at:to] - base, _FACTOR)
            at = to
        hashes = _mix(hashes + (ends - starts).astype(np.uint64))
        n = self.n = len(starts)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if n < window:
            self.least = np.zeros(0, np.uint64)
            return
        sums, at = _sums(hashes, _WORD_FACTOR), np.arange(n)
        self.grams = _mix(_between(sums, at[: n - gram + 1], at[gram - 1 :] + 1, _WORD_FACTOR)) | np.uint64(1)
        self.windows = _mix(_between(sums, at[: n - window + 1], at[window - 1 :] + 1, _WORD_FACTOR) + np.uint64(1))
        whole = self.text[: n - window + 1] == self.text[window - 1 :]
        #: of the grams in the window from each word; 0 where a window would leave its text
        self.least = np.where(whole, _sliding(np.minimum, self.grams, window - gram + 1), np.uint64(0))

    def ends(self) -> np.ndarray:
        """The grams that are the least of some window."""
        if self.n < self.window:
            return np.zeros(0, np.int64)
        pad = np.zeros(self.window - self.gram, np.uint64)
        most = _sliding(np.maximum, np.concatenate([pad, self.least, pad]), self.window - self.gram + 1)
        return np.flatnonzero(most == self.grams)

    def spelled(self, words: np.ndarray) -> pa.Array:
        """The words with these numbers, each with a space behind it."""
        size = self.ends_of_words[words] - self.starts[words] + 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.full(offsets[-1], 0x20, np.uint8)
        own = np.repeat(self.starts[words] - offsets[:-1], size - 1)
        to = np.delete(np.arange(offsets[-1]), offsets[1:] - 1)
        out[to] = self.data[own + to]
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])

    def place(self, at: np.ndarray) -> np.ndarray:
        """The number of each word in its text."""
        return at - self.first[self.text[at]]


def _batches(b: pa.RecordBatch, column: str, most: int, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(from row, to row, bytes, offsets, number of the first word) of runs of rows with about `most` bytes.

    A row with more comes in parts; each window of it is in one of them.
    """
    col = b.column(column)
    if not len(col):
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        part, offsets = data[offs[at] : offs[to]], (offs[at : to + 1] - offs[at]).astype(np.int64)
        if len(part) <= most:
            yield at, to, part, offsets, 0
        else:
            starts, ends = bounds(part, offsets)
            first = 0
            while first < len(starts):
                last = max(first + window, int(np.searchsorted(ends, starts[first] + most)))
                whole = part[starts[first] : ends[min(last, len(ends)) - 1]]
                yield at, to, whole, np.array([0, len(whole)]), first
                if last >= len(starts):
                    break
                first = last - window + 1
        at = to


def _at(u2: np.ndarray, place: np.ndarray) -> np.ndarray:
    return u2.astype(np.int64) << 32 | place


def _scan(texts: pa.Table, window: int, gram: int) -> list[tuple[int, int, _Texts]]:
    """(number of the first text, number of its first word, words and hashes) of the parts of a block."""
    parts = (x for b in texts.to_batches() for x in _batches(b, "data", BATCH_BYTES, window))
    return [(at, base, _Texts(data, offsets, window, gram)) for at, _, data, offsets, base in parts]


def _block_keys(parts: list, ranges: blocks.Ranges) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of a block, cut and sorted, and how often each occurs."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(ranges.cut(t.grams[t.ends()]) for *_, t in parts if t.n >= t.window)]), return_counts=True)


_SUFFIXES = "key long, u1 long, at long, n int, words binary"


def _suffixes(texts: pa.Table, answers: pa.Table, ranges: blocks.Ranges, window: int, gram: int, common: bool) -> pa.Table:
    """Runs of suffixes by prefix: n windows from `at` on, with the words of these; without words where all repeat.

    With `common` the suffixes behind common ends, single windows with their words, each once; else all others.
    """
    texts = blocks.in_order(texts)
    some = not common or answers.column("common").null_count < answers.num_rows
    parts = _scan(texts, window, gram) if some else []
    keys, count = _block_keys(parts, ranges)
    elsewhere, many = ranges.flags(keys, answers) if some else (count > 1, count > 1)
    again = (elsewhere | (count > 1)) & ~many
    all_u1, all_u2 = texts.column("u1").to_numpy(), texts.column("u2").to_numpy()

    def rows(t, key, u1, u2, place, n, first=None):
        # first: the number of the first word of each run, or None
        for at, to in _parts(n + window - 1 if first is not None else np.ones(len(key), np.int64)):
            if first is None:
                words = pa.nulls(to - at, pa.binary())
            else:
                size = n[at:to] + window - 1
                begin = np.cumsum(size) - size
                spelled = t.spelled(np.repeat(first[at:to] - begin, size) + np.arange(size.sum()))
                offsets = np.frombuffer(spelled.buffers()[1], np.int32)
                ends = np.ascontiguousarray(offsets[np.concatenate([[0], begin + size])])
                words = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends), spelled.buffers()[2]])
            cols = [pa.array(np.asarray(key[at:to]).view(np.int64)), pa.array(u1[at:to]), pa.array(_at(u2[at:to], place[at:to])), pa.array(n[at:to].astype(np.int32)), words]
            yield pa.table(cols, ["key", "u1", "at", "n", "words"])

    out = [pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())], ["key", "u1", "at", "n", "words"])]
    for at, base, t in parts:
        if t.n < window:
            continue
        text = t.text[: len(t.least)]
        u1, u2 = all_u1[at + text], all_u2[at + text]
        s, n = stretches(t.least != 0, t.least)
        end = np.searchsorted(keys, ranges.cut(t.least[s]))
        single, rare = np.zeros(len(text), bool), np.zeros(len(text), bool)
        for mask, wanted in ((single, many), (rare, again)):
            mask[t.least != 0] = np.repeat(wanted[end], n)
        known = np.zeros(len(text), bool)

        # names of the windows that are looked at, from the words that they cover
        looked = single if common else single | rare
        edge = np.zeros(t.n + 1, np.int32)
        edge[: len(known)] += looked
        edge[window:] -= looked
        covered = np.cumsum(edge[:-1]) > 0
        names = _names(_word_numbers(t.spelled(np.flatnonzero(covered))), window)
        number = np.cumsum(covered) - 1  # of each covered word among them

        # by the window itself
        s = np.flatnonzero(single)
        one, which, count = _classes(names[number[s]])
        known[s[count[which] > 1]] = True
        if common:
            s = s[one]
            out += rows(t, t.windows[s], u1[s], u2[s], base + t.place(s), np.ones(len(s), np.int64), s)
            continue

        # by the end of the prefix; the first and last window say what a run of up to `window` windows holds
        s, n = stretches(rare, t.least, text)
        if len(s):
            one, which, count = _classes(names[number[s]], names[number[s + n - 1]], n)
            again_here = (count[which] > 1) & (n <= window)
            for i in np.flatnonzero(again_here):
                known[s[i] : s[i] + n[i]] = True
            send = ~again_here
            send[one] = True
            s, n = s[send], n[send]
            out += rows(t, t.least[s], u1[s], u2[s], base + t.place(s), n, s)

        s, n = stretches(known, text)
        out += rows(t, u1[s], u1[s], u2[s], base + t.place(s), n)
    return pa.concat_tables(out)


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of rows of about _SENT_WORDS in all."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _SENT_WORDS, "right")))
        yield at, to
        at = to


def _deep_nodes(words: pa.Array, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the run, length) of the stretches of suffixes that lie below an internal node at depth `window`.

    words: of each row, n + window - 1 of them, each with a space behind it. A whole group at least.
    """
    if not len(n):
        return (np.zeros(0, np.int64),) * 3
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    ends = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1]).astype(np.int32)
    single = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    size = n + window - 1
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    names = _names(_word_numbers(single), window)[(np.cumsum(size) - size)[row] + inside]
    order = np.argsort(names, kind="stable")  # suffixes in the order of their words
    meets = names[order[1:]] == names[order[:-1]]  # neighbours that share a window
    deep = np.zeros(len(names), bool)
    deep[order[1:][meets]] = deep[order[:-1][meets]] = True
    s, m = stretches(deep, row)
    return row[s], inside[s], m


def _meet(suffixes: DataFrame, window: int) -> DataFrame:
    """(u1, u2, start, n): runs of windows of a text that repeat. Each key's rows are in one partition, in a row."""

    def told(u1, at, start, n) -> pa.RecordBatch:
        at = np.asarray(at, np.int64)
        cols = [np.asarray(u1, np.int64), (at >> 32).astype(np.int32), ((at & (2**31 - 1)) + start).astype(np.int32), np.asarray(n, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u1", "u2", "start", "n"])

    def group(t: pa.Table) -> pa.RecordBatch:
        words = t.column("words").combine_chunks()
        row, start, n = _deep_nodes(words.chunk(0) if isinstance(words, pa.ChunkedArray) else words, t.column("n").to_numpy().astype(np.int64), window)
        return told(t.column("u1").to_numpy()[row], t.column("at").to_numpy()[row], start, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            known = b.column("words").is_null().to_numpy(zero_copy_only=False)
            own = t.filter(pa.array(known))
            yield told(own.column("u1").to_numpy(), own.column("at").to_numpy(), 0, own.column("n").to_numpy())
            own = t.filter(pa.array(~known))
            if own.num_rows:
                own = own if held is None else pa.concat_tables([held, own])
                key = own.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield group(own.slice(0, cut).combine_chunks())
                held = own.slice(cut)
        if held is not None:
            yield group(held.combine_chunks())

    return suffixes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u1 long, u2 int, start int, n int")


def repeats(texts: DataFrame, size: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(u1, u2, start, n) for the texts of blocks.text_blocks in which windows start that start elsewhere too.

    size: bytes of all texts. n windows from word `start` on; the words that they cover are the text's maximal repeats.
    Copies of whole texts are not looked at.
    """
    ranges = blocks.Ranges(size // 64)

    def send(t: pa.Table) -> pa.Table:
        t = blocks.in_order(t)
        keys, count = _block_keys(_scan(t, window, gram), ranges)
        return ranges.rows(t.column("block")[0].as_py(), keys, count >= COMMON_HERE)

    told = cut(blocks.answers(texts.groupBy("block").applyInArrow(send, blocks.SENT), COMMON))

    def suffixes(common: bool) -> DataFrame:
        both = texts.groupBy("block").cogroup(told.groupBy("block"))
        return both.applyInArrow(lambda t, a: _suffixes(t, a, ranges, window, gram, common), _SUFFIXES)

    found = _meet(suffixes(False), window)
    if not told.where("common is not null").isEmpty():
        rows = suffixes(True)
        deep = rows.join(rows.groupBy("words").agg(F.count(F.lit(1)).alias("same")).where("same > 1"), "words")
        place = F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast("int")
        found = found.unionByName(deep.select("u1", F.shiftright("at", 32).cast("int").alias("u2"), place.alias("start"), "n"))
    return found


def _without(data: pa.Buffer, begin: np.ndarray, end: np.ndarray, least: int | None, keep_text: bool) -> tuple:
    """(words, words removed, digest of the kept ones, their text) of a text without the words in begin .. end.

    least: all words go if there are so many. Long texts are taken in parts.
    """
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    if least is not None:
        if (n := sum(len(part.split()) for part in _text_parts(data))) >= least:
            return n, n, hashlib.sha256(b"").hexdigest(), "" if keep_text else None
        begin = end = begin[:0]
    total, kept, sha, texts = 0, 0, hashlib.sha256(), []
    for part in _text_parts(data):
        words = part.split()
        if len(begin):  # a word stays if the intervals that begin at it or before have ended
            at = np.arange(total, total + len(words))
            k = np.searchsorted(begin, at, "right") - 1
            words = [words[i] for i in np.flatnonzero((k < 0) | (end[k] <= at))]
            total += len(at)
        else:
            total += len(words)
        text = (b" " if kept and words else b"") + b" ".join(words)
        kept += len(words)
        sha.update(text)
        if keep_text:
            texts.append(text)
    return total, total - kept, sha.hexdigest(), b"".join(texts).decode() if keep_text else None


def _text_parts(data: pa.Buffer) -> Iterator[bytes]:
    """The text in parts of about BATCH_BYTES, cut in front of white space."""
    at, size = 0, data.size
    while at < size:
        to = min(size, at + BATCH_BYTES)
        while to < size:
            white = np.flatnonzero(SPACE[np.frombuffer(data.slice(to, min(1 << 16, size - to)), np.uint8)])
            if len(white):
                to += int(white[0])
                break
            to = min(size, to + (1 << 16))
        yield data.slice(at, to - at).to_pybytes()
        at = to


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    keep_text: bool = True,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept_text.

    Words are runs of anything but ASCII white space. Each word goes that a window covers whose words also start at
    another place, in this or another row; what stays is joined by single spaces. Null texts count as empty. Texts
    shorter than a window stay whole. Rows that repeat a text lose all of it if it has a window. Columns other than
    the two named are not read, so their names cannot clash.
    """
    size = blocks.total_bytes(docs, text_col)
    texts = blocks.text_blocks(docs, size, id_col, text_col)
    found = repeats(texts, size, window, gram).withColumn("block", blocks.block_of(F.col("u1"), blocks.number_of_blocks(size)))
    schema = "u1 long, u2 int, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def take_out(t: pa.Table, f: pa.Table) -> pa.Table:
        t = blocks.in_order(t)
        number = {k: i for i, k in enumerate(zip(t.column("u1").to_pylist(), t.column("u2").to_pylist()))}
        text = np.array([number[k] for k in zip(f.column("u1").to_pylist(), f.column("u2").to_pylist())], np.int64)
        order = np.argsort(text, kind="stable")
        begin, n = (f.column(c).to_numpy()[order].astype(np.int64) for c in ("start", "n"))
        at, out = np.searchsorted(text[order], np.arange(t.num_rows + 1)), []
        for i, (data, copies) in enumerate(zip(t.column("data"), t.column("copies"))):
            own, windows = begin[at[i] : at[i + 1]], n[at[i] : at[i + 1]]
            out.append(_without(data.as_buffer(), own, own + windows - 1 + window, window if copies.as_py() > 1 else None, keep_text))
        cols = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
        names = ["u1", "u2", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 + keep_text]
        return pa.table([t.column("u1"), t.column("u2"), *cols[: 3 + keep_text]], names)

    done = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(take_out, schema)
    names = docs.select(F.col(id_col).alias("doc_id"), *blocks.text_ids(F.coalesce(F.col(text_col), F.lit(""))))
    return names.join(done, ["u1", "u2"]).drop("u1", "u2")
