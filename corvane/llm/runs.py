"""Periodic runs of words, found by longest common extensions on a harmonic grid and collapsed to one period.

A run is a stretch in which words q apart are identical, at least two periods long. For a period p it holds two
neighbouring points of the grid 0, p, 2p, ... at least, and at such a pair of points the words agree forwards and
backwards for p words or more in all. All pairs of all periods are n/1 + n/2 + n/3 + ... = n log n, each answered by one
extension forwards and one backwards.

Extensions are answered from a difference cover: residues modulo MODULUS of which every difference is a difference of
two. Only suffixes that start at places with such a residue are sorted. For any two places some distance below MODULUS
leads from both to sorted suffixes at once; the few words before are compared, and what follows is the minimum of the
common prefixes of neighbours between the two in the order, read from a sparse table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrays import binary, bounds, covered, joined, pieces_of, runs_of_rows

LEAST = 12  # words of a run
BATCH_BYTES = 4 << 20  # of texts that are handled side by side
PAIRS = 1 << 19  # of grid points that are looked at side by side
#: A perfect difference set, each difference but 0 comes from exactly one pair.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)

_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = range(len(COVER))
#: for a difference d the residue a for which a and a + d are both in the cover
_MEET = np.array([next(a for a in COVER if (a + d) % MODULUS in COVER) for d in range(MODULUS)])


class Extensions:
    """Longest common extensions of pairs of places in `words`, positive numbers of which the last occurs only there."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(MODULUS, words.dtype)])
        blocks = np.arange(-(-n // MODULUS))[:, None] * MODULUS + np.array(COVER)
        at = blocks.ravel()
        at = at[at < n]
        self.rank, levels = self._sorted(at)
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        self.table = _sparse_table(self._common(order, at, levels))

    def _sorted(self, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The ranks of the suffixes from `at`, and for MODULUS * 2^i words from there on ranks that equal words share.

        The first MODULUS words are read as many to a key as fit; then the suffix MODULUS * 2^i further on decides.
        """
        bits = int(self.words.max()).bit_length()
        rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
        for d in range(0, MODULUS, each := max(1, 63 // bits)):
            d, key = min(d, MODULUS - each) if each < MODULUS else 0, np.zeros(len(tied), np.int64)
            for k in range(min(each, MODULUS)):
                key = key << bits | self.words[at[tied] + d + k]
            tied = _split(rank, tied, key)
        levels = []
        while len(tied):
            levels.append(rank.astype(np.int32))
            tied = _split(rank, tied, levels[-1][tied + (len(COVER) << (len(levels) - 1))])
        return rank, levels

    def _common(self, order: np.ndarray, at: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """How many words neighbours in the order have in common."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(a), np.int64)
        for i in reversed(range(len(levels))):
            same = np.flatnonzero(levels[i][a] == levels[i][b])
            out[same] += MODULUS << i
            a[same] += len(COVER) << i
            b[same] += len(COVER) << i
        more, _ = self._compared(at[a], at[b], np.full(len(a), MODULUS))
        return out + more

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that agree from i and j on, `most` of each pair at the most; the pairs that agree so far)."""
        out, left, reached = np.zeros(len(i), np.int64), np.arange(len(i)), []
        for d in range(MODULUS + 1):
            there = most[left] == d
            reached.append(left[there])
            left = left[~there]
            left = left[self.words[i[left] + d] == self.words[j[left] + d]]
            if not len(left):
                break
            out[left] += 1
        return out, np.concatenate(reached)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j (two places, not one) on."""
        near = (_MEET[(j - i) % MODULUS] - i) % MODULUS
        out, far = self._compared(i, j, near)
        a, b = (self.rank[(x // MODULUS) * len(COVER) + _SLOT[x % MODULUS]] for x in ((i + near)[far], (j + near)[far]))
        out[far] += _least_between(self.table, np.minimum(a, b), np.maximum(a, b))
        return out


def _split(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders `tied`, whole groups of equal rank, by key; returns those that still share a rank. A rank is its group's place."""
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old = rank[tied]
    group, part = np.ones(len(tied), bool), np.ones(len(tied), bool)
    group[1:] = old[1:] != old[:-1]
    part[1:] = group[1:] | (key[1:] != key[:-1])
    at = np.arange(len(tied))
    begin = np.maximum.accumulate(np.where(part, at, 0))
    rank[tied] = old + begin - np.maximum.accumulate(np.where(group, at, 0))
    return tied[np.bincount(begin, minlength=len(tied))[begin] > 1]


def _sparse_table(x: np.ndarray) -> np.ndarray:
    """Row k has at i the minimum of x[i : i + 2^k]; each row is as long as x, its end is not used."""
    out = np.empty((max(1, len(x).bit_length()), len(x)), np.int32)
    out[0] = x
    for k in range(1, len(out)):
        half = 1 << (k - 1)
        out[k] = out[k - 1]
        np.minimum(out[k - 1][:-half], out[k - 1][half:], out=out[k][:-half])
    return out


def _least_between(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of row 0 from a up to b, of two stretches that overlap."""
    k = np.frexp((b - a).astype(np.float64))[1] - 1
    return np.minimum(table[k, a], table[k, b - (1 << k)])


def _grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): neighbouring points place and place + period of the grids of all periods, in parts of about PAIRS."""
    p = 1
    while p <= longest:
        ahead = np.arange(p, min(longest, p + max(1, PAIRS * p // n)) + 1)
        size = np.maximum((n - 1) // ahead - 1, 0)
        ahead, size = ahead[: max(1, int(np.searchsorted(np.cumsum(size), PAIRS, "right")))], size
        size = size[: len(ahead)]
        period = np.repeat(ahead, size)
        yield (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1) * period, period
        p += len(ahead)


def find_runs(words: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and end; `longest` is the longest period that can occur.

    words: positive numbers; the first and the last, and those that stand between texts, occur once, so no run holds them.
    Every maximal stretch with some period is found with its smallest one too, from the grid of that one: it is kept.
    """
    n, found = len(words), []
    forwards, backwards = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
    for i, p in _grid(n, longest):
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        after, before = forwards(i, i + p), backwards(n - i, n - i - p)
        run = after + before >= np.maximum(p, least - p)
        start, end = (i - before)[run], (i + p + after)[run]
        _, one = np.unique(start * (n + 1) + end, return_index=True)  # periods ascend, so the first is the smallest
        found.append((start[one], end[one], p[run][one]))
    start, end, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    _, one = np.unique(start * (n + 1) + end, return_index=True)
    return start[one], end[one], period[one]


def _runs_of_texts(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs in texts whose words lie one behind the other; places are among all words.

    Texts of about the same length are searched together, so that short ones do not pay for the periods of long ones.
    """
    size, found = np.diff(first), [(np.zeros(0, np.int64),) * 3]
    kind = np.frexp(size.astype(np.float64))[1]
    for k in np.unique(kind[size >= least]):
        texts = np.flatnonzero((kind == k) & (size >= least))
        # a word of its own before the first text and after each
        begin = np.cumsum(size[texts] + 1) - size[texts]
        row = np.empty(begin[-1] + size[texts[-1]] + 1, np.int64)
        own = int(words.max()) + 1
        row[np.concatenate([[0], begin + size[texts]])] = own + np.arange(len(texts) + 1)
        inside = np.arange(size[texts].sum()) - np.repeat(np.cumsum(size[texts]) - size[texts], size[texts])
        row[inside + np.repeat(begin, size[texts])] = words[inside + np.repeat(first[texts], size[texts])]
        start, end, period = find_runs(row, int(size[texts].max()) // 2, least)
        move = (first[texts] - begin)[np.searchsorted(begin, start, "right") - 1]
        found.append((start + move, end + move, period))
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _made_periodic(n: int, h: int) -> np.ndarray:
    """Which of n words stand in a text whose tail is made periodic, where h, a CRC-32, says so."""
    at, g = np.arange(n), h // 10
    if n and h >= 0 and h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def collapse_runs(docs: DataFrame, least: int = LEAST, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of anything but ASCII white space. A run is a stretch with smallest period q, at least `least` words
    and two periods long, that no neighbouring word extends; all runs are found, overlapping ones too. In `collapsed`, words
    joined by one space, each word is left out that some run holds after its first q words. With `plant` one text in
    ten, by the CRC-32 of its id, gets a periodic tail first (of known period, to measure with); null ids get none. Null
    texts are empty, empty texts have no runs, repeated rows give repeated results, an empty table none; other columns
    are not read. A text is in memory as a whole, with some 100 bytes for each of its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(-1)) if plant else F.lit(-1)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h.cast("long").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            for at, to, data, offsets in runs_of_rows(b.column("text"), BATCH_BYTES):
                starts, ends = bounds(data, offsets)
                first = np.searchsorted(starts, offsets)
                if plant:
                    stand = np.concatenate([np.zeros(0, np.int64), *(f + _made_periodic(m, x) for f, m, x in zip(first, np.diff(first), h[at:to]))])
                    starts, ends = starts[stand], ends[stand]
                words = pieces_of(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
                start, end, period = _runs_of_texts(words, first, least)
                kept = np.flatnonzero(~covered(len(words), start + period, end))
                out, places = joined(data, starts[kept], ends[kept], np.searchsorted(kept, first))
                text = np.searchsorted(first, start, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[text], end - start, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32)), spans)
                cols = [b.column("doc_id").slice(at, to - at), pa.array(np.diff(first), pa.int64()), lists, binary(out, places, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
