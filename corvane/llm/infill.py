"""Fill-in-the-middle: texts cut in three at token ends and put in the order in which a model learns to fill a gap.

All texts of a batch lie in one array of bytes. A scan finds the ends of tokens and from them the two cuts of each text.
The three parts of a text move as a whole, so the distance by which a byte moves changes at few places only: a difference
array holds these changes, its cumulative sum is each byte's displacement, and one scatter writes the outputs. Reading an
output back goes the other way: marks are found, the displacements follow from them, and a gather takes the text out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrays import binary, bounds, runs_of_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, SPM, PSM = "plain", "spm", "psm"
RATE, SPM_RATE = 50, 80  # of a hundred texts those that are cut, and of a hundred of these those with the suffix first
BATCH_BYTES = 4 << 20  # of texts that are handled side by side
BLOCK_BYTES = 1 << 20  # of displacements that are in memory at a time


def _moves(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, place + displacement) of stretches of bytes; shifts[i] holds from starts[i] (sorted) to the next start.

    Of parts with one start all but the last are empty; their changes add up to the last one's displacement.
    """
    change, carry = np.diff(shifts, prepend=0), 0
    for at in range(0, size, BLOCK_BYTES):
        to = min(size, at + BLOCK_BYTES)
        lo, hi = np.searchsorted(starts, [at, to])
        moves = np.zeros(to - at, np.int64)
        np.add.at(moves, starts[lo:hi] - at, change[lo:hi])
        np.cumsum(moves, out=moves)
        moves += carry
        carry = int(moves[-1])
        moves += np.arange(at, to)
        yield at, to, moves


def scatter(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, out: np.ndarray) -> None:
    """out[place + displacement] = data[place] for all bytes of data."""
    for at, to, place in _moves(len(data), starts, shifts):
        out[place] = data[at:to]


def gather(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, out: np.ndarray) -> None:
    """out[place] = data[place + displacement] for all bytes of out: the inverse of scatter."""
    for at, to, place in _moves(len(out), starts, shifts):
        out[at:to] = data[place]


def cut_points(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of tokens, end of the prefix, end of the middle) of each text; h1 and h2 choose among the n + 1 token ends.

    A token is a word with the white space before it; white space at the end of a text is a token.
    """
    _, ends = bounds(data, offsets)
    first = np.searchsorted(ends, offsets, "right")  # words that end at the text's start or before
    words = np.diff(first)
    some = np.diff(offsets) > 0
    last = np.zeros(len(words), np.int64)
    last[words > 0] = ends[first[1:][words > 0] - 1]
    n = words + (some & (last < offsets[1:]))

    def end_of(k: np.ndarray) -> np.ndarray:
        at = np.where(k == 0, offsets[:-1], offsets[1:])
        inside = (k > 0) & (k <= words)
        at[inside] = ends[(first[:-1] + k)[inside] - 1]
        return at

    a, b = h1 % (n + 1), h2 % (n + 1)
    return n, end_of(np.minimum(a, b)), end_of(np.maximum(a, b))


def _rearranged(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray, cut: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs and their offsets; texts that are not `cut` stay as they are."""
    begin, end = offsets[:-1], offsets[1:]
    marks = [np.frombuffer(m.encode(), np.uint8) for m in MARKS]
    p, s, m = map(len, marks)
    to = np.concatenate([[0], np.cumsum(end - begin + np.where(cut, p + s + m, 0))])
    base, size_p, size_m, size_s = to[:-1], one - begin, two - one, end - two
    at_p = base + np.where(spm, s + size_s, 0)  # of the marks
    at_s = base + np.where(spm, 0, p + size_p)
    at_m = base + p + size_p + s + size_s
    # parts in the order of the text: prefix, middle, suffix
    starts = np.stack([begin, one, two], 1)
    placed = np.stack([at_p + p, at_m + m, at_s + s], 1)
    shifts = np.where(cut[:, None], placed - starts, (base - begin)[:, None])
    out = np.empty(to[-1], np.uint8)
    scatter(data, starts.ravel(), shifts.ravel(), out)
    for mark, at in zip(marks, (at_p, at_s, at_m)):
        out[at[cut][:, None] + np.arange(len(mark))] = mark
    return out, to


def _find(data: np.ndarray, offsets: np.ndarray, mark: str, within: np.ndarray) -> np.ndarray:
    """Where the mark stands, in the texts of `within` (a flag for each text)."""
    code = mark.encode()
    at = np.flatnonzero(data == code[0])
    text = np.searchsorted(offsets, at, "right") - 1
    at = at[within[text] & (at + len(code) <= offsets[text + 1])]
    for i, x in enumerate(code[1:], 1):
        at = at[data[at + i] == x]
    return at


def _read_back(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts and their offsets; outputs that are not `cut` are texts. Each of the others has each mark once."""
    begin, end = offsets[:-1], offsets[1:]
    p, s, m = (len(x) for x in MARKS)
    at_p, at_s, at_m = (np.copy(begin) for _ in MARKS)
    for mark, at in zip(MARKS, (at_p, at_s, at_m)):
        at[cut] = _find(data, offsets, mark, cut)
    size_p = np.where(spm, at_m, at_s) - at_p - p
    size_m = end - at_m - m
    to = np.concatenate([[0], np.cumsum(end - begin - np.where(cut, p + s + m, 0))])
    base = to[:-1]
    starts = np.stack([base, base + np.where(cut, size_p, 0), base + np.where(cut, size_p + size_m, 0)], 1)
    taken = np.stack([at_p + p, at_m + m, at_s + s], 1)
    shifts = np.where(cut[:, None], taken - starts, (begin - base)[:, None])
    out = np.empty(to[-1], np.uint8)
    gather(data, starts.ravel(), shifts.ravel(), out)
    return out, to


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in data[start:end] of each pair: bytes that don't go on with a character."""
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return total[ends] - total[starts]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n (tokens), form, prefix_chars, middle_chars (code points), output.

    The first 32 hex digits of the SHA-256 of "seed:id" are four numbers: two choose the cuts among the n + 1 token ends,
    the third whether a text is cut, the fourth its form. Texts that are empty or contain a mark stay plain. Null texts
    are empty; a null id counts as an empty one, so that null ids with one text give one output. Rows are independent:
    repeated rows give repeated outputs, an empty table none; other columns are not read. A text is in memory as a
    whole, with its output; displacements are worked out in blocks of BLOCK_BYTES.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(told.cast("binary"), 256)).alias("h"), marked.alias("marked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked = b.column("marked").to_numpy(zero_copy_only=False)
            h = np.frombuffer(b"".join(b.column("h").to_pylist()), ">u4").reshape(-1, 8).astype(np.int64)
            for at, to, data, offsets in runs_of_rows(b.column("text"), BATCH_BYTES):
                h1, h2, h3, h4 = h[at:to, :4].T
                n, one, two = cut_points(data, offsets, h1, h2)
                cut = ~marked[at:to] & (np.diff(offsets) > 0) & (h3 % 100 < rate)
                spm = h4 % 100 < spm_rate
                out, ends = _rearranged(data, offsets, one, two, cut, spm)
                form = np.where(cut, np.where(spm, SPM, PSM), PLAIN)
                sizes = [pa.array(_characters(data, x, y), pa.int64(), mask=~cut) for x, y in ((offsets[:-1], one), (one, two))]
                cols = [b.column("doc_id").slice(at, to - at), pa.array(n, pa.int64()), pa.array(form, pa.string()), *sizes, binary(out, ends, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """`outputs` with a column `restored`: the text, from output and form alone. A null output gives an empty text."""
    names = outputs.columns
    rows = outputs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names) if c != "restored"]).alias("row"),
        F.coalesce(F.col(output_col), F.lit("")).alias("output"),
        F.coalesce(F.col(form_col), F.lit(PLAIN)).alias("form"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = np.array(b.column("form").to_pylist(), object)
            for at, to, data, offsets in runs_of_rows(b.column("output"), BATCH_BYTES):
                out, ends = _read_back(data, offsets, form[at:to] != PLAIN, form[at:to] == SPM)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(at, to - at), binary(out, ends, pa.string())], ["row", "restored"])

    back = rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, restored string")
    return back.select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(names) if c != "restored"], "restored")
