"""SentencePiece encoding and decoding with the n best segmentations.

Texts become pieces of a given model: a space is the mark U+2581, a mark is put in front of each text, and characters
without a piece are written as the pieces of their UTF-8 bytes. A segmentation's score is the sum of its pieces' scores.

The lattice of a text falls apart before each run of marks, as no piece reaches over such a place, so distinct words
stand for the whole text. Forward Viterbi scores of all words of a batch are worked out side by side in numpy; words of
more than LONG_WORD characters, such as texts without spaces, go one by one, in blocks, in time and memory that grow with
their length. A word's second segmentation leaves the best one at one edge, so the least loss of such an edge says how much
worse it is. The n best segmentations of a text differ from the best one in the n - 1 words with the least such loss only;
there an A-star search runs from the end of the word to its start, with forward Viterbi scores as exact heuristics.
"""
from __future__ import annotations

import functools
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a public tokenizer; a path that all executors have, or a file that the cluster was given with addFile.
MODEL = os.environ.get("CORVANE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
N_BEST = 3
BATCH_CHARS = 1 << 21
LONG_WORD = 256
_LATTICE_CHARS, _BLOCK, _CACHED = 200_000, 1 << 15, 64
_MARK, _PENALTY = "▁", 10.0  # U+2581; what an unknown character costs beyond the worst piece
_WORDS = re.compile(" +[^ ]*|[^ ]+")
_NEVER = -np.inf
_LITERAL = np.uint32(0x110000)  # stands for a mark in the text itself, which is no piece

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """A model's pieces, and what is derived from them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.ids = {names[i]: i for i in plain}
        self.score = np.array([model.get_score(i) for i in range(n)], np.float64)
        self.unknown = self.score[plain].min() - _PENALTY
        self.longest = max(map(len, self.ids))
        if any(_MARK in p.lstrip(_MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind another character")
        self.text = [b""] * n
        for i in plain:
            self.text[i] = names[i].replace(_MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i:
                self.text[i] = bytes([b])
        # an open table from hashes of code points to ids
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in self.ids]
        keys = _spans(np.concatenate(codes), np.cumsum([0] + [len(c) for c in codes][:-1]), np.array([len(c) for c in codes]))
        self.bits = 20
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for k, i in zip(keys, self.ids.values()):
            at = int(k >> np.uint64(64 - self.bits))
            while self.values[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = k, i

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The id for each key; -1 where there is none."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (self.values[at[open_]] >= 0)]
        return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        row = np.full(max(n, 1 << 18), base, np.uint64)
        row[0] = 1
        _POWERS[base] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[base][:n]


def _prefix(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), dtype=np.uint64, out=out[1:])
    return out


def _spans(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    sums = _prefix(codes)
    return _mix((sums[start + length] - sums[start]) * _powers(_INVERSE, len(sums))[start] + length.astype(np.uint64))


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """The model at `path`, loaded once in a process."""
    return Pieces(path)


class Words:
    """The best segmentation of each of some words, and the loss of the second."""

    def __init__(self, words: list[str], model: Pieces):
        # words of one length side by side, so that the words still going on are always the first ones
        order = np.argsort(-np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist()
        self.loss, self.score = np.full(len(words), np.inf), np.zeros(len(words))
        ids, at = [], 0
        while at < len(order) and len(words[order[at]]) > LONG_WORD:
            part = np.array(order[at : at + 1])
            self.score[part], self.loss[part], flat = _long_word(words[order[at]], model)
            ids.append((part, (np.zeros(len(flat), np.int64), flat)))
            at += 1
        while at < len(order):
            chars, to = 0, at
            while to < len(order) and (to == at or chars + len(words[order[to]]) <= _LATTICE_CHARS):
                chars += len(words[order[to]])
                to += 1
            part = np.array(order[at:to])
            self.score[part], self.loss[part], got = _lattice([words[i] for i in part], model)
            ids.append((part, got))
            at = to
        counts = np.zeros(len(words), np.int64)
        for part, (owner, _) in ids:
            counts[part] = np.bincount(owner, minlength=len(part))
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.ids = np.zeros(self.start[-1], np.int32)
        for part, (owner, flat) in ids:
            first = np.cumsum(counts[part]) - counts[part]
            self.ids[self.start[part][owner] + np.arange(len(owner)) - first[owner]] = flat

    def of(self, word: int) -> np.ndarray:
        return self.ids[self.start[word] : self.start[word + 1]]


def _codes(word: str) -> np.ndarray:
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return np.where(codes == 0x2581, _LITERAL, np.where(codes == 0x20, np.uint32(0x2581), codes))


def _lattice(words: list[str], model: Pieces):
    """(score, loss of the second best, (owner, ids)) for words in falling order of length; ids of each word in order."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes, start = _codes("".join(words)), np.cumsum(size) - size
    n, most = len(codes), min(model.longest, int(size[0]) if len(size) else 0)
    sums, powers = _prefix(codes), _powers(_INVERSE, n + 1)
    left = np.repeat(start + size, size) - np.arange(n)  # characters to the end of the word
    piece, score = np.full((most + 1, n), -1, np.int32), np.full((most + 1, n), _NEVER)
    for l in range(1, most + 1):
        at = np.flatnonzero(left >= l)
        found = model.find(_mix((sums[at + l] - sums[at]) * powers[at] + np.uint64(l)))
        piece[l, at] = found
        score[l, at] = np.where(found >= 0, model.score[found], model.unknown if l == 1 else _NEVER)

    going = [int(np.searchsorted(-size, -j, "right")) for j in range(int(size[0]) + 1 if len(size) else 1)]  # words of j characters or more
    base = start + np.arange(len(words))  # positions 0 .. size of each word
    fwd, come = np.full(n + len(words), _NEVER), np.zeros(n + len(words), np.int8)
    fwd[base] = 0
    for j in range(1, len(going)):
        k = going[j]
        at, best, how = base[:k] + j, np.full(k, _NEVER), np.zeros(k, np.int8)
        for l in range(1, min(most, j) + 1):  # the longer piece on ties
            value = fwd[at - l] + score[l, start[:k] + j - l]
            better = value >= best
            best, how = np.where(better, value, best), np.where(better & (value > _NEVER), l, how)
        fwd[at], come[at] = best, how

    # steps back along the best path
    owner, where, length = [], [], []
    word, at = np.arange(len(words)), size.copy()
    while len(word):
        l = come[base[word] + at].astype(np.int64)
        at = at - l
        owner.append(word)
        where.append(start[word] + at)
        length.append(l)
        word, at = word[at > 0], at[at > 0]
    owner, where, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, where, length))
    order = np.argsort(where, kind="stable")
    owner, where, length = owner[order], where[order], length[order]

    # what the other edges into each node of the best path lose; the rest of the path stays
    second, end = np.full(len(where), np.inf), where + length
    for l in range(1, most + 1):
        at = np.flatnonzero((end - l >= start[owner]) & (length != l))
        node = end[at] + owner[at]
        second[at] = np.minimum(second[at], fwd[node] - (fwd[node - l] + score[l, end[at] - l]))
    loss = np.minimum.reduceat(second, np.searchsorted(owner, np.arange(len(words)))) if len(words) else second
    return fwd[base + size], loss, _spelled(owner, where, length, piece, codes, model)


def _spelled(owner, where, length, piece, codes, model):
    """(owner, ids) with the bytes of characters that have no piece."""
    ids = piece[length, where] if len(where) else np.zeros(0, np.int32)
    missing = np.flatnonzero(ids < 0)
    if not len(missing):
        return owner, ids
    data = [_bytes(codes[where[i]]) for i in missing]
    repeat = np.ones(len(ids), np.int64)
    repeat[missing] = [len(d) for d in data]
    first = np.cumsum(repeat) - repeat
    out = np.repeat(ids, repeat)
    for i, d in zip(missing, data):
        out[first[i] : first[i] + len(d)] = model.byte_ids[list(d)]
    return np.repeat(owner, repeat), out


def _bytes(code: int) -> bytes:
    return (_MARK if code == _LITERAL else " " if code == 0x2581 else chr(code)).encode()


def _name(word: str) -> str:
    return word.replace(_MARK, "\0").replace(" ", _MARK)  # "\0" is no piece, so a mark in the text is spelled


def _forward(word: str, name: str, model: Pieces) -> tuple[array, bytearray]:
    """Viterbi scores of all positions of a word, and the lengths of the pieces that come to them on the best paths."""
    size = len(word)
    fwd, come = array("d", [_NEVER]) * (size + 1), bytearray(size + 1)
    fwd[0] = 0.0
    codes, block = (_codes(word), _BLOCK) if size > LONG_WORD else (None, size)
    for a in range(0, size, block):
        few = min(block, size - a)
        edges = _edges_of_few(name, model) if codes is None else _edges(codes[a : a + few + model.longest], few, model)
        for i, l, s in zip(*edges):  # by start, so the longest piece into a place comes first and stays on ties
            value = fwd[a + i] + s
            if value > fwd[a + i + l]:
                fwd[a + i + l], come[a + i + l] = value, l
    return fwd, come


def _edges_of_few(name: str, model: Pieces) -> tuple[list, list, list]:
    out = []
    for i in range(len(name)):
        for l in range(1, min(model.longest, len(name) - i) + 1):
            found = model.ids.get(name[i : i + l])
            if found is not None or l == 1:
                out.append((i, l, model.unknown if found is None else float(model.score[found])))
    return tuple(map(list, zip(*out)))


def _edges(codes: np.ndarray, n: int, model: Pieces) -> tuple[list, list, list]:
    """(start, length, score) of the edges that leave the first n of `codes`, by start."""
    sums, powers, out = _prefix(codes), _powers(_INVERSE, len(codes) + 1), []
    for l in range(1, min(model.longest, len(codes)) + 1):
        at = np.arange(min(n, len(codes) - l + 1))
        found = model.find(_mix((sums[at + l] - sums[at]) * powers[at] + np.uint64(l)))
        score = np.where(found >= 0, model.score[found], model.unknown)
        keep = (found >= 0) | (l == 1)
        out.append((at[keep], np.full(keep.sum(), l), score[keep]))
    start, length, score = map(np.concatenate, zip(*out))
    order = np.argsort(start, kind="stable")
    return start[order].tolist(), length[order].tolist(), score[order].tolist()


def _long_word(word: str, model: Pieces) -> tuple[float, float, np.ndarray]:
    """(score, loss of the second best, ids) of one word."""
    name = _name(word)
    fwd, come = _forward(word, name, model)
    loss, j, lengths = np.inf, len(word), []
    while j:
        for l, s, _ in _into(name, j, model):
            if l != come[j]:
                loss = min(loss, fwd[j] - (fwd[j - l] + s))
        lengths.append(come[j])
        j -= come[j]
    return fwd[len(word)], loss, np.array(_ids(word, name, lengths[::-1], model), np.int32)


def _into(name: str, j: int, model: Pieces) -> list[tuple[int, float, int | None]]:
    """(length, score, id) of the pieces that end at j, the longest first."""
    out, ids, score = [], model.ids, model.score
    for l in range(min(model.longest, j), 0, -1):
        found = ids.get(name[j - l : j])
        if found is not None:
            out.append((l, float(score[found]), found))
        elif l == 1:
            out.append((1, model.unknown, None))
    return out


def _ids(word: str, name: str, lengths: list[int], model: Pieces) -> list[int]:
    out, at = [], 0
    for l in lengths:
        found = model.ids.get(name[at : at + l])
        if found is None:
            out += model.byte_ids[list(word[at].encode())].tolist()
        else:
            out.append(found)
        at += l
    return out


def best_of_word(word: str, n: int, path: str) -> tuple[tuple[float, tuple[int, ...]], ...]:
    """The n best (score, ids) of a word, best first."""
    return _best_of_short(word, n, path) if len(word) <= _CACHED else _best(word, n, path)


def _best(word: str, n: int, path: str) -> tuple[tuple[float, tuple[int, ...]], ...]:
    """A-star from the end, forward Viterbi scores as heuristics.

    As they are exact, a partial path's bound is the score of its best completion, and no two partial paths have a
    completion in common: so no more of them than paths are still wanted need be kept. Bounds are losses against the best
    score, summed edge by edge, so that equal ones stay equal; of these the one nearest to the start goes on first.
    """
    model, name, size = pieces(path), _name(word), len(word)
    fwd, _ = _forward(word, name, model)
    came, place = array("q"), array("q")  # of each partial path that was followed: the one it goes on from, its position
    out, open_ = [], [(0.0, size, -1)]
    while open_ and len(out) < n:
        loss, j, before = open_.pop(0)
        came.append(before)
        place.append(j)
        node = len(place) - 1
        if j == 0:
            lengths, at = [], node
            while came[at] >= 0:
                lengths.append(place[came[at]] - place[at])
                at = came[at]
            out.append((fwd[size] - loss, tuple(_ids(word, name, lengths, model))))
            continue
        open_ += [(loss + (fwd[j] - (fwd[j - l] + s)), j - l, node) for l, s, _ in _into(name, j, model)]
        open_ = heapq.nsmallest(n - len(out), open_)
    return tuple(out)


_best_of_short = functools.lru_cache(50_000)(_best)


def others(seq: np.ndarray, words: list[str], table: Words, n: int, path: str) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
    """What the second to n-th best segmentation change in the best: (loss, edits), an edit being (start, length, ids)."""
    loss = table.loss[seq]
    if n < 2 or not len(loss):
        return []
    few = min(n - 1, len(loss))
    bound = np.partition(loss, few - 1)[few - 1]
    near = np.flatnonzero(loss < bound)
    near = np.sort(np.concatenate([near, np.flatnonzero(loss == bound)[: few - len(near)]]))
    near = near[np.isfinite(loss[near])]
    lists = [best_of_word(words[seq[i]], n, path) for i in near]
    starts = np.cumsum(table.start[seq + 1] - table.start[seq]) - (table.start[seq + 1] - table.start[seq])
    ways = [(0.0, ())]
    for x in lists:  # the n best choices so far, with each of this word's
        ways = heapq.nsmallest(n, [(cost + x[0][0] - x[c][0], (*choice, c)) for cost, choice in ways for c in range(len(x))])
    out = []
    for cost, choice in ways[1:]:
        edits = [_edit(int(starts[i]), table.of(seq[i]), x[c][1]) for i, x, c in zip(near, lists, choice) if c]
        out.append((float(cost), edits))
    return out


def _edit(start: int, old: np.ndarray, new: tuple[int, ...]) -> tuple[int, int, tuple[int, ...]]:
    """(start, length, ids): the part of `old` that differs from `new`, and what stands there instead."""
    ids, m = np.array(new, np.int32), min(len(old), len(new))
    differ = np.flatnonzero(old[:m] != ids[:m])
    head = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(old[len(old) - m + head :][::-1] != ids[len(ids) - m + head :][::-1])
    tail = int(differ[0]) if len(differ) else m - head
    return start + head, len(old) - head - tail, tuple(ids[head : len(ids) - tail].tolist())


def decode_ids(ids: list[int], model: Pieces) -> str:
    """The text of `ids`, without the mark that encoding puts in front."""
    return b"".join(map(model.text.__getitem__, ids)).decode(errors="replace")[1:]


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """The words of each text by number, and the words."""
    split = [_WORDS.findall(" " + t) if t else [] for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
    return [np.fromiter(map(number.__getitem__, s), np.int64, len(s)) for s in split], list(number)


SCHEMA = "n_pieces int, score double, ids array<int>, others array<struct<loss: double, edits: array<struct<start: int, length: int, ids: array<int>>>>>, round_trip boolean"
_EDIT = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHERS = pa.list_(pa.struct([("loss", pa.float64()), ("edits", pa.list_(_EDIT))]))


def encode(docs: DataFrame, path: str = MODEL, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_pieces, score, ids of the best segmentation, others and round_trip.

    others has the second to n-th best segmentation (fewer if there are no more) by what they change in ids, worse ones
    later; round_trip says whether decoding gives the text back. A null text counts as empty; an empty text has no
    pieces. Control pieces never come from a text. Columns other than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
                    size += len(texts[to])
                    to += 1
                seqs, words = _numbered(texts[at:to])
                table = Words(words, model)
                counts = np.diff(table.start)
                ids, offsets, score, more, same = [], [0], [], [], []
                for seq, t in zip(seqs, texts[at:to]):
                    n = counts[seq]
                    flat = table.ids[np.repeat(table.start[seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(seq) else table.ids[:0]
                    ids.append(flat)
                    offsets.append(offsets[-1] + len(flat))
                    score.append(float(table.score[seq].sum()))
                    more.append([{"loss": c, "edits": [dict(zip(("start", "length", "ids"), e)) for e in edits]} for c, edits in others(seq, words, table, n_best, path)])
                    same.append(decode_ids(flat.tolist(), model) == t)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)))
                cols = [b.column(0).slice(at, to - at), pa.array(np.diff(offsets).astype(np.int32)), pa.array(score), lists, pa.array(more, _OTHERS), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "score", "ids", "others", "round_trip"])
                at = to

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + SCHEMA)


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts = [None if x is None else decode_ids(x, model) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
