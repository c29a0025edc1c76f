import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import blocks, substrings
from corvane.llm.deepshallow import BlindTrie, deep_shallow_sort
from corvane.llm.queries import QUERIES
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.01"


def expected(docs, window):
    """By a table of all windows with the least id that each starts in."""
    least = {}
    data = [(r.doc_id if r.doc_id is not None else blocks.LARGEST, (r.text or "").encode(), r.doc_id) for r in docs]
    for i, t, _ in data:
        for k in range(len(t) - window + 1):
            w = t[k : k + window]
            if least.get(w, i) >= i:
                least[w] = i
    out = []
    for i, t, doc_id in data:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if least[t[k : k + window]] < i:
                gone[k : k + window] = True
        gone = gone[:-1] if len(t) else gone[:0]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], bytes(r.kept)) for r in df.collect()), key=repr)


def passages(spark):
    rng, rows = random.Random(5), []
    shared = [fx.words(40, 100 + i) for i in range(4)]
    for i in range(200):
        rows.append((1000 + i, f"{fx.words(i % 40, i)} {shared[i % 3][i % 9:]} {fx.words(20 + i % 7, 7000 + i)}", "en", "s", 0))
    rows += [(900, shared[3] + " ab " + shared[3], "en", "s", 0), (2000, "z" * 3000, "en", "s", 0), (2001, "y" + "z" * 2100, "en", "s", 0), (2002, "ab" * 700, "en", "s", 0)]
    rows += [(2003, "x" + "ab" * 90 + "é" * 60, "en", "s", 0), (2004, "é" * 60, "en", "s", 0), (2004, "é" * 60, "en", "s", 0), (2004, "é" * 61, "en", "s", 0)]
    rows += [(None, "z" * 70 + "q", "en", "s", 0), (None, "é" * 60, "en", "s", 0), (None, fx.words(30, 1234), "en", "s", 0), (None, "w" + fx.words(30, 1234), "en", "s", 0)]
    rows += [(3000 + k, fx.words(60, 9)[rng.randrange(90) :][: 49 + k % 5], "en", "s", 0) for k in range(40)]
    return rows


def test_blind_trie():
    rng = random.Random(1)
    for n, letters in ((1, "a"), (50, "ab"), (300, "abc"), (300, "a"), (200, "abcdefgh")):
        strings = ["".join(rng.choice(letters) for _ in range(6)).encode() for _ in range(n)]
        trie, want = BlindTrie(), defaultdict(list)
        for i, s in enumerate(strings):
            trie.insert(s, i)
            want[s].append(i)
        assert trie.leaves() == [want[s] for s in sorted(want)]
    assert BlindTrie().leaves() == []


@pytest.mark.parametrize("shallow", [1, 8, 16, 30, 50, 80])
@pytest.mark.parametrize("letters", [1, 2, 5, 256])
def test_deep_shallow_sort(shallow, letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 3000).astype(np.uint8)
    data[1500:2000] = data[:500]
    starts = rng.permutation(2900)
    order, new = deep_shallow_sort(data, starts, 50, shallow)
    strings = [bytes(data[s : s + 50]) for s in starts]
    assert sorted(order.tolist()) == list(range(len(starts)))
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings)
    assert new.tolist() == [True] + [a != b for a, b in zip(ordered, ordered[1:])]


def test_deep_shallow_sort_in_groups():
    rng = np.random.default_rng(7)
    data, sizes = rng.integers(0, 2, 3000).astype(np.uint8), np.array([1, 0, 500, 2, 1, 496])
    starts = rng.integers(0, 2900, 1000)
    order, new = deep_shallow_sort(data, starts, 20, 8, sizes)
    at = 0
    for m in sizes:
        part = order[at : at + m]
        strings = [bytes(data[starts[i] : starts[i] + 20]) for i in part]
        assert sorted(part.tolist()) == list(range(at, at + m)) and strings == sorted(strings)
        assert new[at : at + m].tolist() == [True][:m] + [a != b for a, b in zip(strings, strings[1:])]
        at += m
    for none in (None, np.zeros(0, np.int64)):
        assert [len(x) for x in deep_shallow_sort(data, starts[:0], 20, sizes=none)] == [0, 0]


def test_gram_hashes():
    data = np.random.default_rng(2).integers(0, 3, 200_000).astype(np.uint8)
    for gram in (1, 2, 5, 12, 24, 31):
        h, seen = substrings._gram_hashes(data, gram), {}
        assert len(h) == len(data) - gram + 1
        for i in [*range(0, 3000), *range(65_400, 65_700), *range(len(h) - 50, len(h))]:
            assert seen.setdefault(bytes(data[i : i + gram]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("window, gram", [(50, 24), (20, 7), (12, 12)])
def test_awkward_rows(spark, window, gram):
    docs = fx.awkward_docs(spark, passages(spark)).repartition(3)
    assert got(substrings.remove_copies(fx.clashing(docs), window=window, gram=gram)) == expected(docs.collect(), window)


@pytest.mark.parametrize("common", [1, 2, 5])
def test_common_anchors_and_small_parts(spark, monkeypatch, common):
    monkeypatch.setattr(substrings, "PART_BYTES", 300)
    monkeypatch.setattr(substrings, "RUN", 7)
    monkeypatch.setattr(substrings, "HERE", 3 * common)
    docs = fx.awkward_docs(spark, passages(spark)).repartition(3)
    assert got(substrings.remove_copies(docs, common=common)) == expected(docs.collect(), 50)


def test_keys_that_fall_together(spark, monkeypatch):
    """All grams have one of four hashes: groups mix, yet bytes are compared."""
    monkeypatch.setattr(substrings, "_mix", lambda x: ((x & np.uint64(3)) << np.uint64(60)) | np.uint64(1))
    monkeypatch.setattr(substrings, "GROUP_BYTES", 1000)
    docs = fx.awkward_docs(spark, passages(spark)).repartition(3)
    assert got(substrings.remove_copies(docs)) == expected(docs.collect(), 50)


@pytest.mark.parametrize("texts", [1000, 4000])
def test_a_passage_in_every_text(spark, texts):
    """The largest group of rows that meet does not grow with the number of texts: an anchor's runs, or a window's rows."""
    docs = spark.range(texts).selectExpr("id as doc_id", f"concat(md5(cast(id as string)), '{fx.words(30, 1)}', md5(cast(-id as string))) as text")
    size = blocks.total_bytes(docs, "text")
    frame = blocks.text_blocks(docs, size)
    ranges = blocks.Ranges(size)

    def send(t):
        t = blocks.in_order(t)
        keys, _, crowded = substrings._block_keys(substrings._scan(t, 50, 24), ranges)
        return ranges.rows(t.column("block")[0].as_py(), keys, crowded)

    told = blocks.answers(frame.groupBy("block").applyInArrow(send, blocks.SENT), 20)
    for common, key in ((False, "key"), (True, "bytes")):
        both = frame.groupBy("block").cogroup(told.groupBy("block"))
        rows = both.applyInArrow(lambda t, a: substrings._runs(t, a, ranges, 50, 24, common), substrings._RUNS)  # noqa: B023
        largest = rows.groupBy(key).count().agg({"count": "max"}).first()[0]
        assert (largest or 0) <= blocks.LEAST_BLOCKS
    out = substrings.remove_copies(docs, keep_bytes=False, common=20)
    assert out.where("n_removed > 0").count() == texts - 1


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r[:5] for r in expected(docs.collect(), 50)]
    assert fx.rows(QUERIES["op13_suffix_arrays"](spark, SF)) == want and sum(r[2] for r in want) > 100_000


def test_empty_table(spark):
    assert substrings.remove_copies(spark.createDataFrame([], fx.DOCS)).collect() == []
