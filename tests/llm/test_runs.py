import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import runs
from corvane.llm.queries import QUERIES
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute_runs(words, least=12):
    """Every maximal stretch of every period, with its smallest period."""
    n, number = len(words), {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = {}
    for p in range(1, n // 2 + 1):
        same = np.concatenate([[False], x[p:] == x[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= p and e - s + p >= least and (s, e + p) not in out:
                q = next(q for q in range(1, p + 1) if (x[s : e + p - q] == x[s + q : e + p]).all())
                assert q == p
                out[s, e + p] = q
    return sorted((int(s), int(e - s), q) for (s, e), q in out.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text, plant, least=12):
    words = WORD.findall(text or "")
    if plant and doc_id is not None:
        words = planted(doc_id, words)
    found = brute_runs(words, least)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return doc_id, len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)


def got(df):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()), key=repr)


def test_cover():
    differences = {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER}
    assert differences == set(range(runs.MODULUS))


@pytest.mark.parametrize("letters, n", [(1, 500), (2, 700), (3, 2000), (50, 900), (2, 40)])
def test_extensions(letters, n):
    rng = np.random.default_rng(letters)
    words = np.append(rng.integers(1, letters + 1, n), letters + 1)
    words[n // 2 : n // 2 + n // 4] = words[: n // 4]  # a long copy
    i, j = rng.integers(0, n, (2, 3000))
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i, j):
        d = 0
        while words[a + d] == words[b + d] and max(a, b) + d < n:
            d += 1
        want.append(d)
    assert runs.Extensions(words)(i, j).tolist() == want


def texts():
    rng = np.random.default_rng(3)
    out = ["", None, " ", "a", " ".join("a" * 11), " ".join("a" * 12), " ".join("ab" * 6), "x " + "ab cd " * 6 + "ab y", "a b " * 400]
    out += [" ".join(rng.choice(list("ab"), n)) for n in (12, 30, 64, 200, 500)]
    out += [" ".join(rng.choice(list("abc"), n)) for n in (30, 64, 300)]
    fib = ["a", "a b"]
    while len(fib) < 13:
        fib.append(fib[-1] + " " + fib[-2])
    out += [fib[-1], fx.words(300, 4) + " " + fx.words(40, 5) + " " + fx.words(40, 5) + "\t" + fx.words(40, 5), "\x85 \x85 " * 9, "é" * 30 + " " + "é " * 14]
    out += [" ".join(fx.words(5, 6).split() * 3 + fx.words(5, 6).split()[:k]) for k in range(5)]
    return out


@pytest.mark.parametrize("plant, small", [(False, False), (True, False), (True, True)])
def test_awkward_rows(spark, monkeypatch, plant, small):
    if small:
        monkeypatch.setattr(runs, "BATCH_BYTES", 300)
        monkeypatch.setattr(runs, "PAIRS", 50)
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts() + texts()[:3])] + [(i, t, "en", "s", 0) for i, t in zip(ids, texts() * 2)]
    docs = fx.awkward_docs(spark, rows).repartition(3)
    want = sorted((expected(r.doc_id, r.text, plant) for r in docs.collect()), key=repr)
    assert got(runs.collapse_runs(fx.clashing(docs), plant=plant)) == want
    assert sum(len(x[2]) for x in want) > 100


def test_other_least_length(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts())], fx.DOCS)
    assert got(runs.collapse_runs(docs, least=4)) == sorted((expected(r.doc_id, r.text, False, 4) for r in docs.collect()), key=repr)


def test_long_texts(spark):
    same, mixed = "z " * 200_000, " ".join(np.random.default_rng(1).choice(list("abcdefghij"), 150_000)) + " q" * 20
    docs = spark.createDataFrame([(1, same, "en", "s", 0), (2, mixed, "en", "s", 0)], fx.DOCS)
    out = {r.doc_id: r for r in runs.collapse_runs(docs).collect()}
    assert [tuple(x) for x in out[1].runs] == [(0, 200_000, 1)] and out[1].collapsed == "z"
    assert (150_000, 20, 1) in [tuple(x) for x in out[2].runs]


def test_empty_table(spark):
    assert runs.collapse_runs(spark.createDataFrame([], fx.DOCS)).collect() == []


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.collect():
        doc_id, _, found, kept = expected(r.doc_id, r.text, True)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc_id, len(found), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    assert fx.rows(QUERIES["op11_periodic_runs"](spark, SF)) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 80
