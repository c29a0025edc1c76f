import math
import re
import string
import zlib
from collections import Counter

import numpy as np

from corvane.llm import quality, queries
from tests.llm import fixtures as fx


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == fold(i) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [p for q, p in held if q == 1], [p for q, p in held if q == 0]
    assert len(bad) > 50 and np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_awkward_rows(spark):
    docs = fx.awkward_docs(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (12, 0, 0), (None, 0, 0), (3, None, None), (99, 1, 0), (10, 1, 1), (13, 0, 0)], "doc_id long, quality int, toxic int")
    for df, marks in ((docs, labels), (fx.clashing(docs), labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        got = quality.classify(df, marks).collect()
        assert sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in df.select("doc_id").collect())
        assert all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(fx.clashing(docs), labels).columns == fx.clashing(docs).columns


def plain_statistics(text):
    """The features in plain Python, by their names."""
    t = text or ""
    data = t.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, size = len(words), len(data)
    kind = lambda chars: sum(data.count(c.encode()) for c in chars) / size
    lower, upper, digit = kind(string.ascii_lowercase), kind(string.ascii_uppercase), kind(string.digits)
    space, marks, high = kind(" \t\n\x0b\x0c\r"), kind(".,;:!?'\""), sum(b >= 128 for b in data) / size
    lens = [len(w) for w in words]
    mean = sum(lens) / n
    often = Counter(words)
    top = sorted(often.values(), reverse=True)
    pairs = Counter(zip(words, words[1:]))
    again = sum(c - 1 for c in pairs.values())
    lines = [x for x in data.split(b"\n") if x.strip()]
    ended = [w[-1:] in (b".", b"!", b"?") for w in words]
    capital = [65 <= w[0] <= 90 for w in words]
    starts = [True] + ended[:-1]
    odd = [w[-1] < 128 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ",.;:" for w in words]
    return [
        math.log1p(size), math.log1p(n), math.log1p(len(lines)), mean, math.sqrt(sum((x - mean) ** 2 for x in lens) / n), math.log1p(max(lens)),
        lower, upper, digit, space, marks, 1 - lower - upper - digit - space - marks - high, high,
        -sum(c / size * math.log2(c / size) for c in Counter(data).values()), len(often) / n, top[0] / n, sum(top[:3]) / n,
        # shares of the pairs in a row: of all but one that repeat, and of all that are new
        again / (n - 2) if n > 2 else 0.0, 1 - again / (n - 1) if n > 1 else 1.0, 1 - len(set(lines)) / len(lines),
        sum(ended) / n, sum(capital) / n, sum(a and b for a, b in zip(capital, starts)) / sum(starts),
        sum(w[0] < 128 and not 65 <= w[0] <= 90 and not 97 <= w[0] <= 122 for w in words) / n,
        sum(odd) / n, n / len(lines), sum(x <= 3 for x in lens) / n, sum(c == 1 for c in often.values()) / n,
    ]


def walk(trees, row):
    total = trees.start
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > c[node] else 1)
        total += leaf[node - len(f)]
    return 1 / (1 + math.exp(-total))


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows, trees = {r.doc_id: r.text for r in docs.collect()}, quality.train(docs, labels)
    assert len(trees.feature) == quality.TREES
    for text in list(rows.values()) + ["a", "a b", "One. Two", "é\n\n\tX y z!", None]:
        assert np.allclose(quality.statistics(None if text is None else text.encode()), plain_statistics(text), atol=1e-9)
    got = queries.QUERIES["op7_quality_trees"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        want = walk(trees, quality.statistics((rows[r.doc_id] or "").encode()))
        assert abs(r.score - want) < 1e-6 and r.held_out == fold(r.doc_id) and r.predicted == (r.score >= 0.3)


def test_rows_that_share_a_sampled_id(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id % 40 as doc_id", "concat('word ', id, ' more') as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x.shape))
    quality.train(docs, labels, 5)
    assert seen == [(5, len(quality.FEATURES))]


def test_trees_fit_what_they_see():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.98
    assert trees.score(x[:0]).shape == (0,)
    # a plain walk through the flat arrays
    assert all(abs(got - walk(trees, row)) < 1e-12 for row, got in zip(x[:50], trees.score(x[:50])))
