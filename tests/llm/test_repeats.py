import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import blocks, repeats
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(docs, window):
    texts = [(r.doc_id, WORD.findall(r.text or "")) for r in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def passages(spark):
    """Texts that share passages at both ends, inside, twice in one text, and often enough to be common."""
    shared, rows = [fx.words(60, 100 + i) for i in range(3)], []
    for i in range(300):
        rows.append((1000 + i, f"{fx.words(i % 50, i)} {shared[i % 2]} {fx.words(30 + i % 7, 7000 + i)}", "en", "s", 0))
    rows.append((2000, f"{shared[2]} {fx.words(40, 5)} {shared[2]}", "en", "s", 0))
    rows.append((2001, " ".join(["round", "and"] * 60), "en", "s", 0))
    rows.append((2002, " ".join(fx.words(90, 9).split()[20:60]), "en", "s", 0))
    rows.append((2003, fx.words(90, 9), "en", "s", 0))
    return rows


@pytest.mark.parametrize("window, gram", [(35, 12), (6, 3), (12, 12)])
def test_awkward_rows(spark, window, gram):
    docs = fx.awkward_docs(spark, passages(spark)).repartition(3)
    got = repeats.remove_repeats(docs, window=window, gram=gram)
    assert fx.rows(got) == expected(docs.collect(), window)


@pytest.mark.parametrize("few", [True, False])
def test_common_ends_and_small_batches(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(repeats, "COMMON_HERE", 2)
        monkeypatch.setattr(repeats, "COMMON", 3)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 2000)
    docs = fx.awkward_docs(spark, passages(spark)).repartition(3)
    assert fx.rows(repeats.remove_repeats(fx.clashing(docs))) == expected(docs.collect(), 35)


@pytest.mark.parametrize("depth", [1, 2, 5, 12, 35])
def test_names_are_the_words(depth):
    words = np.random.default_rng(depth).integers(0, 3, 4000)
    names = repeats._names(words, depth)
    assert len(names) == len(words) - depth + 1
    told = {}
    for i, k in enumerate(names.tolist()):
        assert told.setdefault(k, tuple(words[i : i + depth])) == tuple(words[i : i + depth])
    assert len(set(told.values())) == len(told)
    assert [told[k] for k in sorted(told)] == sorted(told.values())  # the order of the tree


def test_colliding_hashes(spark, monkeypatch):
    """All words have one of two hashes: groups mix, yet words are compared."""
    monkeypatch.setattr(repeats, "_mix", lambda x: x & np.uint64(1))
    docs = fx.awkward_docs(spark, passages(spark)[:60]).repartition(3)
    assert fx.rows(repeats.remove_repeats(docs)) == expected(docs.collect(), 35)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 1500)
    long = fx.words(6000, 50).split()
    rows = [(1, " ".join(long)), (2, "\n\t".join(long[300:900]) + " \n"), (3, " ".join(long[2990:3024])), (4, " ".join(long[2990:3025])), (5, " ".join(long[5965:]) + " " + "z" * 4000), (6, "z" * 5000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], fx.DOCS)
    assert fx.rows(repeats.remove_repeats(docs)) == expected(docs.collect(), 35)


def test_one_window_in_many_batches(spark, monkeypatch):
    """A common window comes once in most batches, so only the last step sees that it repeats."""
    monkeypatch.setattr(repeats, "BATCH_BYTES", 400)
    monkeypatch.setattr(repeats, "COMMON", 5)
    shared = fx.words(35, 77)
    docs = spark.createDataFrame([(i, f"{fx.words(20, i)} {shared} {fx.words(20, 900 + i)}", "en", "s", 0) for i in range(200)], fx.DOCS)
    monkeypatch.setattr(repeats, "_SENT_WORDS", 40)
    got = repeats.remove_repeats(docs)
    assert fx.rows(got) == expected(docs.collect(), 35) and min(r.n_removed for r in got.collect()) == 35


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = [r[:4] for r in expected(docs.collect(), 35)]
    assert fx.rows(repeats.remove_repeats(docs, keep_text=False)) == want


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], fx.DOCS)).collect() == []


@pytest.mark.parametrize("texts", [2000, 8000])
def test_the_largest_group_stays_flat(spark, texts):
    """A passage in a tenth of all texts: the rows that meet by an end or a window grow with the blocks, not the texts."""
    docs = spark.range(texts).selectExpr(
        "id as doc_id", f"concat_ws(' ', array_join(transform(sequence(1, 60), i -> substring(md5(concat(id, ' ', i)), 1, 5)), ' '), if(id % 10 = 0, '{fx.words(60, 1)}', ''), md5(cast(-id as string)), repeat('x y ', 1)) as text"
    )
    size = blocks.total_bytes(docs, "text")
    frame, ranges = blocks.text_blocks(docs, size), blocks.Ranges(size // 64)

    def send(t):
        keys, count = repeats._block_keys(repeats._scan(blocks.in_order(t), 35, 12), ranges)
        return ranges.rows(t.column("block")[0].as_py(), keys, count >= 4)

    told = blocks.answers(frame.groupBy("block").applyInArrow(send, blocks.SENT), 16)
    for common, key in ((False, "key"), (True, "words")):
        both = frame.groupBy("block").cogroup(told.groupBy("block"))
        rows = both.applyInArrow(lambda t, a: repeats._suffixes(t, a, ranges, 35, 12, common), repeats._SUFFIXES)  # noqa: B023
        largest = rows.where("words is not null").groupBy(key).count().agg({"count": "max"}).first()[0]
        assert (largest or 0) <= blocks.LEAST_BLOCKS and (common is False or largest > 10)
