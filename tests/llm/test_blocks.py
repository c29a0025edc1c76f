"""Texts in blocks, and keys told by bits."""
import random

import numpy as np
import pytest

from corvane.llm import blocks
from tests.llm import fixtures as fx


def test_each_text_once(spark):
    docs = fx.awkward_docs(spark, [(50, "same", "en", "s", 0)] * 30 + [(None, "same", "en", "s", 0), (None, "only here", "en", "s", 0)]).repartition(4)
    size = blocks.total_bytes(docs, "text")
    got = blocks.text_blocks(fx.clashing(docs), size).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.text or "", []).append(blocks.LARGEST if r.doc_id is None else r.doc_id)
    assert {bytes(r.data).decode(): (r.least, r.copies) for r in got} == {t: (min(ids), len(ids)) for t, ids in want.items()}
    assert len(got) == len(want) and all(r.block == r.u1 % blocks.LEAST_BLOCKS for r in got)
    named = docs.selectExpr("concat('x', doc_id) as doc_id", "text")
    assert {r.least for r in blocks.text_blocks(named, size).collect()} == {blocks.LARGEST}
    empty = docs.limit(0)
    assert blocks.total_bytes(empty, "text") == 0 and blocks.text_blocks(empty, 0).collect() == []


@pytest.mark.parametrize("common", [2, 3, 100])
def test_keys_are_told_by_bits(spark, common):
    rng, ranges = random.Random(common), blocks.Ranges(1000)
    pool = [rng.getrandbits(64) for _ in range(300)]
    sent, own = [], {}
    for block in range(6):
        keys = np.unique(ranges.cut(np.array(rng.sample(pool, 120), np.uint64)))
        crowded = np.array([rng.random() < 0.02 for _ in keys])
        own[block] = keys, crowded
        sent += ranges.rows(block, keys, crowded).to_pylist()
    told = blocks.answers(spark.createDataFrame([tuple(r.values()) for r in sent], blocks.SENT).repartition(5), common).toArrow()
    holders, full = {}, set()
    for block, (keys, crowded) in own.items():
        full |= set(keys[crowded].tolist())
        for k in keys.tolist():
            holders.setdefault(k, set()).add(block)
    for block, (keys, _) in own.items():
        mine = told.filter(np.array(told.column("block").to_pylist()) == block)
        repeated, many = ranges.flags(keys, mine)
        assert repeated.tolist() == [len(holders[k]) > 1 for k in keys.tolist()]
        assert many.tolist() == [len(holders[k]) >= common or k in full for k in keys.tolist()]


def test_least_hashes_are_spread():
    """Keys are the least of many hashes, small numbers, yet all ranges get about as many."""
    rng, ranges = np.random.default_rng(1), blocks.Ranges(1000)
    keys = rng.integers(0, 2**64, (60_000, 27), np.uint64).min(axis=1) | np.uint64(1)
    counts = np.bincount((ranges.cut(keys) >> np.uint64(32)).astype(int), minlength=2**ranges.bits)
    assert len(counts) == 2**ranges.bits and counts.max() < 2 * counts.mean() and len(np.unique(ranges.cut(keys))) > 59_900


def test_no_keys(spark):
    assert blocks.answers(spark.createDataFrame([], blocks.SENT), 5).collect() == []
    ranges = blocks.Ranges(0)
    none = np.zeros(0, np.uint64)
    assert ranges.rows(1, none, none.astype(bool)).num_rows == 0
