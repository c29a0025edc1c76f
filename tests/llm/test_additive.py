import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corvane.llm import additive
from tests.llm import fixtures as fx

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    ok = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is not None and v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[r.vec_id] = np.array(v, np.float64)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        score = (x * ok[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_embeddings_table(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        assert recall(found(additive.search(rows)), brute(rows.collect())) > 0.95


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(additive, "CANDIDATES", 30)
    monkeypatch.setattr(additive, "QUERIES", 5)
    monkeypatch.setattr(additive, "LIST_ROWS", 100)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert recall(found(additive.search(fx.clashing(rows))), brute(rows.collect())) > 0.95


def test_recall_on_many_vectors(spark, tmp_path):
    """40,000 vectors, every list much longer than what is scored again: 2,000 of the table, each with 19 near ones."""
    table = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], np.float32)
    rng = np.random.default_rng(5)
    x = np.repeat(table, 20, axis=0) + rng.normal(scale=0.05, size=(20 * len(table), table.shape[1])).astype(np.float32)
    ids = rng.permutation(len(x))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(ids), "embedding": flat}), str(tmp_path / "vectors.parquet"), row_group_size=5000)
    df = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    got, chosen = found(additive.search(df, every=100)), np.flatnonzero(ids % 100 == 0)
    scores = x[chosen].astype(np.float64) @ x.T.astype(np.float64)
    scores[np.arange(len(chosen)), chosen] = -np.inf
    best = {int(ids[i]): set(ids[np.argsort(-s)[:20]].tolist()) for i, s in zip(chosen, scores)}
    assert got.keys() == best.keys() and len(x) == 40_000
    assert np.mean([len({i for i, _ in got[q]} & best[q]) / 20 for q in best]) > 0.93


def test_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    vec = lambda n: [float(x) for x in rng.normal(size=n).astype(np.float32)]
    rows = [(i, vec(8)) for i in range(60)] + [(20, vec(8)), (20, rng.normal(size=8).tolist()), (40, vec(3)), (41, vec(3)), (60, vec(3)), (80, vec(67)), (81, vec(67)), (100, vec(5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for n, (j, w) in enumerate(rows) if n != i and len(w) == len(v))[:20]
            want += [(q, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in additive.search(df).collect()]
    assert sorted(got) == sorted(want)


def test_ties_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.normal(size=64).astype(np.float32)]
    same = vec()
    rows = [(i, same, 0) for i in range(200)] + [(200 + i, vec(), 0) for i in range(100)]
    rows += [(400, None, 0), (420, [0.0] * 64, 0), (440, [float("nan")] * 64, 0), (460, [None] + same[1:], 0), (480, [float("inf")] + same[1:], 0)]
    rows += [(500, same[:10], 0), (None, same, 0), (520, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, got = brute(df.collect()), found(additive.search(df))
    assert want.keys() == got.keys()
    for q in range(0, 200, 20):  # equal vectors: exactly the least ids
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] == [i for i in range(22) if i != q][:20]
    for q in got:
        assert [s for _, s in got[q]] == [s for _, s in want[q]]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (20, [0.0, 3.0], 0)], SCHEMA)
    assert found(additive.search(df)) == {0: [(1, 2.0), (20, 0.0)], 20: [(0, 0.0), (1, 0.0)]}
    assert additive.search(spark.createDataFrame([], SCHEMA)).collect() == []


def test_beam_search_finds_no_worse_codes():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    books = additive.fit(x, books=4, words=32)
    error = [((x - additive.decode(additive.encode(x, books, beam), books)) ** 2).sum() for beam in (1, 4, 16)]
    assert error[0] > error[1] > error[2]


def test_no_neighbour_is_missed_on_other_rows(spark, tmp_path, monkeypatch):
    """Gaussian vectors in one long list, and three vectors that most rows repeat beside others: each query finds nearly all."""
    monkeypatch.setattr(additive, "LIST_ROWS", 1500)
    rng = np.random.default_rng(7)
    spread = rng.normal(size=(9000, 64))
    copies = np.concatenate([np.repeat(spread[:3], 2700, axis=0), spread[:900]])
    for name, x in (("spread", spread), ("copies", copies)):
        x, ids = x.astype(np.float32), rng.permutation(9000)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
        pq.write_table(pa.table({"vec_id": pa.array(ids), "embedding": flat}), str(tmp_path / name), row_group_size=3000)
        got, chosen = found(additive.search(spark.read.parquet(str(tmp_path / name)))), np.flatnonzero(ids % 20 == 0)
        scores = x[chosen].astype(np.float64) @ x.T.astype(np.float64)
        scores[np.arange(len(chosen)), chosen] = -np.inf
        least = np.partition(scores, -20, axis=1)[:, -20]
        shares = [np.mean([s >= b - 1e-9 * abs(b) for _, s in got[int(ids[i])]]) for i, b in zip(chosen, least)]
        assert np.mean(shares) > 0.99 and min(shares) >= 0.8
