import hashlib
from collections import defaultdict

from corvane.llm import exact
from tests.llm import fixtures as fx


def expected(docs):
    same = defaultdict(list)
    for r in docs:
        same[r.text or ""].append(r.doc_id)
    out = []
    for text, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    docs = fx.awkward_docs(spark)
    for df in (docs, fx.clashing(docs)):
        assert fx.rows(exact.exact_duplicates(df)) == expected(docs.collect())


def test_huge_documents_by_chunks(spark):
    docs = fx.awkward_docs(spark)
    assert fx.rows(exact.exact_duplicates(docs, chunk_bytes=64, huge_bytes=200)) == expected(docs.collect())


def test_colliding_fingerprints_are_told_apart(spark):
    texts = ["ab", "ba", "ab", "cd", "cd", "cd", "dc", "zz", "ab"]
    docs = spark.createDataFrame([(i, t, None, None, 2) for i, t in enumerate(texts)], fx.DOCS)
    weak = exact.Polynomial((1, 1), (1, 1))  # everything of one length collides
    assert fx.rows(exact.exact_duplicates(docs, poly=weak, chunk_bytes=1)) == expected(docs.collect())


def test_fingerprints_compose():
    poly, data = exact.Polynomial(), bytes(range(256)) * 9
    whole = poly.of(data, 1 << 20)
    p, b = poly.primes[0], poly.bases[0]
    assert whole[0] == sum(x * pow(b, len(data) - 1 - i, p) for i, x in enumerate(data)) % p
    for n in (1, 7, 64, 1000):
        assert poly.of(data, n) == whole
        assert poly.combine(poly.of(data[:n]), poly.of(data[n:]), len(data) - n) == whole


def test_empty_table_and_stage(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], fx.DOCS)).collect() == []
    docs = fx.awkward_docs(spark)
    kept = exact.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert len({r.text or "" for r in kept.collect()}) == kept.count() == len({r.text or "" for r in docs.collect()})


def test_rows_repeated_very_often(spark):
    rows = [(7, "again and again", None, None, 0)] * 3000 + [(8, "again and again", None, None, 0), (None, "again and again", None, None, 0)]
    docs = spark.createDataFrame(rows, fx.DOCS)
    assert fx.rows(exact.exact_duplicates(docs)) == expected(docs.collect())
