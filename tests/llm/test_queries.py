"""The registered queries of the operators on whole tables: against their SQL in DuckDB, or against brute force."""
import functools

import duckdb
import pytest

from corvane.llm import pieces as P
from corvane.llm.queries import QUERIES, SQL
from tests.llm import fixtures as fx
from tests.llm import test_additive, test_repeats, test_simhash

SF = "/root/testdata/sf0.01"


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    a = sorted(([plain(x) for x in r] for r in got.select(*cols).collect()), key=repr)
    b = sorted(([plain(x) for x in r] for r in con.sql(f"select {names} from ({SQL[name]})").fetchall()), key=repr)
    assert a == b and a


def test_op1(spark):
    got = QUERIES["op1_simhash_near_dedup"](spark, SF)
    assert fx.rows(got) == test_simhash.expected(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_op5(spark):
    model = P.pieces(P.MODEL)

    @functools.cache
    def best(word):  # Viterbi over one word, by hand
        name = word.replace("\u2581", "\0").replace(" ", "\u2581")
        score = [0.0]
        for j in range(1, len(name) + 1):
            ways = [score[j - 1] + model.unknown] if name[j - 1] not in model.ids else []
            ways += [score[i] + model.score[model.ids[name[i:j]]] for i in range(max(0, j - model.longest), j) if name[i:j] in model.ids]
            score.append(max(ways))
        return score[-1]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op5_sentencepiece"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id]
        want = sum(best(w) for w in P._WORDS.findall(" " + text)) if text else 0.0
        assert abs(r.score - want) < 1e-6 * (1 + abs(want)) and r.round_trip and r.n_pieces == len(r.ids)
        assert P.decode_ids(r.ids, model) == text


def test_op6(spark):
    got = test_additive.found(QUERIES["op6_additive_quantisation"](spark, SF))
    assert test_additive.recall(got, test_additive.brute(spark.read.parquet(f"{SF}/embeddings.parquet").collect())) > 0.95


def test_op10(spark):
    got = fx.rows(QUERIES["op10_suffix_trees"](spark, SF))
    assert got == [r[:4] for r in test_repeats.expected(spark.read.parquet(f"{SF}/documents.parquet").collect(), 35)]
