"""Approximate nearest neighbours by additive quantisation, for the largest inner product.

A vector is coded as a sum of full-dimensional codewords, one from each codebook. The codebooks are fitted one after the
other to what the ones before leave over, on a bounded sample; encoding keeps the best few partial sums (beam search).
A row stores its codes and the ratio of its norm to that of its code. A query's inner products with all codewords form
a lookup table; sums of looked-up values, times the stored ratio, order the candidates, and the best are scored again
with the vectors themselves.

Within a block the best few are scored first; the k-th of them is a bar, and every row whose looked-up score comes within
MARGIN standard deviations of its error of that bar is scored again too. The error's size is known for each row, as what
its code leaves over, so blocks whose rows look alike have longer shortlists than others.

Vectors are kept in inverted lists by their nearest coarse centroid, each row in exactly one. A long list is cut into
blocks by row, so copies of one vector do not gather in a task; a list that very many queries ask is sent once for each
block of them.

A query asks the most promising lists first, as many as the root of all. The score of its k-th best there bounds what the
other lists need to answer: it asks those whose centroid and radius allow such a score, few where vectors form clusters, most
where they are spread evenly, and no list that could hold a better row is left out. Rows below the bound are not sent, so a
block that holds none of a query's best sends nothing for it. With b blocks and the first answers from a root of them, that
is some 2 k sqrt(b) rows for a query instead of k b.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import cut

BOOKS = 8
WORDS = 256
BEAM = 8
SAMPLE = 16_384
LIST_ROWS, MOST_LISTS = 4096, 1024  # rows for each list until there are so many lists
CANDIDATES, SPREAD = 32_768, 64  # rows of a list that meet in one task, fewer where the table would make few such blocks,
QUERIES = 32_768  # with so many queries
SHORTLIST = 100  # distinct vectors of a block that are scored again at least
MARGIN = 3.0  # standard deviations of a looked-up score's error within which rows are scored again
ODD_LISTS = 64  # for vectors of other lengths than most


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimension) by k-means on residuals."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        book = rest[rng.integers(0, len(rest), words)].copy()
        for _ in range(rounds):
            near = np.argmin((book**2).sum(1) - 2 * rest @ book.T, axis=1)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            full = np.flatnonzero(n)
            book[full] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
            if len(empty := np.flatnonzero(n == 0)):
                book[empty] = rest[rng.integers(0, len(rest), len(empty))]
        out.append(book)
        rest = rest - book[np.argmin((book**2).sum(1) - 2 * rest @ book.T, axis=1)]
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) that beam search finds; ties go to smaller codes."""
    n, rows = len(vectors), np.arange(len(vectors))[:, None]
    rest, codes = vectors[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8 if books.shape[1] <= 256 else np.uint16)
    for book in books:
        # squared norm of what each partial sum would leave, but for terms that all of a row share
        error = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = best[rows, np.argsort(flat[rows, best], axis=1, kind="stable")]
        of, word = np.divmod(best, len(book))
        rest = rest[rows, of] - book[word]
        codes = np.concatenate([codes[rows, of], word[:, :, None].astype(codes.dtype)], axis=2)
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, components all finite and not all zero."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(ok)


@dataclass(frozen=True)
class Model:
    """What is fitted on the sample: vectors are divided by `scale`, which keeps squares of large components finite."""

    scale: float
    books: np.ndarray  # (books, words, dimension)
    coarse: np.ndarray  # (lists, dimension)
    block: int  # rows of a list that meet queries in one task

    @property
    def dimension(self) -> int:
        return self.coarse.shape[1]

    @property
    def first(self) -> int:
        """Lists that a query asks first."""
        return math.isqrt(len(self.coarse) - 1) + 1


def _near(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * vectors.astype(np.float32) @ centroids.T, axis=1)


def train(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model for `rows` (vec_id, v), fitted on `sample` of them at most; None for an empty table."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    if not len(chosen):
        return None
    lengths = Counter(map(len, chosen))
    most = min(lengths, key=lambda d: (-lengths[d], d))
    data = np.unique(np.array([x for x in chosen if len(x) == most], np.float64), axis=0)  # copies would crowd out the others
    data = np.random.default_rng(0).permutation(data)
    scale = np.abs(data).max()
    data = (data / scale).astype(np.float32)
    n = rows.count()
    lists = min(MOST_LISTS, max(1, n // LIST_ROWS), len(data))
    coarse = fit(data, books=1, words=lists)[0]
    return Model(scale, fit(data, words=min(WORDS, len(data))), coarse, min(CANDIDATES, max(2 * LIST_ROWS, n // SPREAD)))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def index(rows: DataFrame, model: Model, beam: int = BEAM) -> DataFrame:
    """(row, vec_id, v, list, codes, ratio, far) in the shared folder; row tells rows apart. Every row is in one list.

    far: distance from the list's centroid.

    Vectors of another length than the model's are in lists of their own, without codes.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                length = pc.list_value_length(part.column("v")).to_numpy()
                usual = np.flatnonzero(length == m.dimension)
                lists, ratio, far = (len(m.coarse) + length % ODD_LISTS).astype(np.int32), np.ones(len(length)), np.zeros(len(length))
                blobs: list[bytes] = [b""] * len(length)
                if len(usual):
                    v = _matrix(part.column("v").take(pa.array(usual)), m.dimension) / m.scale
                    codes = encode(v, m.books, beam)
                    size = np.linalg.norm(decode(codes, m.books), axis=1)
                    ratio[usual] = np.divide(np.linalg.norm(v, axis=1), size, out=np.ones(len(v)), where=size > 0)
                    lists[usual] = _near(v, m.coarse)
                    far[usual] = np.linalg.norm(v - m.coarse[lists[usual]], axis=1) * m.scale
                    for i, c in zip(usual, codes):
                        blobs[i] = c.tobytes()
                cols = [*part.columns, pa.array(lists), pa.array(blobs, pa.binary()), pa.array(ratio), pa.array(far)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "vec_id", "v", "list", "codes", "ratio", "far"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    kind = dict(rows.dtypes)["v"]
    return cut(numbered.mapInArrow(run, f"row long, vec_id long, v {kind}, list int, codes binary, ratio double, far double"))


def _asked(queries: DataFrame, model: Model, radius: np.ndarray | None = None) -> DataFrame:
    """(list, row, vec_id, v, bound): each query once for every list that it asks: the most promising ones first.

    With the lists' radii the others: those that can hold a row that reaches the query's bound.
    """
    first = radius is None
    sent = queries.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            own = b.column("list").to_numpy()
            usual, odd = np.flatnonzero(own < len(m.coarse)), np.flatnonzero(own >= len(m.coarse))
            at, lists = ([odd], [own[odd]]) if first else ([], [])
            if len(usual):
                v = _matrix(b.column("v").take(pa.array(usual)), m.dimension)
                scores = (v / np.abs(v).max(axis=1, keepdims=True)).astype(np.float32) @ m.coarse.T
                order = np.argsort(-scores, axis=1, kind="stable")
                chosen = order[:, : m.first] if first else order[:, m.first :]
                asks = np.ones(chosen.shape, bool)
                if not first:
                    most = v @ (m.coarse.T.astype(np.float64) * m.scale)
                    slack = np.linalg.norm(v, axis=1, keepdims=True) * radius
                    bound = b.column("bound").to_numpy()[usual, None]
                    asks = np.take_along_axis(~(most + slack < bound - 1e-9 * (np.abs(most) + slack)), chosen, axis=1)
                lists.append(chosen[asks])
                at.append(np.repeat(usual, asks.sum(axis=1)))
            if at:
                cols = b.select(["row", "vec_id", "v", "bound"]).take(pa.array(np.concatenate(at))).columns
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), *cols], ["list", "row", "vec_id", "v", "bound"])

    kind = dict(queries.dtypes)["v"]
    return queries.select("row", "vec_id", "v", "list", "bound").mapInArrow(run, f"list int, row long, vec_id long, v {kind}, bound double")


def _best_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows by vector and id, begin, count): equal vectors are one entry, of which the k + 1 least ids can matter."""
    order = np.lexsort((ids, *x.T[::-1]))
    new = np.concatenate([[True], (x[order[1:]] != x[order[:-1]]).any(axis=1)])
    entry = np.cumsum(new) - 1
    few = np.arange(len(ids)) - np.flatnonzero(new)[entry] <= k
    order, entry = order[few], entry[few]
    count = np.bincount(entry)
    return order, np.cumsum(count) - count, count


_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def search(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shortlist: int = SHORTLIST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best other rows.

    score is the inner product in double precision; ties go to smaller ids. Rows without an id and vectors that are
    null, zero or not finite take no part. Vectors of another length than most meet those of their own length, and all
    of them. Rows that share an id are rows of their own: each is a query, and they find each other. Other columns are
    not read. An empty table gives none.
    """
    rows, spark = clean(vectors, id_col, vector_col), vectors.sparkSession
    model = train(rows)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coded, sent = index(rows, model), spark.sparkContext.broadcast(model)
    queries = coded.where(F.pmod("vec_id", F.lit(every)) == 0)
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = lambda found: found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    found = best(_found(coded, _asked(queries.withColumn("bound", F.lit(float("-inf"))), model), sent, k, shortlist))
    if model.first < len(model.coarse):
        radius = np.zeros(len(model.coarse))
        for r in coded.where(F.col("list") < len(radius)).groupBy("list").agg(F.max("far").alias("far")).collect():  # MOST_LISTS rows at most
            radius[r["list"]] = r.far
        near = cut(found)
        bounds = near.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
        bounded = queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        more = _found(coded, _asked(bounded, model, radius), sent, k, shortlist)
        found = best(near.drop("rank").unionByName(more))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(coded: DataFrame, asked: DataFrame, sent, k: int, shortlist: int) -> DataFrame:
    """What the blocks of the lists that are asked answer: for each query its k best rows, if they reach its bound."""
    # one row for each list, MOST_LISTS and ODD_LISTS at most
    blocks = lambda df, name, size: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cells = F.broadcast(cut(blocks(coded, "blocks", sent.value.block).join(blocks(asked, "askers", QUERIES), "list"), 1))
    of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    found = coded.join(cells, "list").withColumn("block", of("blocks", 1)).withColumn("asker", copies("askers")).drop("blocks", "askers")
    asked = asked.join(cells, "list").withColumn("asker", of("askers", 2)).withColumn("block", copies("blocks")).drop("blocks", "askers")

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        m, out = sent.value, []
        if queries.num_rows and found.num_rows:
            lengths = pc.list_value_length(found.column("v"))
            for d in pc.unique(lengths).to_pylist():
                own = found.filter(pc.equal(lengths, d))
                asking = queries.filter(pc.equal(pc.list_value_length(queries.column("v")), d))
                if asking.num_rows:
                    out += _meet(asking, own, m if d == m.dimension else None, d, k, shortlist)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table(dict(zip(("query_row", "query_id", "row", "vec_id", "score"), cols)))

    key = ["list", "block", "asker"]
    return asked.groupBy(*key).cogroup(found.groupBy(*key)).applyInArrow(meet, _FOUND)


def _meet(queries: pa.Table, found: pa.Table, model: Model | None, dimension: int, k: int, shortlist: int) -> list[tuple]:
    """For each query (query rows, query ids, rows, ids, scores) of its k best in `found` that reach the query's bound.

    Without a model all are scored.
    """
    number = lambda t, c: t.column(c).to_numpy()
    matrix = lambda t: _matrix(t.column("v").combine_chunks(), dimension)
    qrow, qid, q, bound = number(queries, "row"), number(queries, "vec_id"), matrix(queries), number(queries, "bound")
    rows, ids, x = number(found, "row"), number(found, "vec_id"), matrix(found)
    order, begin, count = _best_of_equals(ids, x, k)
    lead, out = order[begin], []
    few = min(shortlist, len(lead))
    if model is not None:
        codes = np.frombuffer(b"".join(found.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[lead]
        ratio = number(found, "ratio")[lead].astype(np.float32)
        error = np.linalg.norm(x[lead] / model.scale - decode(codes, model.books) * ratio[:, None], axis=1) * (MARGIN / math.sqrt(dimension))
    for at in range(0, len(q), 128):
        part = q[at : at + 128]
        if model is None or few == len(lead):
            best = np.broadcast_to(np.arange(len(lead)), (len(part), len(lead)))
        else:
            small = (part / np.abs(part).max(axis=1, keepdims=True)).astype(np.float32)
            scores = np.zeros((len(part), len(lead)), np.float32)
            for n, book in enumerate(model.books):
                scores += (small @ book.T)[:, codes[:, n]]
            scores *= ratio
            best = np.argpartition(-scores, few - 1, axis=1)[:, :few]
        for i, b in enumerate(best):
            near = x[lead[b]] @ part[i]
            if len(b) < len(lead):
                bar = max(np.partition(near, -k - 1)[-k - 1] if len(near) > k else -np.inf, bound[at + i])
                unit = np.abs(part[i]).max()
                might = ~(scores[i] + error * np.linalg.norm(small[i]) < bar / unit / model.scale)
                b = np.union1d(b, np.flatnonzero(might))
                near = x[lead[b]] @ part[i]
            top = b[np.argsort(-near, kind="stable")[: k + 1]]
            if near.max() < bound[at + i] - 1e-9 * abs(bound[at + i]):  # products in another order differ in the last bits
                continue
            take = order[np.concatenate([np.arange(begin[j], begin[j] + count[j]) for j in top])]
            take = take[rows[take] != qrow[at + i]]
            score = (x[take] * part[i]).sum(axis=1)
            take, score = take[score >= bound[at + i]], score[score >= bound[at + i]]
            last = np.lexsort((rows[take], ids[take], -score))[:k]
            out.append((np.full(len(last), qrow[at + i]), np.full(len(last), qid[at + i]), rows[take][last], ids[take][last], score[last]))
    return out
