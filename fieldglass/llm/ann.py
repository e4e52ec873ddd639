"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the residuals' codebooks are fitted on the driver, on at most SAMPLE vectors (those with the smallest
hash of their id). Every vector is indexed: its list is that of its nearest centroid, and its residual is coded with a byte
for each of SUBSPACES parts. A query visits the lists whose centroids have the largest inner product with it. How many is
measured: for TRIALS of the queries the true neighbours are found by brute force over all rows, and the fewest lists are
taken that hold at least GOAL of them on average. A query whose lists hold too few rows goes on to further lists until they
hold k candidates, so it returns k, or all there are. In a list a query adds one table entry for each code byte to the
centroid's product (asymmetric distances: the query itself isn't quantised), and the rows of the RERANK best codes are
scored exactly, in double precision, on the original vectors: many copies of one vector are one code, so they don't keep
other rows from being scored. So are the rows of every further code that may hold one of the k best: its entries plus the
query's length times the longest error of its rows bound them. A visited list thus loses no neighbour, however coarse the
codes are for its rows. The nearest of all lists are the answer.

A list is searched in cells: blocks of at most CELL vectors by at most CELL queries. A vector that a third of all rows
hold makes one long list of many cells, never one large task. Ties go to the smaller id at every step: equal vectors have
equal codes and equal sums.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id.
An inner product needs equal lengths, so vectors of each length are indexed and searched among themselves. Vectors of doubles
are kept and scored as doubles. Rows that repeat an id count once (the smallest vector). A query that has fewer than k
candidates returns them all. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Shared, table

SAMPLE, SUBSPACES, CODES, ROUNDS, SEED = 16_384, 16, 256, 10, 3
#: Lists hold LIST vectors, if there are enough for LEAST_LISTS of them.
MAX_LISTS, LEAST_LISTS, LIST, TRIALS, GOAL, RERANK, CELL, K = 4096, 32, 2048, 256, 0.98, 200, 4096, 20


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a centroid that loses all its rows keeps its place."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.permutation(len(distinct))[:k]].astype(np.float32)
    for _ in range(rounds):
        near = _nearest(x, centroids)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centroids[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids.astype(np.float64) ** 2).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(half - x[at : at + 4096].astype(np.float64) @ centroids.T.astype(np.float64), axis=1)
    return out


@dataclass
class Index:
    dim: int
    coarse: np.ndarray  # lists x dim
    books: list[np.ndarray]  # of each part: codes x width

    @property
    def width(self) -> int:
        return -(-self.dim // SUBSPACES)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """rows x SUBSPACES x width, padded with zeros."""
        return np.pad(x, ((0, 0), (0, self.width * SUBSPACES - self.dim))).reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code bytes. Equal vectors are coded once, so that they are coded alike."""
        distinct, back = np.unique(x, axis=0, return_inverse=True)
        lists = _nearest(distinct, self.coarse)
        parts = self._parts(distinct - self.coarse[lists])
        codes = np.stack([_nearest(parts[:, i], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)
        return lists[back.ravel()], codes[back.ravel()]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The code words of residuals, in double precision."""
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)[:, : self.dim].astype(np.float64)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x SUBSPACES x CODES: inner products with the code words."""
        parts = self._parts(q)
        out = np.zeros((len(q), SUBSPACES, CODES), np.float32)
        for i, b in enumerate(self.books):
            out[:, i, : len(b)] = parts[:, i] @ b.T
        return out


def fit(x: np.ndarray, lists: int, seed: int = SEED) -> Index:
    rng = np.random.default_rng(seed)
    coarse = _kmeans(x, lists, ROUNDS, rng)
    index = Index(x.shape[1], coarse, [])
    parts = index._parts(x - coarse[_nearest(x, coarse)])
    index.books = [_kmeans(parts[:, i], CODES, ROUNDS, rng) for i in range(SUBSPACES)]
    return index


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kept = vectors.select(vector_col).dtypes[0][1]
    v = F.col(vector_col).cast(kept if kept == "array<float>" else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).where(F.exists("vec", lambda x: x != 0))


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """The n largest; of equal scores the earlier."""
    if len(score) <= n:
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: n - len(above)]])


def _search_cell(index: Index, codes: np.ndarray, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: int) -> tuple[list, list, list]:
    order = np.argsort(ids, kind="stable")  # ties then go to the smaller id
    codes, ids, x = codes[order], ids[order], x[order].astype(np.float64)
    _, first, code_of = np.unique(codes.view(f"V{SUBSPACES}").ravel(), return_index=True, return_inverse=True)
    codes = codes[first].astype(np.int64)
    by_code = np.argsort(code_of, kind="stable")
    many = np.bincount(code_of, minlength=len(first))
    start = np.cumsum(many) - many
    # A row's product is that with its code word, with the middle of what the words leave, and with the rest, which is at
    # most the product of the lengths.
    words = index.decode(codes)
    rest = x - words[code_of]
    middle = rest.mean(axis=0)
    longest = np.zeros(len(first))
    np.maximum.at(longest, code_of, np.sqrt(((rest - middle) ** 2).sum(axis=1)))
    longest += 1e-5 * (np.sqrt((words**2).sum(axis=1)) + np.sqrt((middle**2).sum()))  # the tables are of single precision
    far = np.sqrt((x**2).sum(axis=1).max())
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(q), 64):
        some, whole = q[at : at + 64], None
        # The centroid's product is the same for all rows of a list.
        tables = index.tables(some)
        near = tables[:, 0][:, codes[:, 0]]
        for part in range(1, SUBSPACES):
            near += tables[:, part][:, codes[:, part]]
        for i, row in enumerate(near):
            me, asked = q_ids[at + i], some[i].astype(np.float64)
            codes_best = _best(row, rerank + 1)
            n = many[codes_best]
            best = by_code[np.repeat(start[codes_best] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            best = best[ids[best] != me]
            score = (x[best] * asked).sum(axis=1)
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            length = np.sqrt(asked @ asked)
            left = ~(row.astype(np.float64) + asked @ middle + longest * length < least)
            left[codes_best] = False
            more = np.zeros(0, np.int64)
            if left.any():
                # Products of a block differ from the exact sums in the last digits only.
                whole = some.astype(np.float64) @ x.T if whole is None else whole
                more = np.flatnonzero(left[code_of] & (ids != me) & ~(whole[i] < least - 1e-9 * length * far))
            more_score = (x[more] * asked).sum(axis=1)
            best, score = np.concatenate([best, more]), np.concatenate([score, more_score])
            top = np.lexsort((ids[best], -score))[:k]
            out_q += [me] * len(top)
            out_v += ids[best][top].tolist()
            out_s += score[top].tolist()
    return out_q, out_v, out_s


def probes_for(coded: DataFrame, coarse: np.ndarray, counts: np.ndarray, dim: int, every: int, k: int, trials: int = TRIALS, goal: float = GOAL) -> int:
    """How many lists hold, on average, at least ``goal`` of the k true neighbours of a query.

    The trial queries are those with the smallest hash of their id. Each task keeps k rows for each of them."""
    spark = coded.sparkSession
    sample = coded.where(F.col("vec_id") % every == 0).select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(trials).collect()
    if not sample:
        return len(coarse)
    q_ids, q = np.array([r.vec_id for r in sample], np.int64), np.array([r.vec for r in sample], np.float64)
    asked = spark.sparkContext.broadcast((q_ids, q))  # at most TRIALS vectors

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = asked.value
        held = [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)]  # score, id, list
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            score = vectors @ _matrix(b.column(1), dim).astype(np.float64).T
            score[ids[:, None] == own[None, :]] = -np.inf
            wide = [np.concatenate([h, np.broadcast_to(x, score.shape)], axis=1) for h, x in zip(held, (score, own, b.column(2).to_numpy(zero_copy_only=False)), strict=True)]
            top = np.argsort(-wide[0], axis=1, kind="stable")[:, :k]
            held = [np.take_along_axis(w, top, axis=1) for w in wide]
        keep = held[0] > -np.inf
        who = np.broadcast_to(np.arange(len(ids))[:, None], keep.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (who.astype(np.int64), held[0], held[1], held[2].astype(np.int64))], ["q", "score", "vec_id", "list"])

    rows = coded.select("vec_id", "vec", "list").mapInArrow(brute, "q long, score double, vec_id long, list long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("q", "list").collect()  # at most TRIALS * k rows
    place = np.empty((len(q), len(coarse)), np.int64)
    near = np.where(counts > 0, q @ coarse.T.astype(np.float64), -np.inf)
    np.put_along_axis(place, np.argsort(-near, axis=1, kind="stable"), np.arange(len(coarse))[None, :].repeat(len(q), axis=0), axis=1)
    at = np.array([r.q for r in true], np.int64)
    reached = np.bincount(place[at, np.array([r.list for r in true], np.int64)], weights=1 / np.bincount(at, minlength=len(q))[at], minlength=len(coarse)) if true else np.zeros(len(coarse))
    share = np.cumsum(reached) / max(len(np.unique(at)), 1)
    return int(min(np.searchsorted(share, goal) + 1, len(coarse)))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, probes: int | None = None, rerank: int = RERANK, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``. probes: lists that a
    query visits, measured if not given."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = _valid(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    found = None
    for dim, n in sorted(map(tuple, rows.groupBy(F.size("vec")).count().collect())):
        some = _nearest_of(rows.where(F.size("vec") == dim), dim, n, every, k, probes, rerank, cell)
        found = some if found is None else found.unionByName(some)
    return spark.createDataFrame([], schema) if found is None else found


def _nearest_of(unique: DataFrame, dim: int, n: int, every: int, k: int, probes: int | None, rerank: int, cell: int) -> DataFrame:
    """As ``nearest``, among n vectors of one length: vec_id, each once, and vec."""
    spark = unique.sparkSession
    scratch = Scratch(spark, "ann")
    vector = dict(unique.dtypes)["vec"]
    sample = unique.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r.vec for r in sorted(sample, key=lambda r: r.vec_id)], np.float32)
    index = fit(x, max(1, min(MAX_LISTS, len(x) // 16, max(LEAST_LISTS, n // LIST))))
    shared = Shared(spark, index)  # at most MAX_LISTS centroids and SUBSPACES * CODES code words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            lists, codes = index.encode(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], ["list", "vec_id", "code", "vec"])

    coded = scratch.keep(unique.mapInArrow(encode, f"list int, vec_id long, code binary, vec {vector}"))
    in_list = {r.list: r.n for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    counts = np.array([in_list.get(i, 0) for i in range(len(index.coarse))], np.int64)
    visited = probes if probes is not None else probes_for(coded, index.coarse, counts, dim, every, k)
    known = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            q = _matrix(b.column(1), dim)
            near = q.astype(np.float64) @ index.coarse.T.astype(np.float64)
            lists, who = [], []
            for i, row in enumerate(near):
                row = np.where(known.value > 0, row, -np.inf)
                order = np.argsort(-row, kind="stable")
                order = order[known.value[order] > 0]
                # Its own row is among the k + 1.
                enough = int(np.searchsorted(np.cumsum(known.value[order]), k + 1)) + 1
                order = order[: max(visited, enough)]
                lists += order.tolist()
                who += [i] * len(order)
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["list", "query_id", "q"])

    probed = scratch.keep(coded.where(F.col("vec_id") % every == 0).select("vec_id", "vec").mapInArrow(probe, f"list int, query_id long, q {vector}"))
    asked = {r.list: r.n for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    cells = spark.createDataFrame([(i, -(-int(counts[i]) // cell), -(-m // cell)) for i, m in sorted(asked.items())] or [(-1, 1, 1)], "list int, row_blocks long, query_blocks long")
    cells = F.broadcast(cells)  # at most MAX_LISTS rows
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = coded.join(cells, "list").withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks"))).withColumn("qb", F.explode(blocks(F.col("query_blocks")))).select("list", "rb", "qb", "vec_id", "code", "vec")
    right = probed.join(cells, "list").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks"))).withColumn("rb", F.explode(blocks(F.col("row_blocks")))).select("list", "rb", "qb", "query_id", "q")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        if a.num_rows and b.num_rows:
            codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            q, v, s = _search_cell(shared.value, codes, a.column("vec_id").to_numpy(), _matrix(a.column("vec").combine_chunks(), dim), b.column("query_id").to_numpy(), _matrix(b.column("q").combine_chunks(), dim), k, rerank)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["list", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
