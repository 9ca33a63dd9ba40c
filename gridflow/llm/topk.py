"""Exact top-k inner products: vectors by descending length, rotated, pruned by residual bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridflow.llm.common import stored

SCALE = 256
#: Bytes of queries that are sent to the tasks at a time; further queries go in further blocks.
BLOCK_BYTES = 16 << 20
#: Longest vectors whose products give each query its first bound.
HEAD = 1024
QUERY_ROWS, VECTOR_ROWS = 1024, 2048
EXACT = 2.0**53
#: Stands for a null id, last among ties, while vectors are compared.
NO_ID = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as bigint, of rows with finite components only; a null id is NO_ID."""
    valid = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(vec_col).isNotNull()).filter(valid)
    return rows.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(scale * x.cast("double"))).alias("v"),
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy().astype(np.float64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[k, : b - a] = flat[a:b]
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first, from the sum of their outer products.

    The driver gets width * (width + 1) / 2 sums, which the width of a vector bounds.
    """

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0), width)
            m = m / max(1.0, np.abs(m).max(initial=0.0))
            total += m.T @ m
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"]
        )

    gram = np.zeros((width, width))
    for r in vectors.select("v").mapInArrow(outer, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.s
    return np.linalg.eigh(gram)[1][:, ::-1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors as bigints: by doubles where all sums are exact, else by integers."""
    bound = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array(
        [[int(x) for x in row] for row in b], object
    ).reshape(b.shape).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def at_most(scores: np.ndarray) -> np.ndarray:
    """Doubles that are no larger than whole numbers: beyond 2**53 one step lower, as they may have been rounded up."""
    near = scores.astype(float)
    return np.where(np.abs(near) < EXACT, near, np.nextafter(near, -np.inf))


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        touched = np.zeros(len(self.least), bool)
        touched[query] = True
        old = touched[self.query]
        q = np.r_[self.query[old], query]
        s, v = np.r_[self.score[old], score], np.r_[self.vec[old], vec]
        order = np.lexsort((v, ~s, q))  # ~s falls as s rises, at every bigint
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], at_most(s[last]))
        self.query = np.r_[self.query[~old], q[keep]]
        self.score, self.vec = np.r_[self.score[~old], s[keep]], np.r_[self.vec[~old], v[keep]]


def first_bounds(queries: np.ndarray, ids: np.ndarray, head: np.ndarray, head_ids: np.ndarray, k: int) -> np.ndarray:
    """A score that k other vectors reach, per query: the k-th best among the longest vectors."""
    out = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), QUERY_ROWS):
        part = slice(at, at + QUERY_ROWS)
        s = at_most(products(queries[part], head))
        s[ids[part, None] == head_ids[None, :]] = -np.inf
        if s.shape[1] >= k:
            out[part] = np.sort(s, axis=1)[:, -k]
    return out


def scan(block: dict, k: int, lead: int):
    """Arrow function over (vec_id, v) in descending length: the k best of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        queries, ids, turn = b["queries"], b["ids"], b["turn"]
        width = queries.shape[1]
        size = np.sqrt((queries * queries).sum(axis=1))
        turned = queries @ turn
        rest = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
        best = Best(len(queries), k, b["least"])
        for batch in batches:
            everything, names = matrix(batch.column(1), width), batch.column(0).to_numpy()
            for at in range(0, len(names), VECTOR_ROWS):
                v, vec = everything[at : at + VECTOR_ROWS], names[at : at + VECTOR_ROWS]
                length = np.sqrt((v * v).sum(axis=1))
                slack = 1e-9 * (1 + size * length.max(initial=0.0))
                alive = np.flatnonzero(size * length.max(initial=0.0) + slack >= best.least)
                if not len(alive):
                    continue  # no later vector is longer, but the input must be read to its end
                w = v @ turn
                left = np.sqrt((w[:, lead:] ** 2).sum(axis=1))
                for q0 in range(0, len(alive), QUERY_ROWS):
                    q = alive[q0 : q0 + QUERY_ROWS]
                    bound = turned[q, :lead] @ w[:, :lead].T + rest[q, None] * left[None, :] + slack[q, None]
                    able = bound >= best.least[q, None].astype(float)
                    able &= ids[q, None] != vec[None, :]
                    if not able.any():
                        continue
                    rows, cols = able.any(axis=1), able.any(axis=0)
                    s = products(queries[q[rows]], v[cols])
                    able = able[np.ix_(rows, cols)] & (s >= best.least[q[rows], None])
                    i, j = able.nonzero()
                    best.add(q[rows][i], s[i, j], vec[cols][j])
        out = [ids[best.query], best.vec, best.score]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

    return run


def top_products(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with other rows.

    Components are floor(scale * x). `is_query` picks the queries; every other row is a
    candidate, exactly. Vectors are dealt by descending length and rotated onto the right
    singular vectors of all; a task drops a pair when the lengths, or the first coordinates
    plus the product of the residual lengths, cannot reach the query's k-th score so far.
    Queries are sent in blocks of at most `block_bytes`, each compared with all rows.

    Rows with a null vector, or a null or non-finite component, take no part. Rows with a null
    id are candidates, shown with their null and last among ties, but never queries; the largest
    bigint cannot be an id.
    Shorter vectors count as filled with zeros. Ties go to the smaller vec_id. Repeated rows
    are candidates each; a row never matches its own vec_id, and of rows that repeat a
    query's vec_id the least vector is the query. A query without candidates, or an empty
    table, gives no rows. Scores outside the range of a long stop at its ends.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted as doubles: components may be as large as a bigint
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    if not df.filter(F.col(id_col) == NO_ID).isEmpty():
        raise ValueError(f"{NO_ID} cannot be an id")
    vectors = whole_vectors(df, id_col, vec_col, scale).withColumn("length", length)
    order = [F.col("length").desc(), F.col("vec_id")]
    vectors = stored(vectors.repartitionByRange(n, *order).sortWithinPartitions(*order), "vectors")
    width = vectors.agg(F.max(F.size("v")).alias("w")).first().w or 0
    queries = whole_vectors(df.filter(is_query & F.col(id_col).isNotNull()), id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30))), "queries")
    total = queries.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    turn = rotation(vectors, width)
    lead = max(1, width // 4)
    longest = vectors.select("vec_id", "v", "length").orderBy(*order).limit(HEAD).collect()
    pad = lambda rows: np.array([list(map(float, r.v)) + [0.0] * (width - len(r.v)) for r in rows]).reshape(len(rows), width)
    head, head_ids = pad(longest), np.array([r.vec_id for r in longest], np.int64)
    blocks = max(1, -(-total * 8 * max(1, width) // block_bytes))
    found = []
    for b in range(blocks):
        rows = queries.filter(F.col("block") % blocks == b).orderBy("vec_id").collect()
        if not rows:
            continue
        q, ids = pad(rows), np.array([r.vec_id for r in rows], np.int64)
        shared = spark.sparkContext.broadcast(
            {"queries": q, "ids": ids, "turn": turn, "least": first_bounds(q, ids, head, head_ids, k)}
        )
        scanned = vectors.select("vec_id", "v").mapInArrow(scan(shared, k, lead), "query_id bigint, vec_id bigint, score bigint")
        found.append(stored(scanned, "scores") if blocks > 1 else scanned)
    every = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    shown = F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id")
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", shown, "score")
