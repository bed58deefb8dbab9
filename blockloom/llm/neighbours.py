"""Nearest neighbours by inner product: a block matrix join with int8 tiles.

Queries are cut into blocks and candidates into slices; a task gets one block and one slice
and holds the block while it streams the slice. A tile of queries times candidates is first
multiplied in int8 (as whole numbers held in float32, exact for the sums that occur). With a
scale s and whole numbers q of each vector, |x - s q| <= s / 2 in every component, so the
inner product differs from s_x s_y <q_x, q_y> by at most
s_x s_y (|q_x|_1 / 2 + |q_y|_1 / 2 + d / 4). Pairs whose upper bound reaches the k-th best
lower bound are computed again in double precision from the original vectors, and the k
best of each query are merged into its heap. No pair that could be among the k best is
lost, so the result is exact. A candidate is sent once for each block of ``QUERY_BLOCK`` queries and a query once for
each slice of ``SLICE_ROWS`` candidates: bytes moved grow with the product of both counts, as the work does, over those sizes.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite
component take no part, nor do rows without vec_id; vectors meet only those of their own
length; ties go to the smaller vec_id; a query meets no row of its own vec_id; equal query
rows are one query, query rows of one vec_id with different vectors share one list of their k nearest pairs, repeated candidate rows each count; fewer than k candidates are all
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

QUERY_BLOCK, SLICE_ROWS, LEAST_SLICES, TILE = 16_384, 262_144, 8, 2048
#: Components whose products of whole numbers are summed in float32 without rounding.
EXACT_DIMS = 1024
K = 20


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of -127 to 127 (as float32), scales, and half the sums of their absolute values plus d / 8."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.abs(q).sum(axis=1) / 2 + x.shape[1] / 8


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= EXACT_DIMS:
        return a @ b.T
    return sum((a[:, i : i + EXACT_DIMS] @ b[:, i : i + EXACT_DIMS].T).astype(np.float64) for i in range(0, a.shape[1], EXACT_DIMS))


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed from the first component to the last."""
    total = np.zeros(len(x))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        total += a * b
    return total


class Block:
    """Queries of one length with the best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.scale, self.slack = quantise(x)
        self.score = np.full((len(ids), k), -np.inf)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        q, scale, slack = quantise(y)
        for i in range(0, len(self.ids), TILE):
            for j in range(0, len(ids), TILE):
                self._tile(slice(i, i + TILE), ids[j : j + TILE], y[j : j + TILE], q[j : j + TILE], scale[j : j + TILE], slack[j : j + TILE])

    def _tile(self, at: slice, ids, y, q, scale, slack) -> None:
        k, unit = self.k, self.scale[at][:, None] * scale[None]
        product = whole_products(self.q[at], q) * unit
        error = (self.slack[at][:, None] + slack[None]) * unit * (1 + 1e-9) + np.abs(product) * 1e-9
        own = self.ids[at][:, None] == ids[None]
        low = np.where(own, -np.inf, product - error)
        least = self.score[at][:, -1]
        if low.shape[1] >= k:
            least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        r, c = np.nonzero((product + error >= least[:, None]) & ~own)
        if not len(r):
            return
        exact = np.concatenate([in_order(self.x[at][r[i : i + 50_000]], y[c[i : i + 50_000]]) for i in range(0, len(r), 50_000)])
        n = self.score[at].shape[0]
        row = np.concatenate([np.repeat(np.arange(n), k), r])
        score = np.concatenate([self.score[at].ravel(), exact])
        best = np.concatenate([self.best[at].ravel(), ids[c]])
        order = np.lexsort((best, -score, row))
        first = np.searchsorted(row[order], np.arange(n))
        take = order[(first[:, None] + np.arange(k)[None]).ravel()]
        self.score[at], self.best[at] = score[take].reshape(n, k), best[take].reshape(n, k)

    def rows(self) -> pa.RecordBatch:
        keep = np.isfinite(self.score)
        query = np.repeat(self.ids, keep.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.best[keep]), pa.array(self.score[keep])], names=["query_id", "vec_id", "score"])


def _by_length(ids: np.ndarray, vectors: pa.ListArray):
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), ids[rows], flat[(ends[rows] - d)[:, None] + np.arange(d)[None]]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries and candidates (vec_id, embedding)."""
    part = lambda df: df.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    q, c = part(queries).dropDuplicates(["vec_id", "embedding"]), part(candidates)
    blocks = -(-max(1, queries.count()) // query_block)
    slices = max(LEAST_SLICES, -(-candidates.count() // slice_rows))
    tasks = blocks * slices
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    q_rows = q.withColumn("block", spread(blocks)).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), "block", F.lit(0).alias("kind"), "vec_id", "embedding")
    c_rows = c.withColumn("s", spread(slices)).select("s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    tiles = q_rows.unionByName(c_rows).select((F.col("block") * slices + F.col("s")).alias("task"), "kind", "vec_id", "embedding")
    tiles = tiles.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "kind")

    def run(batches):
        held: dict[int, list] = {}
        blocks_of: dict[int, Block] | None = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edge = int(np.searchsorted(kinds, 1))
            if edge:
                for d, ids, x in _by_length(batch.column("vec_id").slice(0, edge).to_numpy(), batch.column("embedding").slice(0, edge)):
                    held.setdefault(d, []).append((ids, x))
            if edge < len(kinds):
                if blocks_of is None:
                    blocks_of = {d: Block(np.concatenate([i for i, _ in p]), np.concatenate([x for _, x in p]), k) for d, p in held.items()}
                for d, ids, y in _by_length(batch.column("vec_id").slice(edge).to_numpy(), batch.column("embedding").slice(edge)):
                    if d in blocks_of:
                        blocks_of[d].meet(ids, y)
        for b in (blocks_of or {}).values():
            yield b.rows()

    found = tiles.select("kind", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") % 20 == 0), rows)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 20
"""
