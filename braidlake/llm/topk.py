"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Candidates are dealt to blocks. A block's index has, for each quantised impact, the postings (vector,
dimension, sign) with that impact; vectors are dense, so a run of impacts is kept as a plane in which
each posting stands at its vector and dimension, and is processed for many queries by one matrix product.
Runs are processed by descending impact. After each, what is unread of a vector has a known norm, and so
has what is unread of the query on that vector's dimensions: by Cauchy-Schwarz every partial score has a
proven error. A query stops when the vectors that can still be among its k best take less work to score
exactly than the postings that are left; they are scored again exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlake.llm.common import stage, table

#: Impacts above 0 that a component's magnitude is quantised to.
LEVELS = 64
#: Shares of the postings that have been read when a query may stop.
STOPS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Components of a block's vectors, vectors of a block at least, queries of a block at most: a task holds one block of each.
CELLS, LEAST, QUERIES = 1 << 22, 1024, 16384
#: Queries processed at a time, which bounds the accumulators.
TOGETHER = 64
_LONG = 2**63 - 1


class Index:
    """Impact-ordered postings of integer vectors. `read` and `postings` count what searches have read, and would have without stopping."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.read = self.postings = self.rescored = 0
        size = np.abs(self.x.astype(np.float64))
        self.step = max(1.0, float(size.max(initial=0)) / levels)
        level = np.rint(size / self.step).astype(np.int32)  # the quantised impact, 0: no posting
        value = np.sign(self.x.astype(np.float64)) * level * self.step
        by_level = np.bincount(level.reshape(-1), minlength=2)
        count = np.cumsum(by_level[:0:-1])  # postings of the highest impact, of the two highest ...
        self.size = int(count[-1])
        top = len(by_level) - 1
        cuts = sorted({top - int(np.searchsorted(count, share * self.size - 0.5)) for share in STOPS}, reverse=True) if self.size else []
        left, off = size**2, (np.abs(value) - size) ** 2
        #: For each run: its plane, where it has postings, norms of what is unread and of what is off, postings so far.
        self.runs, above = [], np.iinfo(np.int32).max
        self.norms = [(np.sqrt(left.sum(1)), np.zeros(len(self.x)))]
        for cut in cuts:
            on = (level >= cut) & (level < above)
            done = level >= cut
            self.runs.append((np.where(on, value, 0).astype(np.float32), on.astype(np.float32), int(done.sum())))
            self.norms.append((np.sqrt(np.where(done, 0, left).sum(1)), np.sqrt(np.where(done, off, 0).sum(1))))
            above = cut

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's k best, without the vector of its own id; ties to the smaller id."""
        out: list = [None] * len(queries)
        dims = self.x.shape[1]
        for start in range(0, len(queries), TOGETHER):
            live = np.arange(start, min(len(queries), start + TOGETHER))
            q = queries[live].astype(np.float64)
            acc, covered = (np.zeros((len(self.ids), len(live)), np.float32) for _ in range(2))
            self.postings += self.size * len(live)
            for step in range(len(self.runs) + 1):
                if step:
                    plane, on, so_far = self.runs[step - 1]
                    acc += plane @ q.T.astype(np.float32)
                    covered += on @ (q**2).T.astype(np.float32)
                else:
                    so_far = 0
                if so_far < STOPS[0] * self.size:
                    continue
                norm = (q**2).sum(1)
                unread, off = (n[:, None].astype(np.float32) for n in self.norms[step])
                # Each part of the error by Cauchy-Schwarz, and a margin for 32-bit sums.
                root = np.sqrt(norm).astype(np.float32)
                whole = self.norms[0][0][:, None].astype(np.float32)
                margin = unread * np.sqrt(np.maximum(norm.astype(np.float32) * np.float32(1 + 1e-4) - covered, 0)) + off * root + np.float32(1e-5) * math.sqrt(dims) * whole * root + np.float32(1e-3)
                low, high = acc - margin, acc + margin
                done = []
                for j, n in enumerate(live):
                    own = np.flatnonzero(self.ids == query_ids[n])
                    low[own, j] = high[own, j] = -np.inf
                    bound = np.partition(low[:, j], -k)[-k] if len(low) - len(own) >= k else -np.inf
                    members = np.flatnonzero((high[:, j] >= bound) & (high[:, j] > -np.inf))
                    if step == len(self.runs) or len(members) * dims <= self.size - so_far:
                        score = exact(self.x[members], queries[n])
                        best = np.lexsort((self.ids[members], -score))[:k]
                        out[n] = (self.ids[members][best], score[best])
                        self.read += so_far
                        self.rescored += len(members)
                        done.append(j)
                if done:
                    keep = np.setdiff1d(np.arange(len(live)), done)
                    live, q, acc, covered = live[keep], q[keep], acc[:, keep], covered[:, keep]
                if not len(live):
                    break
        return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; what they can't hold becomes the least or greatest but one of them."""
    if not len(x) or np.abs(x.astype(float)).max(initial=0) * np.abs(q.astype(float)).max(initial=0) * x.shape[1] < 2.0**62:
        return x @ q
    return np.array([max(-_LONG, min(_LONG, int(s))) for s in x.astype(object) @ q.astype(object)], np.int64)


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double, as longs (the nearest one where it is none); null for a vector that is null or has a null or non-finite component."""
    x = vector.cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    most = F.lit(float(2**62))
    return F.when(~F.exists(x, bad), F.transform(x, lambda v: F.floor(F.greatest(-most, F.least(most, v * scale))).cast("long")))


def top_k(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all other vectors, ties to the smaller id.

    vector is an array of longs; rows where it is null or empty, and rows without an id, take no part.
    Vectors are compared with those of their own length. Fewer than k others: all of them. Rows repeated
    under one id count as the vector of that id each, and are ranked side by side; none of them is an
    answer to its own id. Scores that a long can't hold are the greatest or least one. No vectors or no
    queries: no rows. Only the named columns are read. Blocks of vectors meet blocks of queries; each
    pair gives k rows for a query, and these meet by query.
    """
    live = vectors.where(F.size(vector) > 0).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    live = stage(live.where("id IS NOT NULL"))
    n, asking, longest = live.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    most = max(1, CELLS // max(1, longest or 1))
    blocks = max(1, math.ceil(n / min(most, max(LEAST, n // 8))))
    groups = max(1, math.ceil(asking / QUERIES))
    hashed = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    every = live.select("id", "v", hashed(blocks).alias("block")).withColumn("group", spread(groups))
    asks = live.where("asks").select("id", "v", hashed(groups).alias("group")).withColumn("block", spread(blocks))

    def meet(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        got, there = [], dict(_matrices(candidates))
        for length, (qids, q) in _matrices(questions):
            if length in there:
                found = Index(*there[length]).search(qids, q, k)
                got += [(np.repeat(qids[i], len(a)), a, s) for i, (a, s) in enumerate(found)]
        empty = np.zeros(0, np.int64)
        cols = [np.concatenate([g[i] for g in got] or [empty]) for i in range(3)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    pairs = every.groupBy("block", "group").cogroup(asks.groupBy("block", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrices(t: pa.Table):
    """(length, (ids, vectors of that length))."""
    v, ids = t["v"].combine_chunks(), t["id"].to_numpy()
    size = np.diff(v.offsets.to_numpy())
    for length in np.unique(size).tolist():
        some = pa.array(np.flatnonzero(size == length))
        yield length, (ids[some.to_numpy()], v.take(some).flatten().to_numpy().reshape(len(some), -1))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every 50th one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integers(F.col("embedding")).alias("v"))
    return top_k(rows, "vec_id", "v", F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v::DOUBLE[], e.v::DOUBLE[])::BIGINT AS score
  FROM e AS q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
