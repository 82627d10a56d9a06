"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 8192
QUERY_BLOCK = 2048
FIRST_DEPTH, DEEPER = 16, 4
#: Sums of products are exact in doubles below this; a query that may reach it is scored in integers of any size.
EXACT = 2.0**53
LONG = (1 << 63) - 1


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component; vectors that are null or hold null or non-finite values go.

    Doubles from 2**53 up are whole already, and too large for the integers that floor() makes.
    """
    e = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), F.transform(embeddings["embedding"], lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    e = e.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    return e.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, shorter ones padded with 0."""
    flat, off = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    size = np.diff(off)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[-k]
        hit = scores >= floor
        ids, scores = ids[hit], scores[hit]
    o = np.lexsort((ids, -scores))[:k]
    return ids[o], scores[o]


def best_exact(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over all of ``v`` in integers of any size; a score beyond 64 bits counts as the end of their range."""
    whole = [int(x) for x in q]
    scores = [max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(row, whole, strict=True)))) for row in v]
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[order], np.array([scores[i] for i in order], np.int64)


class Lists:
    """A block of vectors as one ascending list a dimension."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.v, self.rows = ids, np.ascontiguousarray(v), ids if rows is None else rows
        self.most = float(np.abs(v).max()) if v.size else 0.0
        self.order = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(v.T, self.order, axis=1))

    def top(self, query_row: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Fagin's threshold algorithm: read each list from its better end, score what appears in full, and stop
        when the score of a vector with the values at all the cursors cannot reach the kth. Also the depth read.
        The row ``query_row`` itself is left out."""
        n = len(self.ids)
        if self.most * float(np.abs(q).sum()) >= EXACT:
            own = self.rows != query_row
            return *best_exact(self.ids[own], self.v[own], q, k), n
        use = np.flatnonzero(q)
        up = q[use] > 0
        seen = np.zeros(n, bool)
        got_i, got_s = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, FIRST_DEPTH
        while at < n:
            to = min(n, at + step)
            if len(use) and to < n:
                mark = np.zeros(n, bool)
                mark[self.order[use[~up], at:to].ravel()] = True
                mark[self.order[use[up], n - to : n - at].ravel()] = True
                new = np.flatnonzero(mark & ~seen)
            else:
                to, new = n, np.flatnonzero(~seen)
            seen[new] = True
            scores = self.v[new] @ q
            own = self.rows[new] != query_row
            got_i, got_s = best(np.concatenate((got_i, self.ids[new][own])), np.concatenate((got_s, scores[own])), k)
            if to < n:
                edge = np.where(up, self.sorted[use, n - 1 - to], self.sorted[use, to])
                if len(got_s) >= k and float(edge @ q[use]) < got_s[-1]:
                    return got_i, got_s, to
            at, step = to, step * DEEPER
        return got_i, got_s, n


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): for each row whose vec_id is divisible by ``every`` the k best others.

    Blocks of about 8192 vectors are sorted by dimension; each block of queries meets each block of
    vectors once, and a query takes k rows from each, so what is gathered a query is k times the
    number of blocks. Every row counts: a repeated row is a candidate for itself and for others, and a
    vec_id that several rows have gives each of them its k results, told apart by query_row. Shorter
    vectors count as 0 in the dimensions they lack. Fewer than k others give fewer rows; no vectors give
    none. Scores from 2**53 up are reckoned in integers; beyond 64 bits they count as the end of the range.
    """
    v = written(quantised(embeddings, scale).withColumn("row", F.monotonically_increasing_id()), "topk_vectors")
    n, width = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, width = n or 0, width or 0
    blocks = max(1, -(-n // BLOCK))
    q = v.filter(F.pmod("vec_id", F.lit(every)) == 0)
    q_blocks = max(1, -(-n // (every * QUERY_BLOCK)))
    base = v.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    cell = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    base = base.withColumn("part", cell)
    q = q.withColumn("part", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(q_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            lists = Lists(left["vec_id"].to_numpy(), matrix(left["v"].combine_chunks(), width), left["row"].to_numpy())
            queries = matrix(right["v"].combine_chunks(), width)
            for i, r, x in zip(right["vec_id"].to_pylist(), right["row"].to_pylist(), queries, strict=True):
                ids, scores, _ = lists.top(r, x, k)
                out.append((np.full(len(ids), i), np.full(len(ids), r), ids, scores.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"query_id": cols[0], "query_row": cols[1], "vec_id": cols[2], "score": cols[3]})

    keys = ["block", "part"]
    found = base.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, "query_id long, query_row long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")


ORACLE = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
