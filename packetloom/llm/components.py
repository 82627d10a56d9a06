"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edge lists of at most so many rows are joined up by one task.
LOCAL_EDGES = 200_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node reachable) of edges in memory, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: longs); label is the least node reachable.

    The distinct edges are written and counted. At most ``local_edges`` go through one task; of more,
    each round is joins and sums over the edge list, written to the shared folder, of which stars need
    O(log**2 n). Nothing is collected. No edges give no rows.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    if e.count() <= local_edges:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if got:
                node, label = labels(*(np.concatenate(x) for x in zip(*got, strict=True)))
                for i in range(0, len(node), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(label[i : i + (1 << 16)])], ["node", "label"])

        return e.coalesce(1).mapInArrow(run, "node long, label long")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.expr("sum(cast(pmod(xxhash64(u, v), 1000000007) as bigint))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        e = written(small.filter("u <> v").distinct(), "components")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
