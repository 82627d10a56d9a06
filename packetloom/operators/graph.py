"""The communication graph as edge and vertex tables: centrality, PageRank, Markov transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sketches import priority

WEIGHTS = ("packets", "bytes")
#: A graph of at most so many edges is iterated in one task; beyond that, each iteration is a join.
LOCAL_EDGES = 200_000
BETWEENNESS_NODES = 300


def edges_of(df: DataFrame) -> DataFrame:
    """(src, dst, packets, bytes): edges merged; blank ends go, null weights are 0. Takes packets or edge rows."""
    d = df
    if "packets" not in df.columns:
        d = df.select("src_ip", "dst_ip", F.lit(1).cast("long").alias("packets"), F.col("packet_length").cast("long").alias("bytes"))
    d = d.filter("trim(src_ip) <> '' and trim(dst_ip) <> ''")
    return d.groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in WEIGHTS])


def recent_edges(edges: DataFrame, now: Column, lookback_s: int) -> DataFrame:
    """Edge rows whose window_start (a timestamp) lies within ``lookback_s`` of ``now``, merged."""
    return edges_of(edges.filter(F.col("window_start") >= now - F.make_dt_interval(secs=F.lit(lookback_s))))


def vertices_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def _weight(name: str) -> Column:
    if name not in WEIGHTS:
        raise ValueError(f"no weight {name!r}")
    return F.col(name).cast("double")


def degrees(e: DataFrame, weight: str = "packets") -> DataFrame:
    """(id, in_w, out_w): weighted degrees; a self-loop counts on both sides."""
    w = _weight(weight)
    sides = e.select(F.col("src").alias("id"), F.lit(0.0).alias("i"), w.alias("o")).union(e.select("dst", w, F.lit(0.0)))
    return sides.groupBy("id").agg(F.sum("i").alias("in_w"), F.sum("o").alias("out_w"))


def prune(e: DataFrame, n: int = 50, weight: str = "packets") -> DataFrame:
    """Edges among the ``n`` vertices of the highest weighted degree, ties by name."""
    top = degrees(e, weight).orderBy((F.col("in_w") + F.col("out_w")).desc(), "id").limit(n).select("id")
    e = e.join(F.broadcast(top), e["src"] == top["id"], "left_semi")  # at most n rows
    return e.join(F.broadcast(top), e["dst"] == top["id"], "left_semi")


def degree_centrality(e: DataFrame, weight: str = "packets") -> DataFrame:
    """Weighted degrees over the number of other vertices; 0 in a graph of one vertex."""
    d = degrees(e, weight)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    d = d.join(F.broadcast(n))  # one row
    per = F.when(F.col("n") > 1, F.lit(1.0) / (F.col("n") - 1)).otherwise(0.0)
    return d.select("id", F.round((F.col("in_w") + F.col("out_w")) * per, 6).alias("degree"), F.round(F.col("in_w") * per, 6).alias("in_degree"), F.round(F.col("out_w") * per, 6).alias("out_degree"))


def transitions(e: DataFrame, weight: str = "packets") -> DataFrame:
    """(src, dst, p): rows of the Markov matrix with weight; a vertex of total 0 has none and counts as dangling."""
    w = _weight(weight)
    total = F.sum(w).over(Window.partitionBy("src"))
    return e.withColumn("t", total).filter("t > 0").select("src", "dst", (w / F.col("t")).alias("p")).filter("p > 0")


def markov_rows(e: DataFrame, weight: str = "packets") -> DataFrame:
    """(src, dst, p): the whole Markov matrix. A dangling vertex goes anywhere alike: its uniform row is one row, without dst, whose p is that of every vertex."""
    t, v = transitions(e, weight), vertices_of(e)
    loose = v.join(t.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return t.unionByName(loose.join(F.broadcast(n)).select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), (F.lit(1.0) / F.col("n")).alias("p")))  # one row


def next_hop(e: DataFrame, src: str, weight: str = "packets", k: int = 10) -> DataFrame:
    """The ``k`` likeliest next vertices; none for an unknown or dangling one."""
    t = transitions(e.filter(F.col("src") == src), weight)
    return t.orderBy(F.desc("p"), "dst").limit(k).select("dst", F.round("p", 6).alias("p"))


def surprise(e: DataFrame, weight: str = "packets") -> DataFrame:
    """-log2 of each transition's probability."""
    return transitions(e, weight).select("src", "dst", F.round(-F.log2("p"), 6).alias("surprise"))


#: Entries of the Markov matrix on each side of a block of its square; products that a task adds up at a time.
STEP_EDGES, STEP_PRODUCTS = 1 << 19, 1 << 22


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... of size[0] numbers, then those of lo[1], and so on."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _block_square(t: pa.Table, products: int = STEP_PRODUCTS) -> Iterator[pa.RecordBatch]:
    """(src, dst, p) of one block from its steps (side, end, via, p): side 0 goes from end to via, side 1 from via to end.

    Sources are taken a few at a time; sums are kept by place, and no product is ever a row.
    """
    via, end = (t[c].combine_chunks().dictionary_encode() for c in ("via", "end"))
    side, p = t["side"].to_numpy(), t["p"].to_numpy()
    v, e = via.indices.to_numpy(), end.indices.to_numpy()
    first, second = side == 0, side == 1
    dsts, d = np.unique(e[second], return_inverse=True)
    order = np.argsort(v[second], kind="stable")
    d, p2, v2 = d[order], p[second][order], v[second][order]
    order = np.argsort(e[first], kind="stable")
    e1, v1, p1 = e[first][order], v[first][order], p[first][order]
    lo = np.searchsorted(v2, v1)
    size = np.searchsorted(v2, v1, "right") - lo
    e1, p1, lo, size = (x[size > 0] for x in (e1, p1, lo, size))
    if not len(e1):
        return
    srcs, s = np.unique(e1, return_inverse=True)
    done = np.concatenate(([0], np.cumsum(np.bincount(s, size))))
    at = np.concatenate((np.searchsorted(s, np.arange(len(srcs))), [len(s)]))
    i = 0
    while i < len(srcs):
        most = max(1, products // len(dsts))
        k = min(max(i + 1, int(np.searchsorted(done, done[i] + products, "right")) - 1), i + most, len(srcs))
        sums = np.zeros((k - i) * len(dsts))
        a = at[i]
        while a < at[k]:  # one source may have more products than fit: its steps are added up in turn
            b = max(a + 1, min(at[k], a + int(np.searchsorted(np.cumsum(size[a : at[k]]), products, "right"))))
            n = size[a:b]
            j = _ranges(lo[a:b], n)
            sums += np.bincount(np.repeat((s[a:b] - i) * len(dsts), n) + d[j], np.repeat(p1[a:b], n) * p2[j], len(sums))
            a = b
        hit = np.flatnonzero(sums)
        for c in range(0, len(hit), 1 << 16):
            x, y = np.divmod(hit[c : c + (1 << 16)], len(dsts))
            names = [end.dictionary.take(pa.array(q)) for q in (srcs[i + x], dsts[y])]
            yield pa.RecordBatch.from_arrays([*names, pa.array(sums[hit[c : c + (1 << 16)]])], ["src", "dst", "p"])
        i = k


def two_step(e: DataFrame, weight: str = "packets", block: int = STEP_EDGES) -> DataFrame:
    """Probabilities of two steps: the sparse matrix times itself.

    First steps are dealt by source, second steps by destination, over blocks of about ``block`` steps; each pair of
    blocks is one group, which makes all products of its sources and destinations and adds them up in place. Products
    are many more than steps or results and are never shuffled; a step moves once for each block of the other side.
    """
    t = transitions(e, weight)
    n = max(1, -(-t.count() // block))
    blocks = F.array(*map(F.lit, range(n)))

    def side(k: int, end: str, via: str) -> DataFrame:
        own, other = F.pmod(F.xxhash64(end), F.lit(n)).cast("int"), F.explode(blocks)
        d = t.select(F.lit(k).alias("side"), F.col(end).alias("end"), F.col(via).alias("via"), "p", own.alias("own"), other.alias("other"))
        return d.select(F.col("own" if k == 0 else "other").alias("i"), F.col("other" if k == 0 else "own").alias("j"), "side", "end", "via", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _block_square(pa.Table.from_batches(list(batches)))

    both = side(0, "src", "dst").unionByName(side(1, "dst", "src"))
    return both.groupBy("i", "j").applyInArrow(run, "src string, dst string, p double").select("src", "dst", F.round("p", 6).alias("p"))


def heatmap(e: DataFrame, k: int = 20, weight: str = "packets") -> DataFrame:
    """Transitions among the ``k`` vertices of highest degree, as shares of all that leaves a vertex; those with nothing there are uniform over the k."""
    top = degrees(e, weight).orderBy((F.col("in_w") + F.col("out_w")).desc(), "id").limit(k).select("id")
    t = transitions(e, weight)
    n = top.agg(F.count(F.lit(1)).alias("n"))
    cells = top.select(F.col("id").alias("src")).join(F.broadcast(top.select(F.col("id").alias("dst")))).join(F.broadcast(n))  # k * k cells
    inside = t.join(F.broadcast(top), t["src"] == top["id"], "left_semi").join(F.broadcast(top), t["dst"] == top["id"], "left_semi")
    cells = cells.join(F.broadcast(inside), ["src", "dst"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    sums = F.sum("p").over(Window.partitionBy("src"))
    p = F.when(F.col("n") < 2, 0.0).when(sums == 0, F.lit(1.0) / F.col("n")).otherwise(F.col("p"))
    return cells.select("src", "dst", F.round(p, 6).alias("p"))


# ------------------------------------------------------------------ iteration
def _power(src: np.ndarray, dst: np.ndarray, p: np.ndarray, n: int, alpha: float, teleport: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int, bool]:
    dangling = np.ones(n, bool)
    dangling[src] = False
    x = np.full(n, 1.0 / n)
    for i in range(1, max_iter + 1):
        flow = np.bincount(dst, x[src] * p, n) + x[dangling].sum() / n
        new = alpha * flow + (1 - alpha) * teleport
        if np.abs(new - x).sum() < tol:
            return new, i, True
        x = new
    return x, max_iter, False


def pagerank(e: DataFrame, alpha: float = 0.85, weight: str = "packets", max_iter: int = 100, tol: float = 1e-6, personal: dict[str, float] | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, rank) by power iteration from the uniform vector; dangling vertices go anywhere, teleports by ``personal``.

    The edge list is counted first: at most ``local_edges`` are iterated by one task, more by joins
    whose state is checkpointed, so that no list of vertices is ever on the driver.
    """
    e = e.select("src", "dst", *WEIGHTS)
    if e.limit(local_edges + 1).count() <= local_edges:
        return _local(e, alpha, weight, max_iter, tol, personal)
    return _joined(e, alpha, weight, max_iter, tol, personal)[0]


def _local(e: DataFrame, alpha: float, weight: str, max_iter: int, tol: float, personal: dict[str, float] | None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["src"], pdf["dst"])))
        s, d = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        w = pdf[weight].to_numpy(float)
        total = np.bincount(s, w, len(ids))
        use = (total[s] > 0) & (w > 0)
        teleport = np.array([(personal or {}).get(i, 0.0) for i in ids])
        teleport = teleport / teleport.sum() if teleport.sum() > 0 else np.full(len(ids), 1.0 / len(ids))
        x, _, _ = _power(s[use], d[use], w[use] / total[s[use]], len(ids), alpha, teleport, max_iter, tol)
        return pd.DataFrame({"id": ids, "rank": x})

    _weight(weight)
    return e.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "id string, rank double")


def _joined(e: DataFrame, alpha: float, weight: str, max_iter: int, tol: float, personal: dict[str, float] | None) -> tuple[DataFrame, bool]:
    """(ranks, whether they converged); the mass of dangling vertices is one sum, spread evenly."""
    spark = e.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    t = transitions(e, weight).checkpoint()
    v = vertices_of(e).join(t.select(F.col("src").alias("id")).distinct().withColumn("flows", F.lit(True)), "id", "left").checkpoint()
    n = v.count()
    wanted = F.lit(0.0)
    if not n:
        wanted = F.lit(0.0)
    elif personal and (total := sum(personal.values())) > 0:
        for name, x in personal.items():
            wanted = F.when(F.col("id") == name, x / total).otherwise(wanted)
    else:
        wanted = F.lit(1.0 / n)
    x, settled = v.withColumn("rank", F.lit(1.0 / max(n, 1))), False
    for _ in range(max_iter if n else 0):
        loose = x.filter("flows is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = t.join(x.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("flow"))
        new = x.join(flow, "id", "left").withColumn("new", F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + loose / n) + F.lit(1 - alpha) * wanted)
        new = new.select("id", "flows", "rank", "new").checkpoint()
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0]
        x = new.select("id", "flows", F.col("new").alias("rank"))
        if settled := moved < tol:
            break
    return x.select("id", "rank"), settled


def stationary(e: DataFrame, weight: str = "packets", max_iter: int = 1000, tol: float = 1e-8, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, rank) without teleports; no rows where the iteration does not converge, at every size. Over ``local_edges`` it goes on by joins."""
    e = e.select("src", "dst", *WEIGHTS)
    if e.limit(local_edges + 1).count() > local_edges:
        x, settled = _joined(e, 1.0, weight, max_iter, tol, None)
        return x if settled else x.limit(0)
    _weight(weight)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["src"], pdf["dst"])))
        s, d = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        w = pdf[weight].to_numpy(float)
        total = np.bincount(s, w, len(ids))
        use = (total[s] > 0) & (w > 0)
        x, _, ok = _power(s[use], d[use], w[use] / total[s[use]], len(ids), 1.0, np.zeros(len(ids)), max_iter, tol)
        return pd.DataFrame({"id": ids, "rank": x}) if ok else pd.DataFrame({"id": pd.Series([], dtype=str), "rank": pd.Series([], dtype=float)})

    return e.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "id string, rank double")


def sources_of(v: DataFrame, k: int | None, seed: int = 42) -> DataFrame:
    """All vertices, or the ``k`` of least priority: the same sample in any engine and order."""
    return v if k is None else v.orderBy(priority(F.col("id"), seed), "id").limit(k)


def betweenness_by_joins(e: DataFrame, weight: str = "packets", k: int | None = None, normalised: bool = True, seed: int = 42) -> DataFrame:
    """``betweenness`` of a graph of any size: all sources at once, by joins of their frontiers with the edges.

    Distances first: a frontier holds the vertices that came nearer in the last round. Numbers of shortest paths then follow
    the edges on such paths outward, dependencies follow them back; both need as many rounds as a path has edges. State
    is (source, vertex) rows, ``k`` times the vertices at most, and each round of it is checkpointed; no edge list is collected.
    """
    spark = e.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    v = vertices_of(e).checkpoint()
    n = v.count()
    if n < 3:
        return v.select("id", F.lit(0.0).alias("betweenness"))
    length = F.lit(1.0) / F.greatest(F.coalesce(_weight(weight), F.lit(0.0)), F.lit(1.0))
    step = e.filter("src <> dst").groupBy("src", "dst").agg(F.min(length).alias("far")).checkpoint()
    begin = sources_of(v, k, seed).select(F.col("id").alias("s"), "id", F.lit(0.0).alias("d")).checkpoint()
    state = front = begin
    near = F.lit(1e-12)
    while front.take(1):
        came = front.join(step, front["id"] == step["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("far")).alias("new"))
        state = state.join(came, ["s", "id"], "full").withColumn("nearer", F.coalesce(F.col("new") < F.col("d") - near, F.col("d").isNull()))
        state = state.select("s", "id", F.when(F.col("nearer"), F.col("new")).otherwise(F.col("d")).alias("d"), "nearer").checkpoint()
        front = state.filter("nearer").select("s", "id", "d")
        state = state.select("s", "id", "d")
    a, b = state.select("s", F.col("id").alias("u"), F.col("d").alias("du")), state.select("s", "id", F.col("d").alias("dv"))
    on = a.join(step, a["u"] == step["src"]).select("s", "u", F.col("dst").alias("id"), (F.col("du") + F.col("far")).alias("dv_u")).join(b, ["s", "id"])
    on = on.filter((F.abs(F.col("dv_u") - F.col("dv")) <= near) & (F.col("id") != F.col("s"))).select("s", "u", "id").checkpoint()

    def settled(start: DataFrame, round_: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(s, id, x) after rounds until none changes a value; values follow acyclic edges, so that happens."""
        x = start
        while True:
            new = x.join(round_(x), ["s", "id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)) + F.col("own")).checkpoint()
            moved = new.filter("x <> y").take(1)
            x = new.select("s", "id", "own", F.col("y").alias("x"))
            if not moved:
                return x.select("s", "id", "x")

    one = F.when(F.col("s") == F.col("id"), 1.0).otherwise(0.0)
    paths = settled(state.select("s", "id", one.alias("own"), one.alias("x")), lambda x: on.join(x.select("s", F.col("id").alias("u"), "x"), ["s", "u"]).groupBy("s", "id").agg(F.sum("x").alias("y"))).checkpoint()
    share = on.join(paths.withColumnRenamed("x", "to"), ["s", "id"]).join(paths.select("s", F.col("id").alias("u"), F.col("x").alias("at")), ["s", "u"])
    share = share.select("s", "u", "id", (F.col("at") / F.col("to")).alias("share")).checkpoint()
    rest = settled(
        state.select("s", "id", F.lit(0.0).alias("own"), F.lit(0.0).alias("x")),
        lambda x: share.join(x, ["s", "id"]).groupBy("s", F.col("u").alias("id")).agg(F.sum(F.col("share") * (1 + F.col("x"))).alias("y")),
    )
    scale = (1.0 / ((n - 1) * (n - 2)) if normalised else 1.0) * (n / min(k, n) if k is not None else 1.0)
    sums = rest.filter("s <> id").groupBy("id").agg((F.sum("x") * scale).alias("x"))
    return v.join(sums, "id", "left").select("id", F.round(F.coalesce("x", F.lit(0.0)), 9).alias("betweenness"))


def betweenness(e: DataFrame, weight: str = "packets", normalised: bool = True, most: int = BETWEENNESS_NODES, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, betweenness) by weighted shortest paths, an edge as long as 1 / max(weight, 1); zeros above ``most`` vertices.

    With ``k`` paths from a sample of so many sources, scaled up. See ``betweenness_by_joins`` for larger graphs. Each source vertex is a group of its own, so sources run in parallel over a graph whose size was checked.
    """
    _weight(weight)
    v = vertices_of(e)
    n = v.limit(most + 1).count()
    if n > most or n < 3:
        return v.select("id", F.lit(0.0).alias("betweenness"))
    rows = e.select("src", "dst", weight).collect()  # at most most**2 edges, checked above
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {x: i for i, x in enumerate(names)}
    near: list[list[tuple[int, float]]] = [[] for _ in names]
    for s, d, w in rows:
        if s != d:
            near[at[s]].append((at[d], 1.0 / max(float(w or 0), 1.0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["id"]:
                yield pd.DataFrame({"id": names, "d": _dependencies(at[name], near)})

    scale = (1.0 / ((n - 1) * (n - 2)) if normalised else 1.0) * (n / min(k, n) if k is not None else 1.0)
    return sources_of(v, k, seed).mapInPandas(run, "id string, d double").groupBy("id").agg(F.round(F.sum("d") * scale, 9).alias("betweenness"))


def _dependencies(s: int, near: list[list[tuple[int, float]]]) -> np.ndarray:
    """How much each vertex lies on shortest paths from ``s``: one pass outward by distance, one back."""
    import heapq

    n = len(near)
    dist, paths = [float("inf")] * n, [0.0] * n
    before: list[list[int]] = [[] for _ in range(n)]
    dist[s], paths[s] = 0.0, 1.0
    heap, done, order = [(0.0, s)], [False] * n, []
    while heap:
        d, x = heapq.heappop(heap)
        if done[x]:
            continue
        done[x] = True
        order.append(x)
        for y, length in near[x]:
            new = d + length
            if new < dist[y] - 1e-12:
                dist[y], paths[y], before[y] = new, paths[x], [x]
                heapq.heappush(heap, (new, y))
            elif abs(new - dist[y]) <= 1e-12 and not done[y]:
                paths[y] += paths[x]
                before[y].append(x)
    out = np.zeros(n)
    for y in reversed(order):
        for x in before[y]:
            out[x] += paths[x] / paths[y] * (1 + out[y])
    out[s] = 0.0
    return out


def summary(e: DataFrame, weight: str = "packets") -> DataFrame:
    return degree_centrality(e, weight).join(betweenness(e, weight), "id", "left")


def render_weights(e: DataFrame) -> DataFrame:
    """Edges with packets as a share of the largest."""
    top = e.agg(F.max("packets").alias("most"))
    return e.join(F.broadcast(top)).select("src", "dst", "packets", F.round(F.col("packets") / F.col("most"), 6).alias("share"))  # one row


def analyse(e: DataFrame, n: int = 30, weight: str = "packets") -> DataFrame:
    """(id, rank, degree, in_degree, out_degree, betweenness) of the ``n`` vertices of highest degree and the edges among them."""
    small = prune(e, n, weight)
    return pagerank(small, weight=weight).join(summary(small, weight), "id", "left")
