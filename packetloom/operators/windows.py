"""Event-time window aggregates, the same plan in batch and stream, and rankings over their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import DEFAULT_FILTERS, FilterSpec


def windowed(df: DataFrame, length_s: int, watermark_s: int = 30, slide_s: int | None = None) -> tuple[DataFrame, Column]:
    """(``df`` with a watermark where it is a stream, the window column)."""
    df = df.withWatermark("event_time", f"{watermark_s} seconds") if df.isStreaming else df
    return df, F.window("event_time", f"{length_s} seconds", f"{slide_s} seconds" if slide_s else None).alias("w")


def _out(df: DataFrame, length_s: int, *cols: Column | str) -> DataFrame:
    return df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.lit(length_s).alias("window_len_s"), *cols)


def _packets() -> list[Column]:
    return [F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.col("packet_length").cast("long")), F.lit(0)).alias("bytes")]


def window_metrics(df: DataFrame, length_s: int = 10, watermark_s: int = 30, slide_s: int | None = None) -> DataFrame:
    """packets, bytes, and both per second."""
    df, w = windowed(df, length_s, watermark_s, slide_s)
    return _out(df.groupBy(w).agg(*_packets()), length_s, "packets", "bytes", F.round(F.col("packets") / length_s, 6).alias("pps"), F.round(F.col("bytes") / length_s, 6).alias("bps"))


def multi_window(df: DataFrame, lengths_s: Sequence[int] = (10, 30, 60), watermark_s: int = 30) -> DataFrame:
    """window_metrics of several lengths from one scan and one aggregation: rows are dealt to a window of each length."""
    df = df.withWatermark("event_time", f"{watermark_s} seconds") if df.isStreaming else df
    each = df.withColumn("window_len_s", F.explode(F.array(*map(F.lit, lengths_s))))
    start = F.timestamp_seconds(F.floor(F.unix_seconds("event_time") / F.col("window_len_s")) * F.col("window_len_s"))
    agg = each.groupBy(start.alias("start"), "window_len_s").agg(*_packets())
    return agg.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "window_len_s", "packets", "bytes")


def protocol_counts(df: DataFrame, length_s: int = 10, watermark_s: int = 30) -> DataFrame:
    df, w = windowed(df, length_s, watermark_s)
    return _out(df.groupBy(w, "protocol").agg(*_packets()), length_s, "protocol", "packets", "bytes")


def port_counts(df: DataFrame, length_s: int = 10, watermark_s: int = 30) -> DataFrame:
    df, w = windowed(df.filter("dst_port is not null"), length_s, watermark_s)
    return _out(df.groupBy(w, "dst_port").agg(*_packets()), length_s, F.col("dst_port").alias("port"), "packets", "bytes")


def filter_counts(df: DataFrame, filters: Sequence[FilterSpec] = DEFAULT_FILTERS, length_s: int = 10, watermark_s: int = 30) -> DataFrame:
    """packets and bytes by filter and window in one scan; filters without a hit have 0."""
    if not filters:
        raise ValueError("no filters")
    df, w = windowed(df, length_s, watermark_s)
    hits = [F.coalesce(F.expr(f.expr), F.lit(False)) for f in filters]
    aggs = [a for i, h in enumerate(hits) for a in (F.count_if(h).alias(f"p{i}"), F.coalesce(F.sum(F.when(h, F.col("packet_length").cast("long"))), F.lit(0)).alias(f"b{i}"))]
    rows = F.array(*[F.struct(F.lit(f.name).alias("filter_name"), F.col(f"p{i}").alias("packets"), F.col(f"b{i}").alias("bytes")) for i, f in enumerate(filters)])
    made = df.groupBy(w).agg(*aggs).select("w", F.explode(rows).alias("r"))
    return _out(made, length_s, "r.filter_name", "r.packets", "r.bytes")


def distinct_counts(df: DataFrame, length_s: int = 10, watermark_s: int = 30, rsd: float = 0.05) -> DataFrame:
    """Sources, destinations and ports by window: exact, and by HyperLogLog. A stream keeps sets; a batch counts distinct rows."""
    stream = df.isStreaming
    df, w = windowed(df, length_s, watermark_s)
    cols = {"src_ips": "src_ip", "dst_ips": "dst_ip", "ports": "dst_port"}
    exact = [(F.size(F.collect_set(c)).cast("long") if stream else F.count_distinct(F.col(c))).alias(f"{n}_exact") for n, c in cols.items()]
    hll = [F.approx_count_distinct(c, rsd).alias(f"{n}_hll") for n, c in cols.items()]
    return _out(df.groupBy(w).agg(*exact, *hll), length_s, *[f"{n}_{k}" for k in ("exact", "hll") for n in cols])


SKETCHED = {"src_ips": "src_ip", "dst_ips": "dst_ip", "ports": "dst_port"}


def distinct_sketches(df: DataFrame, length_s: int = 10, watermark_s: int = 30, bits: int = 12) -> DataFrame:
    """Sources, destinations and ports by window as HLL sketches of 2**``bits`` registers: small, and to be stored and merged. The same in batch and stream."""
    df, w = windowed(df, length_s, watermark_s)
    return _out(df.groupBy(w).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(n) for n, c in SKETCHED.items()]), length_s, *SKETCHED)


def distinct_rollup(stored: DataFrame, length_s: int) -> DataFrame:
    """Distinct counts of longer windows from stored sketches of shorter ones; packets are not read again. ``length_s`` is a multiple of theirs."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.to_timestamp("window_start")) / length_s) * length_s)
    merged = stored.groupBy(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start")).agg(*[F.hll_union_agg(n).alias(n) for n in SKETCHED])
    return merged.select("window_start", F.lit(length_s).alias("window_len_s"), *[F.hll_sketch_estimate(n).alias(n) for n in SKETCHED])


def distinct_items(df: DataFrame, length_s: int = 10) -> DataFrame:
    """(window_start, window_len_s, name, item): each source, destination and port once a window, to be stored beside the sketches where counts of longer windows have to be exact."""
    df, w = windowed(df, length_s)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("item")) for n, c in SKETCHED.items()])).alias("x")
    # A window all of whose items are null has rows of null, so that it is counted as 0 and not lost.
    return _out(df.select(w, each).select("w", "x.*").distinct(), length_s, "name", "item")


def exact_rollup(stored: DataFrame, length_s: int) -> DataFrame:
    """As ``distinct_rollup``, exactly, from stored ``distinct_items``. Items are dealt by value, and no window is gathered."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.to_timestamp("window_start")) / length_s) * length_s)
    once = stored.select(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"), "name", "item").distinct()
    return once.groupBy("window_start").agg(*[F.count(F.when(F.col("name") == n, F.col("item"))).alias(n) for n in SKETCHED]).select("window_start", F.lit(length_s).alias("window_len_s"), *SKETCHED)


def moments(df: DataFrame, length_s: int = 10, watermark_s: int = 30) -> DataFrame:
    """Mean, sample variance and deviation of length and inter-arrival time; null for a single value."""
    df, w = windowed(df, length_s, watermark_s)
    stats = [F.round(f(c), 6).alias(f"{k}_{n}") for n, c in (("len", "packet_length"), ("iat", "iat_ms")) for k, f in (("mean", F.avg), ("var", F.var_samp), ("std", F.stddev_samp))]
    return _out(df.groupBy(w).agg(F.count(F.lit(1)).alias("n"), *stats), length_s, "n", "mean_len", "var_len", "std_len", "mean_iat", "var_iat", "std_iat")


def ip_edges(df: DataFrame, length_s: int = 10, watermark_s: int = 30) -> DataFrame:
    df, w = windowed(df, length_s, watermark_s)
    return _out(df.groupBy(w, "src_ip", "dst_ip").agg(*_packets()), length_s, "src_ip", "dst_ip", "packets", "bytes")


def source_stats(df: DataFrame, length_s: int = 10, watermark_s: int = 30) -> DataFrame:
    """packets, bytes, distinct destinations and ports by source."""
    stream = df.isStreaming
    df, w = windowed(df, length_s, watermark_s)
    distinct = [(F.size(F.collect_set(c)).cast("long") if stream else F.count_distinct(F.col(c))).alias(n) for n, c in (("unique_dst_ips", "dst_ip"), ("unique_dst_ports", "dst_port"))]
    return _out(df.groupBy(w, "src_ip").agg(*_packets(), *distinct), length_s, "src_ip", "packets", "bytes", "unique_dst_ips", "unique_dst_ports")


def session_metrics(df: DataFrame, gap_s: int = 60, watermark_s: int = 30) -> DataFrame:
    """Bursts of one source: packets with less than ``gap_s`` between them."""
    df = df.withWatermark("event_time", f"{watermark_s} seconds") if df.isStreaming else df
    agg = df.groupBy(F.session_window("event_time", f"{gap_s} seconds").alias("w"), "src_ip").agg(*_packets())
    return agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "src_ip", "packets", "bytes")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``by`` in ``order``, which should be total; ranks partially before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_ports(counts: DataFrame, n: int = 10) -> DataFrame:
    return ranked(counts, ["window_start", "window_len_s"], [F.desc("packets"), F.desc("bytes"), F.asc("port")], n)


def top_edges(edges: DataFrame, n: int = 500) -> DataFrame:
    return ranked(edges, ["window_start", "window_len_s"], [F.desc("bytes"), F.desc("packets"), F.asc("src_ip"), F.asc("dst_ip")], n)


def shared_scan(df: DataFrame, length_s: int = 10, filters: Sequence[FilterSpec] = DEFAULT_FILTERS, watermark_s: int = 30) -> DataFrame:
    """All per-window results in one aggregation, for one scan and one state: metrics, distinct counts, moments, filters."""
    df, w = windowed(df, length_s, watermark_s)
    aggs = [*_packets(), *[F.approx_count_distinct(c, 0.05).alias(f"{c}_hll") for c in ("src_ip", "dst_ip", "dst_port")], F.avg("packet_length").alias("mean_len"), F.var_samp("packet_length").alias("var_len")]
    aggs += [F.count_if(F.coalesce(F.expr(f.expr), F.lit(False))).alias(f"filter_{f.name}") for f in filters]
    made = df.groupBy(w).agg(*aggs)
    return _out(made, length_s, *[c for c in made.columns if c != "w"])
