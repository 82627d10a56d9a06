"""Historical queries, ground truth, inter-arrival times, and checks of ingested files."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hourly_volume(df: DataFrame) -> DataFrame:
    t = F.col("event_time")
    return df.groupBy(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour")).agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes")).orderBy("year", "month", "day", "hour")


def top_ports_hour(df: DataFrame, start: str, n: int = 20) -> DataFrame:
    """The ``n`` ports of most packets in the hour from ``start``; no port counts as one."""
    at = F.lit(start).cast("timestamp")
    d = df.filter((F.col("event_time") >= at) & (F.col("event_time") < at + F.expr("interval 1 hour")))
    return d.groupBy("dst_port").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes")).orderBy(F.desc("packets"), F.desc("bytes"), F.asc_nulls_first("dst_port")).limit(n)


def totals_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"))


def top_by(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return totals_by(df, key).orderBy(F.desc("packets"), F.desc("bytes"), key).limit(n)


def average_size(df: DataFrame) -> DataFrame:
    return df.groupBy("protocol").agg(F.round(F.avg("packet_length"), 6).alias("avg_packet_length"))


def traffic_trend(df: DataFrame) -> DataFrame:
    """Packets by day and the change against the day before."""
    d = df.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("packets"))
    return d.withColumn("change", F.col("packets") - F.lag("packets").over(Window.orderBy("day")))  # a row a day


def inter_arrival(df: DataFrame, by: str = "src_ip") -> DataFrame:
    """Milliseconds since the packet before, of each ``by``; null for the first."""
    w = Window.partitionBy(by).orderBy("event_time", "event_id")
    gap = (F.unix_micros("event_time") - F.unix_micros(F.lag("event_time").over(w))) / 1000.0
    return df.select("event_id", by, F.round(gap, 3).alias("iat_ms"))


def ground_truth(df: DataFrame) -> DataFrame:
    """Totals of a dataset in one row; ports are those of either side where there are two."""
    ports = F.array(*[F.col(c) for c in ("src_port", "dst_port") if c in df.columns])
    one = df.agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"), F.count_distinct("src_ip").alias("unique_src_ips"), F.count_distinct("dst_ip").alias("unique_dst_ips"),
        F.round(F.avg("packet_length"), 4).alias("packet_length_mean"), F.round(F.var_pop("packet_length"), 4).alias("packet_length_variance_population"), F.round(F.var_samp("packet_length"), 4).alias("packet_length_variance_sample"),
    )
    n = df.select(F.explode(ports).alias("p")).agg(F.count_distinct("p").alias("unique_ports"))
    return one.join(F.broadcast(n))  # one row each


def verify_lines(lines: DataFrame) -> DataFrame:
    """Of contract lines (value): records, malformed (not 11 fields, or no time), and repeats beyond each line's first."""
    parts = F.split("value", ",", -1)
    bad = (F.size(parts) != 11) | (F.trim(F.get(parts, F.lit(0))) == "")
    each = lines.withColumn("bad", bad).groupBy(F.sha2("value", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("bad").cast("long")).alias("b"))
    return each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("records"), F.coalesce(F.sum("b"), F.lit(0)).alias("malformed"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def verify_files(spark: SparkSession, path: str, now: datetime | None = None) -> DataFrame:
    """verify_lines over all files below ``path`` but hidden and temporary ones, with files, latency and freshness."""
    from ..functions.net import event_time

    raw = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("f", F.input_file_name())
    raw = raw.filter(~F.element_at(F.split("f", "/"), -1).rlike(r"^\.|\.tmp$"))
    at = F.lit(now or datetime.now(UTC)).cast("timestamp")
    stamp = event_time(F.get(F.split("value", ",", -1), F.lit(0)))
    late = F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros(stamp)) / 1000.0)
    extra = raw.agg(
        F.count_distinct("f").alias("files"), F.min(late).alias("latency_min_ms"), F.max(late).alias("latency_max_ms"), F.avg(late).alias("latency_avg_ms"),
        F.min(stamp).alias("first_event"), F.max(stamp).alias("last_event"), (F.min(late) / 1000).alias("freshness_s"),
    )
    return verify_lines(raw.select("value")).join(F.broadcast(extra))  # one row each


def compare_counts(reference: int, found: int, threshold_pct: float = 1.0) -> tuple[float, bool]:
    """(difference in percent, within the threshold); 0 of 0 passes, anything of 0 is 100 percent off."""
    diff = abs(reference - found) / reference * 100 if reference else (0.0 if not found else 100.0)
    return diff, diff <= threshold_pct


def select_hour(date: str | None = None, hour: int | None = None, now: datetime | None = None) -> tuple[str, int]:
    """A given hour, both parts or neither; without one, the last that has ended (UTC)."""
    if (date is None) != (hour is None):
        raise ValueError("give date and hour, or neither")
    if date is not None and hour is not None:
        return date, hour
    at = (now or datetime.now(UTC)) - timedelta(hours=1)
    return at.strftime("%Y-%m-%d"), at.hour


def compact_hour(spark: SparkSession, raw_root: str, out_root: str, date: str, hour: int, partitions: int = 1) -> tuple[int, int]:
    """One hour's CSV to Parquet below dt=/hr=, replacing that hour only; rows in and out, which must agree."""
    from ..sources.packets import read_packets

    df = read_packets(spark, f"{raw_root}/dt={date}/hr={hour:02d}")
    n = df.count()
    if not n:
        raise ValueError("nothing to compact")
    out = df.withColumns({"dt": F.lit(date), "hr": F.lit(f"{hour:02d}")})
    out.repartition(partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "hr").parquet(out_root)
    m = spark.read.parquet(f"{out_root}/dt={date}/hr={hour:02d}").count()
    if m != n:
        raise RuntimeError(f"{n} rows in, {m} out")
    return n, m
