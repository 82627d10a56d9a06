"""Reading packets: contract CSV in batch and stream, raw capture lines, generated traffic, test-table adapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net
from ..schema import COLUMNS, PACKET_SCHEMA, RAW_FIELDS

CORRUPT = "_corrupt"


def _schema() -> T.StructType:
    return T.StructType([*PACKET_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Headerless contract CSV, nested folders too; a line that does not fit keeps its text in ``_corrupt``."""
    return spark.read.schema(_schema()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true").csv(path)


def stream_packets(spark: SparkSession, path: str, max_files: int = 100, archive: str | None = None) -> DataFrame:
    """The same as a stream of files as they arrive; with ``archive``, files that are done move there."""
    r = spark.readStream.schema(_schema()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else r
    return r.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").csv(path)


def parse_line(line: Column) -> list[Column]:
    """A contract line's fields by position, empty ones null; commas inside fields do not exist."""
    parts = F.split(line, ",", -1)
    return [F.nullif(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(COLUMNS)]


def format_line(df: DataFrame) -> DataFrame:
    """Contract lines of a DataFrame of packets, nulls as empty fields."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS]).alias("value"))


def parse_raw(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Raw capture lines (value) to contract columns with reject_reason, null where the line is a packet.

    Rules apply in order: number of fields, no address, bad address, time, length, protocol number,
    port, inter-arrival time, MAC addresses and flags. IPv4 goes before IPv6; ports belong to TCP and UDP; milliseconds are cut.
    """
    parts = F.split("value", sep, -1)
    f = {n: F.trim(F.get(parts, i)) for i, n in enumerate(RAW_FIELDS)}
    lines = lines.select("value", F.size(parts).alias("n"), *[F.nullif(v, F.lit("")).alias(n) for n, v in f.items()])
    number = F.coalesce("ip_proto", "ipv6_nxt")
    src, dst = F.coalesce("ip_src", "ipv6_src"), F.coalesce("ip_dst", "ipv6_dst")
    protocol = F.when(number == "6", "TCP").when(number == "17", "UDP").when(number.isin("1", "58"), "ICMP").otherwise("OTHER")
    sport = F.when(protocol == "TCP", F.col("tcp_srcport")).when(protocol == "UDP", F.col("udp_srcport"))
    dport = F.when(protocol == "TCP", F.col("tcp_dstport")).when(protocol == "UDP", F.col("udp_dstport"))
    epoch, length, delta = F.col("frame_time_epoch").try_cast("decimal(20,9)"), F.col("frame_len").try_cast("int"), F.col("frame_time_delta").try_cast("double")

    def bad_port(p: Column) -> Column:
        return p.isNotNull() & ~F.coalesce(p.try_cast("int").between(0, 65535), F.lit(False))

    reason = F.coalesce(
        F.when(F.col("n") != len(RAW_FIELDS), "WRONG_COLUMNS"),
        F.when(src.isNull() | dst.isNull(), "NON_IP"),
        F.when(~net.is_ip(src) | ~net.is_ip(dst), "BAD_IP"),
        F.when(epoch.isNull() | (epoch < 0), "BAD_TIMESTAMP"),
        F.when(~F.coalesce(length.between(1, 65535), F.lit(False)), "BAD_LENGTH"),
        F.when(number.isNotNull() & number.try_cast("int").isNull(), "VALIDATION"),
        F.when(bad_port(sport) | bad_port(dport), "BAD_PORT"),
        F.when(F.col("frame_time_delta").isNotNull() & ~F.coalesce(delta >= 0, F.lit(False)), "VALIDATION"),
        F.when(~F.lower("eth_src").rlike(net.MAC) | ~F.lower("eth_dst").rlike(net.MAC) | ~F.col("tcp_flags").rlike(net.FLAGS), "VALIDATION"),
    )
    stamp = F.date_format(F.timestamp_millis(F.floor(epoch * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")
    return lines.select(
        stamp.alias("timestamp"), src.alias("src_ip"), dst.alias("dst_ip"), sport.try_cast("int").alias("src_port"), dport.try_cast("int").alias("dst_port"),
        protocol.alias("protocol"), length.alias("packet_length"), F.lower("eth_src").alias("src_mac"), F.lower("eth_dst").alias("dst_mac"), "tcp_flags",
        (delta * 1000).alias("iat_ms"), reason.alias("reject_reason"), F.col("value").alias("raw_line"),
    )


def parse_raw_strict(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """parse_raw that fails with the reason at the first line it rejects."""
    d = parse_raw(lines, sep)
    ok = F.when(F.col("reject_reason").isNull(), F.col("timestamp")).otherwise(F.raise_error(F.col("reject_reason")))
    return d.withColumn("timestamp", ok).drop("reject_reason", "raw_line")


#: Names of scenarios. Shares of TCP, UDP and ICMP, packet length range, and numbers of sources and destinations of generated traffic.
SCENARIOS = {
    "normal": (0.8, 0.15, 60, 1500, 9, 10),
    "spike": (0.8, 0.15, 60, 1500, 9, 10),
    "portscan_like": (1.0, 0.0, 60, 60, 1, 1),
    "fanout": (1.0, 0.0, 64, 64, 1, 99),
    "dns_heavy": (0.1, 0.85, 60, 300, 9, 10),
    "multi_host_graph": (0.75, 0.25, 60, 1500, 4, 4),
}


def generate(spark: SparkSession, scenario: str = "normal", duration_s: int = 60, rate_pps: float = 20, seed: int = 42, base_epoch: float = 1758412800.0) -> DataFrame:
    """Synthetic packets of one scenario: seeded exponential gaps within each second, so seconds are made in parallel.

    A spike has four times the rate in the last third.
    """
    tcp, udp, low, high, sources, targets = SCENARIOS[scenario]
    rate = F.when(F.col("second") >= 2 * duration_s / 3, rate_pps * 4).otherwise(rate_pps) if scenario == "spike" else F.lit(float(rate_pps))
    s = spark.range(duration_s).withColumnRenamed("id", "second").select("second", F.explode(F.sequence(F.lit(1), F.ceil(rate).cast("int"))).alias("i"))

    def draw(what: str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "second", "i"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))

    gap = -F.log(draw("gap"))
    run = Window.partitionBy("second").orderBy("i")
    s = s.withColumn("gap", gap).withColumn("at", F.sum("gap").over(run)).withColumn("all", F.sum("gap").over(Window.partitionBy("second")))
    stamp = F.timestamp_millis(((F.lit(base_epoch) + F.col("second") + F.col("at") / (F.col("all") + 1e-3)) * 1000).cast("long"))
    protocol = F.when(draw("proto") < tcp, "TCP").when(draw("proto") < tcp + udp, "UDP").otherwise("ICMP")
    port = F.when(protocol != "ICMP", F.when(F.lit(scenario == "portscan_like"), F.floor(draw("port") * 65535)).otherwise(F.element_at(F.array(*map(F.lit, (53, 80, 443, 8443))), (F.floor(draw("port") * 4) + 1).cast("int"))))
    return s.select(
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), F.concat(F.lit("192.168.1."), (F.floor(draw("src") * sources) + 10).cast("string")).alias("src_ip"),
        F.concat(F.lit("203.0.113."), (F.floor(draw("dst") * targets) + 1).cast("string")).alias("dst_ip"), F.when(protocol != "ICMP", F.floor(draw("sport") * 16383) + 49152).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"), protocol.alias("protocol"), (F.floor(draw("len") * (high - low + 1)) + low).cast("int").alias("packet_length"),
        F.lit(None).cast("string").alias("src_mac"), F.lit(None).cast("string").alias("dst_mac"), F.when(protocol == "TCP", "0x0010").alias("tcp_flags"),
        F.round(F.lit(1000.0) * (F.col("gap") / (F.col("all") + 1e-3)), 3).alias("iat_ms"),
    )


def restamp(df: DataFrame, start_epoch: float, speed: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Replay: gaps between successive packets divided by ``speed`` and added up from ``start_epoch``; iat_ms anew, 0 first.

    ``by`` names columns whose values are replayed apart and in parallel; without it there is one sequence.
    """
    stamp = F.unix_millis(net.event_time(F.col("timestamp")))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__at", "src_ip", "dst_ip")
    df = df.withColumn("__at", stamp).withColumn("__gap", F.coalesce((F.col("__at") - F.lag("__at").over(w)) / F.lit(speed), F.lit(0.0)))
    at = F.lit(start_epoch * 1000) + F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"timestamp": F.date_format(F.timestamp_millis(at.cast("long")), "yyyy-MM-dd HH:mm:ss.SSS"), "iat_ms": F.round("__gap", 3)}).drop("__at", "__gap")


def packets_of(e: DataFrame) -> DataFrame:
    """``events`` rows, of a batch or a stream, as packets with event_time and event_id."""
    kind, user = F.col("event_type"), F.col("user_id")
    protocol = F.when(kind == "signup", "UDP").when(kind == "error", "ICMP").otherwise("TCP")
    port = F.when(kind == "click", 443).when(kind == "view", 80).when(kind == "purchase", 8443).when(kind == "signup", 53)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (user % 256).cast("string")).alias("src_ip"),
        F.concat(F.lit("198.51.100."), F.regexp_extract("props", r"\d+", 0)).alias("dst_ip"), protocol.alias("protocol"), port.cast("int").alias("dst_port"),
        F.least(F.lit(65535), F.greatest(F.lit(1), F.floor(F.col("value") * 10))).cast("int").alias("packet_length"),
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as packets; iat_ms is the time since the packet before, by source and day."""
    day = Window.partitionBy("src_ip", F.to_date("event_time")).orderBy("event_time", "event_id")
    gap = (F.unix_micros("event_time") - F.unix_micros(F.lag("event_time").over(day))) / 1000.0
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("iat_ms", gap)


def in_ten(ip: Column) -> Column:
    """A source "10.0.N.m" of ``packets_of`` as an address that exists: from user 65536 on N is over 255, and 10/8 holds the user's number in all three parts."""
    part = F.split(ip, "[.]")
    n = F.get(part, 2).try_cast("long")
    return F.concat(F.lit("10."), (F.floor(n / 256) % 256).cast("string"), F.lit("."), (n % 256).cast("string"), F.lit("."), F.get(part, 3))


def once(df: DataFrame, keys: Sequence[str] = ("event_time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_length"), watermark_s: int = 30) -> DataFrame:
    """Each packet once: of rows with equal keys the first. A stream keeps a key until the watermark is past it, and drops later rows as late."""
    if not df.isStreaming:
        return df.dropDuplicates(list(keys))
    return df.withWatermark("event_time", f"{watermark_s} seconds").dropDuplicatesWithinWatermark(list(keys))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of packets."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return packets_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def raw_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as contract strings in which some records break each rule, for what cleans and validates."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    kind = F.col("event_type")
    protocol = F.when(kind == "signup", "udp").when(kind == "error", " ICMP ").otherwise("TCP")
    return e.select(
        "event_id",
        F.when(i % 41 == 0, "yesterday").when(i % 43 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("timestamp"),
        F.when(i % 47 == 0, "").when(i % 53 == 0, "10.0.0.256").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))).alias("src_ip"),
        F.when(i % 59 == 0, "fe80::1").otherwise(F.concat(F.lit("198.51.100."), F.regexp_extract("props", r"\d+", 0))).alias("dst_ip"),
        F.when(i % 61 == 0, "70000").otherwise("50000").alias("src_port"),
        F.when(kind == "error", "").when(i % 67 == 0, "http").when(kind == "click", "443").when(kind == "view", "8080").otherwise("53000").alias("dst_port"),
        F.when(i % 71 == 0, None).when(i % 73 == 0, "SCTP").otherwise(protocol).alias("protocol"),
        F.when(i % 79 == 0, "0").otherwise(F.greatest(F.lit(1), F.floor(F.col("value") * 10)).cast("string")).alias("packet_length"),
        F.when(i % 83 == 0, "zz:00").otherwise("").alias("src_mac"), F.lit("00:11:22:33:44:55").alias("dst_mac"),
        F.when(i % 89 == 0, "16").when(protocol == "TCP", "0x0010").otherwise("").alias("tcp_flags"), F.when(i % 97 == 0, "-1").otherwise("0.5").alias("iat_ms"),
    )


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a dense communication graph: suppliers send to parts."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(F.col("l_shipdate").cast("timestamp").alias("event_time"), F.concat(F.lit("s"), "l_suppkey").alias("src_ip"), F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("dst_ip"), F.floor("l_quantity").cast("int").alias("packet_length"))
