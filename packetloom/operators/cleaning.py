"""Cleaning, validation, named filters and bit predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..schema import COLUMNS


def clean(df: DataFrame) -> DataFrame:
    """Packets of contract columns with event_time, types cast without errors, and validity and class columns."""
    sport, dport, length = (F.col(c).try_cast("int") for c in ("src_port", "dst_port", "packet_length"))
    protocol = F.upper(F.trim("protocol"))
    at = net.event_time(F.col("timestamp"))
    rest = [c for c in df.columns if c not in ("src_port", "dst_port", "packet_length", "protocol", "iat_ms")]
    return df.select(
        *rest, sport.alias("src_port"), dport.alias("dst_port"), length.alias("packet_length"), protocol.alias("protocol"), F.col("iat_ms").try_cast("double").alias("iat_ms"), at.alias("event_time"),
        net.is_valid(at, F.col("src_ip"), F.col("dst_ip"), sport, dport, protocol, length).alias("is_valid"),
        net.is_private(F.col("src_ip")).alias("is_private_src"), net.is_private(F.col("dst_ip")).alias("is_private_dst"), net.port_class(dport).alias("port_class"),
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid); together they hold every row."""
    df = df if "is_valid" in df.columns else clean(df)
    return df.filter("is_valid"), df.filter("not is_valid")


def validate(df: DataFrame) -> DataFrame:
    """``df`` of contract strings with ``reason``, the first broken rule or null."""
    return df.withColumn("reason", net.row_reason({c: F.col(c) for c in COLUMNS}))


@dataclass(frozen=True)
class FilterSpec:
    name: str
    expr: str

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.expr.strip():
            raise ValueError("a filter needs a name and an expression")


#: Filters that hold where none are configured.
DEFAULT_FILTERS = (
    FilterSpec("tcp_only", "protocol = 'TCP'"),
    FilterSpec("udp_only", "protocol = 'UDP'"),
    FilterSpec("web_traffic", "dst_port IN (80, 443)"),
    FilterSpec("dns_traffic", "dst_port = 53"),
    FilterSpec("large_packets", "packet_length > 1000"),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse_filters(config: list[dict] | None = None) -> list[FilterSpec]:
    """Filters of dicts with name and one of expr, dst_ports, protocol, min_length (>=), src_ip; none: the defaults."""
    if not config:
        return list(DEFAULT_FILTERS)
    out = []
    for c in config:
        if not isinstance(c, dict):
            raise TypeError(f"not a filter: {c!r}")
        if not c.get("name"):
            raise ValueError("a filter needs a name")
        if c.get("expr"):
            e = str(c["expr"])
        elif "dst_ports" in c:
            ports = c["dst_ports"] if isinstance(c["dst_ports"], list | tuple) else [c["dst_ports"]]
            e = f"dst_port IN ({', '.join(str(int(p)) for p in ports)})"
        elif "protocol" in c:
            e = f"protocol = {_quoted(str(c['protocol']).upper())}"
        elif "min_length" in c:
            e = f"packet_length >= {int(c['min_length'])}"
        elif "src_ip" in c:
            e = f"src_ip = {_quoted(str(c['src_ip']))}"
        else:
            raise ValueError(f"filter {c['name']} has no criterion")
        out.append(FilterSpec(str(c["name"]), e))
    return out


def validate_filters(spark: SparkSession, filters: list[FilterSpec], schema: str) -> None:
    """Analyse each filter against a schema; no job runs."""
    empty = spark.createDataFrame([], schema)
    for f in filters:
        _ = empty.filter(F.expr(f.expr)).schema


def apply_filter(df: DataFrame, spec: FilterSpec | str, filters: list[FilterSpec] | None = None) -> DataFrame:
    if isinstance(spec, str):
        named = {f.name: f for f in [*DEFAULT_FILTERS, *(filters or [])]}
        spec = named[spec]
    if not isinstance(spec, FilterSpec):
        raise TypeError(f"not a filter: {spec!r}")
    return df.filter(F.expr(spec.expr))


#: Bit predicates that hold where none are configured.
DEFAULT_PREDICATES = (FilterSpec("is_tcp", "protocol = 'TCP'"), FilterSpec("is_udp", "protocol = 'UDP'"), FilterSpec("is_large_packet", "packet_length >= 1000"), FilterSpec("is_https", "dst_port = 443"))


def parse_predicates(config: list[dict] | None = None) -> list[FilterSpec]:
    """Predicates of dicts with name and expr, protocol (as given), min_length or dst_port; without a criterion every packet is a 1."""
    if not config:
        return list(DEFAULT_PREDICATES)
    out = []
    for c in config:
        if c.get("expr"):
            e = str(c["expr"])
        elif "protocol" in c:
            e = f"protocol = {_quoted(str(c['protocol']))}"
        elif "min_length" in c:
            e = f"packet_length >= {int(c['min_length'])}"
        elif "dst_port" in c:
            e = f"dst_port = {int(c['dst_port'])}"
        else:
            e = "1 = 1"
        out.append(FilterSpec(str(c["name"]), e))
    return out
