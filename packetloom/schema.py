"""The packet record contract and the result tables."""

from __future__ import annotations

from pyspark.sql import types as T

CONTRACT_VERSION = "1"
PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")
#: The eleven columns of a packet record, in order.
PACKET_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packet_length", T.IntegerType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("iat_ms", T.DoubleType()),
    ]
)
COLUMNS = tuple(PACKET_SCHEMA.names)
#: The sixteen fields of a raw capture line, in order.
RAW_FIELDS = (
    "frame_time_epoch", "ip_src", "ip_dst", "ipv6_src", "ipv6_dst", "tcp_srcport", "tcp_dstport", "udp_srcport",
    "udp_dstport", "ip_proto", "ipv6_nxt", "frame_len", "eth_src", "eth_dst", "tcp_flags", "frame_time_delta",
)
#: Why a raw line is rejected.
REJECT_REASONS = ("WRONG_COLUMNS", "NON_IP", "BAD_IP", "BAD_TIMESTAMP", "BAD_LENGTH", "BAD_PORT", "VALIDATION")
#: Key columns of each result table; the others are values.
RESULT_KEYS = {
    "window_metrics": ("window_start", "window_len_s"),
    "protocol_counts": ("window_start", "window_len_s", "protocol"),
    "port_counts": ("window_start", "window_len_s", "port"),
    "filter_counts": ("window_start", "window_len_s", "filter_name"),
    "distinct_counts": ("window_start", "window_len_s"),
    "sampling_compare": ("ts", "method"),
    "counting_ones": ("ts", "predicate_name"),
    "moments": ("window_start", "window_len_s"),
    "decay_traffic": ("ts", "half_life_s"),
    "decay_top_keys": ("ts", "half_life_s", "key_type", "key"),
    "frequent_itemsets": ("window_start", "algorithm", "itemset"),
    "ip_edges": ("window_start", "window_len_s", "src_ip", "dst_ip"),
    "source_stats": ("window_start", "window_len_s", "src_ip"),
    "alerts": ("alert_id",),
    "pipeline_health": ("ts", "component", "metric"),
    "hist_results": ("query_name", "run_at"),
}
