"""Column expressions over packet fields: parsing, validity, classes, anonymisation. No UDFs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PROTOCOLS

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
H16 = "[0-9a-fA-F]{1,4}"
#: All ways to shorten eight groups with one "::", and the full form.
IPV6 = "^(" + "|".join([f"({H16}:){{7}}{H16}", *(f"({H16}:){{0,{a}}}{H16}?::({H16}:){{0,{6 - a - 1}}}{H16}" for a in range(6)), f"({H16}:){{1,7}}:", f":(:{H16}){{1,7}}", "::"]) + ")$"
#: Private, link-local and loopback addresses; shapes of MAC addresses, TCP flags and time stamps.
PRIVATE = r"^(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3}|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|::1|[fF][cCdD][0-9a-fA-F]{2}:.*|[fF][eE]80:.*)$"
MAC = "^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"
FLAGS = "^0x[0-9a-fA-F]+$"
STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$"


def event_time(text: Column) -> Column:
    """The first of three formats that fits; null, not an error, where none does."""
    forms = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms], F.try_to_timestamp(text))


def is_ip(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4) | text.rlike(IPV6), F.lit(False))


def is_private(ip: Column) -> Column:
    """By the shapes of PRIVATE; null is not private."""
    return F.coalesce(ip.rlike(PRIVATE), F.lit(False))


#: Further IPv4 ranges that are not global (documentation, benchmarking, reserved, this network).
NOT_GLOBAL = r"^(0\.|192\.0\.0\.|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(4[0-9]|5[0-5])\.)"


def ip_class(ip: Column) -> Column:
    """'private' for any valid address that is not global, else 'public', as for what is no address."""
    return F.when(is_ip(ip) & (is_private(ip) | ip.rlike(NOT_GLOBAL) | ip.isin("::")), "private").otherwise("public")


def port_class(port: Column) -> Column:
    return F.when(port.between(0, 1023), "well-known").when(port.between(1024, 49151), "registered").when(port.between(49152, 65535), "dynamic").otherwise("none")


def valid_port(port: Column) -> Column:
    return port.isNull() | port.between(0, 65535)


def is_valid(stamp: Column, src: Column, dst: Column, sport: Column, dport: Column, protocol: Column, length: Column) -> Column:
    """True or false, never null, so that valid and invalid rows are all rows."""
    ok = stamp.isNotNull() & (F.trim(src) != "") & (F.trim(dst) != "") & length.between(1, 65535) & protocol.isin(*PROTOCOLS) & valid_port(sport) & valid_port(dport)
    return F.coalesce(ok, F.lit(False))


def row_reason(c: dict[str, Column]) -> Column:
    """The first rule of the contract that a record of strings breaks, or null. Keys of ``c``: the contract's columns."""

    def whole(x: Column, low: int, high: int) -> Column:
        return F.coalesce(F.expr("true") & x.rlike(r"^[+-]?\d{1,9}$") & x.try_cast("int").between(low, high), F.lit(False))

    blank = {k: F.coalesce(F.trim(v), F.lit("")) == "" for k, v in c.items()}
    rules = [
        (blank["timestamp"] | ~c["timestamp"].rlike(STAMP) | F.try_to_timestamp(c["timestamp"], F.lit("yyyy-MM-dd HH:mm:ss.SSS")).isNull(), "timestamp"),
        (blank["src_ip"] | ~is_ip(c["src_ip"]), "src_ip"),
        (blank["dst_ip"] | ~is_ip(c["dst_ip"]), "dst_ip"),
        (~blank["src_port"] & ~whole(c["src_port"], 0, 65535), "src_port"),
        (~blank["dst_port"] & ~whole(c["dst_port"], 0, 65535), "dst_port"),
        (blank["protocol"] | ~F.upper(c["protocol"]).isin(*PROTOCOLS), "protocol"),
        (~whole(c["packet_length"], 1, 65535), "packet_length"),
        (~blank["src_mac"] & ~c["src_mac"].rlike(MAC), "src_mac"),
        (~blank["dst_mac"] & ~c["dst_mac"].rlike(MAC), "dst_mac"),
        (~blank["tcp_flags"] & ~c["tcp_flags"].rlike(FLAGS), "tcp_flags"),
        (~blank["iat_ms"] & ~F.coalesce(c["iat_ms"].try_cast("double") >= 0, F.lit(False)), "iat_ms"),
    ]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in ((n, b) for b, n in rules)])


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as binary, from built-in functions: the padded keys are made here, once."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


def _byte(digest: Column, i: int) -> Column:
    return F.conv(F.substring(F.hex(digest), 2 * i + 1, 2), 16, 10).cast("int")


def anonymise_ip(ip: Column, key: bytes) -> Column:
    """Private IPv4 to 10/8, other IPv4 to 198.18/16, IPv6 to fd00::/8, by keyed hash; what is no address stays."""
    text = F.lower(F.trim(ip))
    d = hmac_sha256(text, key)
    private = F.concat_ws(".", F.lit("10"), _byte(d, 0), _byte(d, 1), _byte(d, 2) % 253 + 1)
    public = F.concat_ws(".", F.lit("198.18"), _byte(d, 0), _byte(d, 1) % 253 + 1)
    groups = F.concat_ws(":", *[F.lower(F.substring(F.hex(d), 4 * i + 1, 4)) for i in range(4)])
    v4, v6 = text.rlike(IPV4), text.rlike(IPV6)
    return F.when(v4 & is_private(text), private).when(v4, public).when(v6, F.concat(F.lit("fd00::"), groups)).otherwise(ip)


def anonymise_mac(mac: Column, key: bytes) -> Column:
    d = F.lower(F.hex(hmac_sha256(F.lower(F.trim(mac)), key)))
    made = F.concat_ws(":", F.lit("02"), *[F.substring(d, 2 * i + 1, 2) for i in range(5)])
    return F.when(F.lower(F.trim(mac)).rlike(MAC), made).otherwise(mac)


def iso_text(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
