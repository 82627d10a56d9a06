"""WARC fixity: records and ordered offset ranges hashed into trees; replicas differ where roots do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT_BITS, LEVELS = 4, 3
SHARD_BITS = FANOUT_BITS * LEVELS


def warc_record(url: Column, page_id: Column, body: Column) -> Column:
    """A WARC/1.1 response record as text; nulls count as empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """Distinct records: (shard, slot, digest, length, copies). A shard holds 4096 successive page ids.

    Exact repeats of a record collapse to one leaf with its number of copies before anything is
    gathered; a null page_id goes to shard -1, slot 0.
    """
    record = warc_record(pages["url"], pages["page_id"], pages["html"])
    at = pages["page_id"].cast("long")
    r = pages.select(
        F.coalesce(F.shiftright(at, SHARD_BITS), F.lit(-1)).alias("shard"),
        F.coalesce(at.bitwiseAND((1 << SHARD_BITS) - 1), F.lit(0)).cast("int").alias("slot"),
        F.sha2(record, 256).alias("digest"),
        F.octet_length(record).cast("long").alias("length"),
    )
    return r.groupBy("shard", "slot", "digest", "length").agg(F.count(F.lit(1)).alias("copies"))


def fold(nodes: DataFrame, keys: list[str], child: str) -> DataFrame:
    """One node for each of ``keys``: the hash of its children's (position, hash) in order."""
    kids = F.sort_array(F.collect_list(F.struct(F.col(child).alias("c"), F.col("hash").alias("h"))))
    text = F.concat_ws(",", F.transform(kids, lambda x: F.concat_ws("=", x["c"].cast("string"), x["h"])))
    return nodes.groupBy(*keys).agg(F.sha2(F.concat(F.lit("01"), text), 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the slots up to the shards' roots, each (shard, node, hash).

    Children of a slot are folded by their digest's first byte before they are folded by slot, so a
    page id with very many versions is spread over 256 groups; every other node has 16 children at most.
    """
    leaf = records.select("shard", "slot", "digest", F.substring("digest", 1, 2).alias("bin"), F.sha2(F.concat_ws(":", F.lit("00"), "digest", "length", "copies"), 256).alias("hash"))
    bins = fold(leaf, ["shard", "slot", "bin"], "digest")
    level = fold(bins, ["shard", "slot"], "bin").withColumnRenamed("slot", "node")
    levels = [level]
    for _ in range(LEVELS):
        level = fold(level.withColumn("up", F.shiftright("node", FANOUT_BITS)), ["shard", "up"], "node").withColumnRenamed("up", "node")
        levels.append(level)
    return levels


def differing(a: DataFrame, b: DataFrame, inside: DataFrame | None) -> DataFrame:
    """Nodes of one level that differ or that one replica lacks; only below ``inside`` where that is given."""
    if inside is not None:
        up = inside.select(F.col("shard").alias("s"), F.col("node").alias("u"))
        below = (F.col("shard") == F.col("s")) & (F.shiftright("node", FANOUT_BITS) == F.col("u"))
        a, b = a.join(up, below, "left_semi"), b.join(up, below, "left_semi")
    both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["shard", "node"], "full")
    return both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("shard", "node")


def offsets(records: DataFrame) -> DataFrame:
    """Records with the offset at which they begin in their shard's file, in slot and digest order."""
    w = Window.partitionBy("shard").orderBy("slot", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(w), F.lit(0)))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Where ``replica`` differs: (shard, slot, status, digest, offset, length, copies, replica_copies).

    Roots are compared first; each further level is looked at only below nodes that differ. Offsets
    are the original's, null for what only the replica has. status: damaged (both have records in
    the slot), missing (the replica has none), extra (the original has none), recounted (same record,
    other number of copies). Two equal tables, and two empty ones, give no rows. Columns other than
    page_id, url and html are not looked at.
    """
    la, lb = written(leaves(original), "warc_leaves"), written(leaves(replica), "warc_leaves")
    ta, tb = tree(la), tree(lb)
    found: DataFrame | None = None
    for a, b in zip(reversed(ta), reversed(tb), strict=True):
        found = written(differing(a, b, found), "warc_differing")
    bad = found.select(F.col("shard").alias("s"), F.col("node").alias("n"))
    inside = (F.col("shard") == F.col("s")) & (F.col("slot") == F.col("n"))
    shards = bad.select("s").distinct()
    ra = offsets(la.join(shards, la["shard"] == F.col("s"), "left_semi")).join(bad, inside, "left_semi")
    rb = lb.join(bad, inside, "left_semi")
    x = ra.join(rb.select("shard", "slot", "digest", F.col("length").alias("length_b"), F.col("copies").alias("replica_copies")), ["shard", "slot", "digest"], "full")
    x = x.filter(~F.col("copies").eqNullSafe(F.col("replica_copies")))
    w = Window.partitionBy("shard", "slot")
    in_a, in_b = F.count("copies").over(w) > 0, F.count("replica_copies").over(w) > 0
    both = F.col("copies").isNotNull() & F.col("replica_copies").isNotNull()
    status = F.when(both, "recounted").when(in_a & in_b, "damaged").when(in_a, "missing").otherwise("extra")
    return x.select(
        "shard", "slot", F.when(F.col("shard") >= 0, F.col("shard") * (1 << SHARD_BITS) + F.col("slot")).alias("page_id"), status.alias("status"), "digest", "offset",
        F.coalesce("length", "length_b").alias("length"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("replica_copies", F.lit(0)).alias("replica_copies"),
    )


def planted_replica(pages: DataFrame) -> DataFrame:
    """A replica with known faults: a byte changed where page_id % 53 = 7, records lost where page_id % 101 = 11."""
    lost = F.coalesce(F.pmod("page_id", F.lit(101)) == 11, F.lit(False))
    hit = F.coalesce(F.pmod("page_id", F.lit(53)) == 7, F.lit(False))
    html = F.when(hit, F.concat(F.lit("#"), F.substring(F.coalesce("html", F.lit("")), 2, 1 << 30))).otherwise(F.col("html"))
    return pages.filter(~lost).select("page_id", "url", html.alias("html"))


ORACLE = r"""
WITH o AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, url, CASE WHEN page_id % 53 = 7 THEN '#' || substr(html, 2) ELSE html END AS html FROM o WHERE page_id % 101 <> 11),
rec AS (SELECT 'a' AS side, * FROM o UNION ALL SELECT 'b', * FROM r),
t AS (SELECT side, page_id >> 12 AS shard, (page_id & 4095)::INT AS slot,
             'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
             'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) ||
             chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM rec),
l AS (SELECT side, shard, slot, sha256(rec) AS digest, strlen(rec)::BIGINT AS length, count(*) AS copies FROM t GROUP BY ALL),
a AS (SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY shard ORDER BY slot, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l WHERE side = 'a'),
b AS (SELECT * FROM l WHERE side = 'b'),
x AS (SELECT shard, slot, digest, a.pos, coalesce(a.length, b.length) AS length, a.copies AS ca, b.copies AS cb FROM a FULL JOIN b USING (shard, slot, digest) WHERE a.copies IS DISTINCT FROM b.copies),
s AS (SELECT *, count(ca) OVER (PARTITION BY shard, slot) > 0 AS in_a, count(cb) OVER (PARTITION BY shard, slot) > 0 AS in_b FROM x)
SELECT shard, slot, shard * 4096 + slot AS page_id,
       CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN 'recounted' WHEN in_a AND in_b THEN 'damaged' WHEN in_a THEN 'missing' ELSE 'extra' END AS status,
       digest, pos AS "offset", length, coalesce(ca, 0) AS copies, coalesce(cb, 0) AS replica_copies FROM s
"""
