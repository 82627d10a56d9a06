"""Frequent itemsets of one and two items over baskets of a source's services in a time slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def baskets(df: DataFrame, slice_s: int = 1) -> DataFrame:
    """(basket, items): distinct "PROTOCOL:port" of each source in each slice; without a port the protocol alone."""
    item = F.concat_ws(":", F.coalesce("protocol", F.lit("UNKNOWN")), F.col("dst_port").cast("string"))
    at = F.floor(F.unix_seconds("event_time") / slice_s) * slice_s
    d = df.filter("src_ip is not null").groupBy("src_ip", at.alias("slice")).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return d.select(F.concat_ws("@", "src_ip", F.col("slice").cast("string")).alias("basket"), "slice", "items")


def pair_bucket(a: Column, b: Column, buckets: int) -> Column:
    """CRC32 of the sorted pair "u|v" modulo ``buckets``."""
    return F.pmod(F.crc32(F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))), F.lit(buckets))


def format_itemset(items: Column) -> Column:
    return F.array_join(F.sort_array(items), " + ")


def pairs_of(b: DataFrame, *keep: str) -> DataFrame:
    """(keep, x, y): all pairs of each basket's items in order, one row after another; no cell holds more than one basket."""
    each = b.select(*keep, "items", F.posexplode("items").alias("i", "x"))
    rest = F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))
    return each.select(*keep, "x", F.explode(rest).alias("y"))


def mine(b: DataFrame, min_support: float = 0.05, algorithm: str = "apriori", buckets: int = 10007) -> DataFrame:
    """(itemset, size, support_count, support_ratio) with support of at least ceil(min_support * baskets), 1 at least.

    apriori: pairs of frequent items. pcy: pairs of frequent items whose bucket is frequent. brute: all pairs.
    The results are the same; what is counted differs. Frequent items are few by definition, at most
    (items a basket) / min_support, and are filtered inside each basket before pairs are made.
    """
    if algorithm not in ("apriori", "pcy", "brute"):
        raise ValueError(algorithm)
    least = b.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(min_support))).alias("least"), F.count(F.lit(1)).alias("n"))
    one = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(least))  # one row
    one = one.filter("c >= least")
    kept = b
    if algorithm != "brute":
        frequent = b.select("basket", F.explode("items").alias("item")).join(one.select("item"), "item", "left_semi")
        kept = frequent.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = pairs_of(kept)
    if algorithm == "pcy":
        bucket = pair_bucket(F.col("x"), F.col("y"), buckets)
        hot = pairs_of(b).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(least)).filter("c >= least")  # one row
        pairs = pairs.withColumn("bucket", bucket).join(hot.select("bucket"), "bucket", "left_semi")
    two = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(least)).filter("c >= least")  # one row
    sets = one.select(F.array("item").alias("i"), "c", "n").unionByName(two.select(F.array("x", "y").alias("i"), "c", "n"))
    return sets.select(format_itemset(F.col("i")).alias("itemset"), F.size("i").alias("size"), F.col("c").alias("support_count"), F.round(F.col("c") / F.col("n"), 4).alias("support_ratio"))


def fp_growth(b: DataFrame, min_support: float = 0.05) -> DataFrame:
    """The same through MLlib's FP-growth, of any size; for cross-checks and larger sets."""
    from pyspark.ml.fpm import FPGrowth

    f = FPGrowth(itemsCol="items", minSupport=min_support).fit(b).freqItemsets
    return f.select(format_itemset(F.col("items")).alias("itemset"), F.size("items").alias("size"), F.col("freq").alias("support_count"))


def rolling(df: DataFrame, window_s: int = 60, slide_s: int = 10, slice_s: int = 1, min_support: float = 0.05) -> DataFrame:
    """Frequent itemsets of one and two by sliding event-time window; baskets are counted in every window that holds their slice."""
    return rolling_of(baskets(df, slice_s), window_s, slide_s, min_support)


def rolling_of(b: DataFrame, window_s: int = 60, slide_s: int = 10, min_support: float = 0.05) -> DataFrame:
    """The same from baskets (basket, slice, items)."""
    b = b.withColumn("w", F.window(F.timestamp_seconds("slice"), f"{window_s} seconds", f"{slide_s} seconds"))
    n = b.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("c") >= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(min_support)))
    item = b.select("w", "basket", F.explode("items").alias("item"))
    one = item.groupBy("w", "item").agg(F.count(F.lit(1)).alias("c")).join(n, "w").filter(enough)
    kept = item.join(one.select("w", "item"), ["w", "item"], "left_semi").groupBy("w", "basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    two = pairs_of(kept, "w").groupBy("w", "x", "y").agg(F.count(F.lit(1)).alias("c")).join(n, "w").filter(enough)  # of frequent items alone
    c = one.select("w", F.array("item").alias("i"), "c", "n").unionByName(two.select("w", F.array("x", "y").alias("i"), "c", "n"))
    ratio = F.round(F.col("c") / F.col("n"), 4).alias("support_ratio")
    return c.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), format_itemset(F.col("i")).alias("itemset"), F.size("i").alias("size"), F.col("c").alias("support_count"), ratio)
