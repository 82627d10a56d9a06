"""Bloom filters as mergeable aggregates of distinct bit positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(item: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), item), F.lit(bits)) for i in range(hashes)])


def bloom(df: DataFrame, item: str, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """(word, mask): the set bits in 64-bit words, a row for each word that has one; filters merge by bit_or of masks."""
    p = df.filter(F.col(item).isNotNull()).select(F.explode(positions(F.col(item), bits, hashes)).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    return p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))


def probe(df: DataFrame, item: str, sketch: DataFrame, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """Rows whose item may be in the filter: none that is gets lost."""
    d = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.explode(positions(F.col(item), bits, hashes)))
    d = d.join(sketch, F.shiftright("__p", 6) == F.col("word")).filter(F.call_function("getbit", F.col("mask"), F.pmod("__p", F.lit(64)).cast("int")) == 1)
    return d.groupBy("__id", *df.columns).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == hashes).select(*df.columns)


def members(df: DataFrame, item: str, of: DataFrame, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """Rows of ``df`` whose item is in ``of``: a filter of these drops most rows, and the few that it lets through by chance are found by the items themselves."""
    return probe(df, item, bloom(of, item, bits, hashes), bits, hashes).join(of.select(item).distinct(), item, "left_semi").select(*df.columns)
