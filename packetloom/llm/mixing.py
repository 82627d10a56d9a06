"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: Bits of the sampling key, and how many of them the first pass sums by.
KEY_BITS, COARSE_BITS = 52, 14


def sampling_key(doc_id: Column, seed: int) -> Column:
    """52 bits of md5(seed:doc_id), the same in any SQL engine; a null id counts as empty."""
    hex13 = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(hex13, 16, 10).cast("long")


def water_fill(sources: DataFrame, budget_ratio: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size, weight, one row a source) with ``target``.

    Sources stand by cap/weight; with the first k clamped at their caps the rest share
    ``(budget - caps) / weights``. That level rises while the next source is over its cap and falls
    after, so its maximum is the level at which no source is above its cap.
    """
    limit = sources.withColumns({"lid": F.lit(cap) * F.col("source_size"), "total": F.lit(budget_ratio) * F.sum("source_size").over(Window.partitionBy(F.lit(1)))})
    order = Window.orderBy(F.col("lid") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("lid").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = limit.withColumn("level", (F.col("total") - before) / left)
    level = level.withColumn("level", F.max("level").over(Window.partitionBy(F.lit(1))))
    return level.select("source", "source_size", F.round(F.least(F.col("lid"), F.greatest(F.lit(0.0), F.col("level")) * F.col("weight")), 6).alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget_ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: target, whole repetitions, and where the seeded fractional repetition ends.

    ``sized``: source, key (see sampling_key), size. Documents of a source stand in the order of
    their keys. All whose key is under ``cut`` are taken once more; those with key ``cut`` share the
    ``rest`` words. Sums by (source, leading bits) find the part that holds the cut, so that only
    1/16384 of a source's documents are ever ordered; no source meets in one task.
    """
    sums = sized.groupBy("source", F.shiftright("key", KEY_BITS - COARSE_BITS).alias("coarse")).agg(F.sum("size").alias("size"))
    per_source = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    targets = water_fill(per_source.withColumn("weight", weight), budget_ratio, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole)
    targets = targets.withColumn("need", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    targets = written(targets.coalesce(1), "mix_targets")

    t, s = targets.alias("t"), sums.alias("s")
    same = F.col("t.source").eqNullSafe(F.col("s.source"))
    upto = F.sum("s.size").over(Window.partitionBy("s.source").orderBy("s.coarse"))
    at = s.join(t, same).select(F.col("t.source").alias("source"), "s.coarse", "t.need", (upto - F.col("s.size")).alias("before"), upto.alias("upto"))
    at = at.filter((F.col("before") < F.col("need")) & (F.col("need") <= F.col("upto"))).select("source", "coarse", (F.col("need") - F.col("before")).alias("missing"))

    d, a = sized.alias("d"), at.alias("a")
    inside = d.join(a, F.col("d.source").eqNullSafe(F.col("a.source")) & (F.shiftright("d.key", KEY_BITS - COARSE_BITS) == F.col("a.coarse")))
    inside = inside.groupBy(F.col("a.source").alias("source"), F.col("a.missing").alias("missing"), F.col("d.key").alias("key")).agg(F.sum("d.size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    cut = inside.withColumn("upto", upto).filter((F.col("upto") - F.col("size") < F.col("missing")) & (F.col("missing") <= F.col("upto")))
    cut = cut.select(F.col("source").alias("cut_source"), F.col("key").alias("cut"), (F.col("missing") - F.col("upto") + F.col("size")).alias("rest"), F.col("size").alias("at_cut"), F.lit(True).alias("found"))
    return targets.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (3, 1, 2), budget_ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    Sources in code-point order (null last, one source like others) get ``weights`` in turn and share
    ``budget_ratio`` of all words; none gets more than ``cap`` times its own. A null text has size 0
    and is taken 0 times; repeated rows are separate documents with the same key, and at the cut they
    share what is left. At most one key of a source is taken in part. Columns of these names in
    ``docs`` are replaced; an empty table gives an empty table.
    """
    small = written(docs.select("source", sampling_key(F.col("doc_id"), seed).alias("key"), n_words(F.col("text")).alias("size")), "mix_sizes")
    plan = mix_plan(small, weights, budget_ratio, cap).select(*[F.col(c).alias(f"__mix_{c}") for c in ("source", "source_size", "target", "whole", "cut", "rest", "at_cut")])
    plan = written(plan.coalesce(1), "mix_plan")  # its size is known, so that it is broadcast if small and texts stay where they are
    made = ["size", "source_size", "target", "taken"]
    d = docs.drop(*made, "__mix_key").withColumns({"size": n_words(F.col("text")), "__mix_key": sampling_key(F.col("doc_id"), seed)})
    extra = (
        F.when(F.col("__mix_key") < F.col("__mix_cut"), F.col("size"))
        .when(F.col("__mix_key") == F.col("__mix_cut"), F.floor(F.col("size") * F.col("__mix_rest") / F.col("__mix_at_cut")))
        .otherwise(0)
    )
    joined = d.join(plan, F.col("source").eqNullSafe(F.col("__mix_source")))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in made],
        "size",
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_whole") * F.col("size") + extra).cast("long").alias("taken"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS lid, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(lid) OVER (ORDER BY lid / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY lid / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, round(least(lid, max(lev) OVER () * weight), 6)::DOUBLE AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
n AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS need FROM u),
g AS (SELECT source, k, sum(size) AS at_k, sum(sum(size)) OVER (PARTITION BY source ORDER BY k) AS upto FROM d GROUP BY source, k)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (n.whole * d.size + CASE WHEN g.upto <= n.need THEN d.size
                                WHEN g.upto - g.at_k < n.need THEN floor(d.size * (n.need - g.upto + g.at_k)::DOUBLE / g.at_k)
                                ELSE 0 END)::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.k = d.k
"""
