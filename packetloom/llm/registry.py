"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fim, jaccard, langid, licenses, lm, manifest, minhash, mixing, pii, suffixes, topk, warc
from .common import table


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.planted_replica(pages))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).drop("query_row")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(docs := table(spark, sf_dir, "documents"), langid.fit(docs))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_links(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_warc_fixity, op2_minhash, op3_decontam, op4_pii, op5_mixing, op6_suffixes, op7_topk, op8_licenses, op9_langid, op10_lm,
        op11_jaccard, op12_fim, op13_manifest,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": warc.ORACLE, "op2_minhash": minhash.ORACLE, "op5_mixing": mixing.ORACLE, "op8_licenses": licenses.oracle(), "op7_topk": topk.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_fim": fim.ORACLE, "op13_manifest": manifest.ORACLE}
