"""The registered queries over whole tables: against SQL where there is any, else against brute force or held-out rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from packetloom.llm import registry


def cell(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert sorted(tuple(cell(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())


def test_language_of_held_out_rows(spark, sf):
    got = registry.queries()["op9_langid"](spark, sf)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    n, right = got.join(d, "doc_id").filter("held_out").selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert right / n > 0.95


def test_leaks_are_found(spark, sf):
    """Every document with 4 in 5 of an item's 5-word runs is found, and none without any."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()

    def runs(t):
        w = re.sub(r"[^\w]+", " ", t.lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    have = {d["doc_id"]: runs(d["text"]) for d in docs}
    got = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op3_decontam"](spark, sf).collect()}
    share = {(i, x["item_id"]): len(r & runs(x["text"])) / len(runs(x["text"])) for i, r in have.items() for x in items if len(runs(x["text"])) > 2}
    assert {k for k, v in share.items() if v >= 0.8} <= got and all(share.get(k, 0) > 0 for k in got)


def test_pipeline_as_its_stages(spark, sf):
    """The pipeline's rows against the operators' own reports, stage by stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf).persist()
        kept[name] = {r["doc_id"] for r in d.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(kept[b] <= kept[a] for a, b in zip(names, names[1:], strict=False)) and len(kept["language_id"]) >= 0.97 * docs.count()
    assert not {r["doc_id"] for r in d.filter(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]'").collect()}
    whole = {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r["doc_id"], r["taken"]) for r in d.collect()}


def test_pipeline_fits_decontamination_on_every_passage(spark, sf, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from packetloom.llm import decontam
    from packetloom.llm.common import table

    made, given = [], []
    build, svd = decontam.build, decontam.randomised_svd
    monkeypatch.setattr(decontam, "build", lambda *a: made.append(build(*a)) or made[-1])
    monkeypatch.setattr(decontam, "randomised_svd", lambda rows, *a, **k: given.append(rows) or svd(rows, *a, **k))
    d = table(spark, sf, "documents")
    corpus_pipeline.decontaminate(spark, d, sf)
    index = made[0]
    told = index.vocabulary[index.idf[decontam.bucket(index.vocabulary)] >= decontam.STOP_IDF]
    _, n = decontam.corpus_product(given[0], np.ones((len(index.vocabulary), 1)), gram=True)
    want = 0
    for text in d.select("text").toArrow()["text"]:
        for _, w in decontam.folded(pa.array([text.as_py()], pa.string())):
            there = np.isin(w.hash, told)
            want += sum(bool(there[a : a + 48].any()) for a in range(0, len(there), 48))
    assert n == want > d.count()
