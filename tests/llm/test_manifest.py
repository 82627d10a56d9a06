"""The Merkle manifest: supersteps of any height against trees in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def up(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for x in levels[:-1]:
        j = i ^ 1
        out.append(None if j >= len(x) else (j < i, x[j]))
        i >>= 1
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        got = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = (got, up([leaf(r) for r in got]))
    top = up([trees[k][1][-1][0] for k in order])
    root, out = top[-1][0], []
    for g, k in enumerate(order):
        got, levels = trees[k]
        for i, r in enumerate(got):
            p = path(levels, i) + path(top, g)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            x = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for s in p:
                x = h(x) if s is None else h(s[1], x) if s[0] else h(x, s[1])
            out.append((r[0], leaf(r), levels[-1][0], root, h(*[s[1] for s in p if s]), x, x == root))
    return sorted(out, key=repr)


def rows_of(n, langs):
    return [(i, f"s{i % 3}", langs[i * i % len(langs)], i * 7, f"text {i} é") for i in range(n)]


ODD = [(None, None, None, None, None), (None, "a", "en", 3, "x"), (5, "a", "en", None, ""), (5, "a", "en", 4, "é日"), (5, "a", "en", 4, "é日"), (9, None, "", 1, "y"), (12, "b", "é", 2, "z" * 300_000), (13, "b", "zz", 2, "z")]


MANY = rows_of(61, ["en", "de", None, "fr", "en"])


@pytest.mark.parametrize(("bits", "rows"), [(1, MANY), (2, [*ODD, *rows_of(19, [f"l{i}" for i in range(11)])]), (8, ODD), (8, rows_of(1, ["en"]))])
def test_as_in_memory(spark, bits, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("g", "at", "block", "rows", "n", "leaf", "__tie", "__at")})
    d = d.repartition(3)
    got = manifest.verified(d, F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0, F.col("n_chars") + 1, bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_untampered_rows_all_verify_and_an_empty_table_has_none(spark):
    d = spark.createDataFrame(rows_of(300, ["en", "de", "en", "en"]), SCHEMA)
    assert manifest.verified(d).filter("verified").count() == 300
    assert manifest.report(d.limit(0)).count() == 0


def test_an_incomplete_vertex_is_refused(spark):
    counts = spark.createDataFrame([(0, 9)], "g long, n long")
    blocks = spark.createDataFrame([(0, b, [h(str(i)) for i in range(4 * b, min(9, 4 * b + 4))]) for b in (0, 2)], manifest.BLOCK)
    with pytest.raises(Exception, match="not complete"):
        manifest.climb(blocks, counts, 9, 2)
