"""Fill-in-middle by ropes: small trees against plain strings, round trips, odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import fim

PIECES = ["a", "bc", "Z", " ", "é", "日", "𝄞", "<", "P", "\n", "<P", "hello" * 3, ">", "0"]


def as_bytes(t):
    return np.frombuffer(t.encode(), np.uint8)


def units(t):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", t)


@pytest.mark.parametrize(("leaf", "window"), [(4, 16), (3, 7), (1, 5), (2048, 1 << 18)])
def test_ropes_split_and_join_as_strings(monkeypatch, leaf, window):
    monkeypatch.setattr(fim, "LEAF_BYTES", leaf)
    monkeypatch.setattr(fim, "WINDOW", window)
    r = random.Random(leaf)
    for _ in range(400):
        t = "".join(r.choice(PIECES) for _ in range(r.randrange(60)))
        u, x = units(t), fim.rope(as_bytes(t))
        assert x.size == (len(u), len(t), len(t.encode())) and fim.flat(x).decode() == t
        i, k = r.randrange(len(u) + 1), r.randrange(len(t) + 1)
        assert [fim.flat(y).decode() for y in fim.split(x, i)] == ["".join(u[:i]), "".join(u[i:])]
        assert [fim.flat(y).decode() for y in fim.split(x, k, fim.POINTS)] == [t[:k], t[k:]]


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_rearranged_texts_come_back(monkeypatch, form):
    monkeypatch.setattr(fim, "LEAF_BYTES", 5)
    monkeypatch.setattr(fim, "WINDOW", 23)
    r = random.Random(7)
    for _ in range(400):
        t = "".join(r.choice(PIECES) for _ in range(r.randrange(1, 60)))
        if any(x in t for x in ("<P>", "<S>", "<M>")):
            continue
        u = units(t)
        a, b = sorted(r.randrange(len(u) + 1) for _ in range(2))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        whole, np_, nm = fim.rearranged(fim.rope(as_bytes(t)), a, b, form)
        out = fim.flat(whole)
        assert out.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
        assert (np_, nm) == (len(p), len(m)) and whole.size[:2] == (len(u) + 9, len(t) + 9)
        assert fim.rebuilt(np.frombuffer(out, np.uint8), form).decode() == t


def test_a_rope_is_flat_and_a_split_cuts_one_path():
    t = "ab cd, " * 200_000
    x = fim.rope(as_bytes(t))

    def depth(r):
        return 0 if r.data is not None else 1 + max(depth(r.left), depth(r.right))

    n = len(t) // fim.LEAF_BYTES
    assert depth(x) <= n.bit_length() + 2
    whole, _, _ = fim.rearranged(x, 333_333, 700_000, "psm")
    assert depth(whole) <= 3 * (n.bit_length() + 3)
    long = "x" * 700_000 + "é" + "y" * 600_000
    assert fim.rope(as_bytes(long)).size == (3, len(long), len(long.encode()))


def test_not_a_rearranged_text_is_refused():
    with pytest.raises(ValueError, match="psm"):
        fim.rebuilt(as_bytes("no sentinels here"), "psm")


def expected(i, t, plain=10, spm=20):
    t = t or ""
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
    u = units(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return len(u), "plain", t, None, None
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(u), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ROWS = [(None, "a b c"), (1, None), (2, ""), (3, "see <P> here"), (4, "<S>"), (5, "日本 語é" * 50), (6, "one"), (6, "one"), (7, "\x00 \r\n\t"), (8, "w1 w22, " * 90_000), *[(i, f"text number {i} of some, with words." * (i % 7)) for i in range(20, 80)]]


def test_odd_rows(spark):
    d = spark.createDataFrame([(i, t, "kept", 5, "x") for i, t in ROWS], "doc_id long, text string, other string, n long, `fim_text` string")
    got = fim.fill_in_middle(d)
    assert got.columns == ["doc_id", "text", "other", *fim.MADE]
    rows = got.withColumn("back", fim.restored(F.col("fim_text"), F.col("form"))).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert sorted(map(repr, ((r["doc_id"], r["other"], r["back"], tuple(r[c] for c in fim.MADE)) for r in rows))) == sorted(map(repr, ((i, "kept", t or "", expected(i, t)) for i, t in ROWS)))


def test_parameters_and_an_empty_table(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(d, plain=100).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(d, plain=0, spm=100).collect()} == {"plain", "spm"}
    assert fim.report(d.limit(0)).count() == 0
