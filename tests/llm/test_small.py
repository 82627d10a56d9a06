"""Each operator on small hand-made tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import decontam, langid, licenses, lm, minhash, mixing, pii, registry, suffixes, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)


def words(seed, n, pool=400):
    r = random.Random(seed)
    return " ".join("w%03d" % r.randrange(pool) for _ in range(n))


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "hello there", "en", "b"), (4, "one", "en", "b"), (4, "one", "en", "b"), (5, "x" * 200_000, None, "c"), (6, words(1, 3000), "de", None)]


def clash(df):
    """The same rows with columns named like those the operators make."""
    return df.withColumns({c: F.lit("clash") for c in ("size", "taken", "target", "key", "n", "c", "k", "bands", "uid", "held_out", "score", "label", "g", "block")})


# ------------------------------------------------------------------ fixity
PAGES = [(i, f"http://x/{i}", f"<p>{words(i, 20)}</p>") for i in range(9000, 9300)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_fixity_finds_each_fault(spark):
    a = [*PAGES, PAGES[0], (None, None, None)]
    b = [(i, u, h + "!" if i == 9100 else h) for i, u, h in PAGES if i != 9200] + [(20000, "new", ""), (None, None, None)]
    got = {(r["page_id"], r["status"]) for r in warc.audit(pages(spark, a), pages(spark, b)).collect()}
    assert got == {(9000, "recounted"), (9100, "damaged"), (9200, "missing"), (20000, "extra")}
    at = warc.audit(pages(spark, a), pages(spark, b)).filter("page_id = 9200").first()
    record = lambda i, u, h: len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n")
    before = sum(record(*p) for p in [*PAGES, PAGES[0]] if p[0] < 9200)
    assert at["offset"] == before and at["length"] == record(*PAGES[200])


def test_fixity_of_equal_and_empty_tables(spark):
    p = clash(pages(spark, PAGES))
    assert warc.audit(p, p).count() == 0
    none = pages(spark, [])
    assert warc.audit(none, none).count() == 0 and warc.audit(none, pages(spark, PAGES[:3])).count() == 3


# ------------------------------------------------------------------ near duplicates
def brute_components(rows, k, num, den):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label, strict=True):
        if i is not None:
            least[v] = min(least.get(v, i), i)
    return sorted((i or -1, len(s), least.get(v) or -1) for (i, s), v in zip(sets, label, strict=True))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("e%d" % r.randrange(10**6) if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_as_brute_force(spark, k, num, den):
    rows = list(ODD)
    n = 100
    for f in range(6):
        base = words(100 + f, 120, 10**6)
        for j in range(25):
            rows.append((n, edited(base, n, (0, 0.005, 0.01, 0.02, 0.03)[j % 5]), "en", "s"))
            n += 1
    near = words(900, 120, 10**6)
    rows += [(None, edited(near, i, 0.005), "en", "s") for i in range(4)] + [(None, edited(words(100, 120, 10**6), 3, 0.005), "en", "s"), (n, edited(near, 9, 0.005), "en", "s")]
    rows += [(None, edited(words(901, 120, 10**6), i, 0.005 * i), "en", "s") for i in (0, 0, 1)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in minhash.near_duplicates(clash(docs(spark, rows)), k, num, den).collect())
    assert got == brute_components(rows, k, num, den)


def test_chains_and_dedup(spark):
    base = words(7, 300, 10**6).split()
    rows = [(2000 + i, " ".join(base[i * 5 : i * 5 + 100]), "en", "s") for i in range(30)]
    found = minhash.near_duplicates(docs(spark, rows), 3, 85, 100).collect()
    assert {r["component_id"] for r in found} == {2000} and sum(r["kept"] for r in found) == 1
    kept = minhash.deduplicated(docs(spark, [*rows, *ODD]), 3, 85, 100)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 2000] and kept.columns == docs(spark, []).columns
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_in_one_task_and_by_joins(spark):
    from packetloom.llm.components import components

    for seed in range(3):
        r = random.Random(seed)
        pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
        e = spark.createDataFrame(pairs, "a long, b long")
        label = {x: x for p in pairs for x in p}
        for _ in range(200):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        want = {(x, label[x]) for x in linked}
        assert {tuple(x) for x in components(e).collect()} == want
        if not seed:
            assert {tuple(x) for x in components(e, 0).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cell_links_join_components():
    import numpy as np

    r = np.random.default_rng(0)
    base = np.sort(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.sort(np.concatenate((base[i:], r.integers(0, 2**63, i).astype(np.uint64)))) for i in (0, 2, 4, 60)]
    a, b = minhash.cell_links(np.arange(4), np.arange(4), sets, 85, 100)
    assert {frozenset(x) for x in zip(a, b, strict=True)} <= {frozenset((0, 1)), frozenset((0, 2)), frozenset((1, 2))} and len(a) == 2


# ------------------------------------------------------------------ contamination
def test_decontamination(spark):
    items = [words(500 + i, 40, 5000) for i in range(20)] + ["too short"]
    bench = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    rows = [(i, words(i, 300, 5000), "en", "s") for i in range(200, 260)]
    hit = {200: 3, 210: 7, 220: 11}
    for k, (i, item) in enumerate(hit.items()):
        w = items[item].split()
        if k == 1:
            w[5], w[20] = "changed", "too"
        if k == 2:
            w = [x.upper() + "!!" for x in w]
        at = rows[i - 200][1].split()
        rows[i - 200] = (i, " ".join([*at[: 50 * k], *w, *at[50 * k :]]), "en", "s")
    d = clash(docs(spark, [*rows, *ODD]))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, bench).collect()} == set(hit.items())
    kept = decontam.decontaminated(docs(spark, [*rows, *ODD]), bench)
    assert kept.count() == len(rows) + len(ODD) - 3
    assert decontam.contaminated(d, bench.limit(0)).count() == 0 and decontam.contaminated(docs(spark, []), bench).count() == 0


def test_answers_are_looked_for(spark):
    q = words(1, 30, 5000)
    rows = [(1, words(2, 100, 5000) + " " + q + " the answer is fortytwo", "en", "s"), (2, words(3, 100, 5000) + " " + q, "en", "s")]
    bench = spark.createDataFrame([(5, q, "fortytwo")], "item_id long, text string, answer string")
    assert [r["doc_id"] for r in decontam.contaminated(docs(spark, rows), bench).collect()] == [1]


def test_long_items(spark):
    long = words(9, 700, 5000)
    rows = [(1, words(2, 100, 5000) + " " + long + " " + words(3, 100, 5000), "en", "s"), (2, " ".join(long.split()[:150]) + " " + words(4, 600, 5000), "en", "s")]
    bench = spark.createDataFrame([(5, long)], "item_id long, text string")
    got = decontam.contaminated(docs(spark, rows), bench).collect()
    assert [(r["doc_id"], r["common_words"], r["item_words"]) for r in got] == [(1, 700, 700)]


def test_more_items_than_singular_directions(spark):
    """1000 verbatim items in one block: those that the leading 256 directions do not hold are found too."""
    items = [words(9000 + i, 24, 3000) for i in range(1000)]
    rows = [(i, " ".join([words(20000 + i, 40, 3000), t, words(30000 + i, 40, 3000)]), "en", "s") for i, t in enumerate(items)]
    got = decontam.contaminated(docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(i, i) for i in range(1000)}


def test_short_and_worn_items_in_long_texts(spark):
    """Items of 5 to 12 words in the middle of other words, and longer ones of which 65% of the words are left."""
    items = [words(9000 + i, 5 + i % 8, 2000) for i in range(80)] + [words(9100 + i, 20, 2000) for i in range(40)]
    r = random.Random(1)
    left = items[:80] + [" ".join(w for j, w in enumerate(t.split()) if j in keep) for t in items[80:] for keep in [set(r.sample(range(20), 13))]]
    rows = [(i, " ".join([words(20000 + i, 90, 2000), t, words(30000 + i, 90, 2000)]), "en", "s") for i, t in enumerate(left)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows), bench, answer=0.0).collect()}
    assert not {i for i in range(120) if (i, i) not in got}


def test_subsequences_only_where_the_words_suffice(spark, monkeypatch):
    """A window with one rare word of an item many times has enough of its words by count, but no long subsequence."""
    import pyarrow as pa

    item = words(1, 20, 5000)
    texts = [" ".join(item.split()[:1] * 200), words(2, 100, 5000) + " " + item, words(3, 200, 5000)]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    index = decontam.indexes(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), bench, 0.6)[0]
    seen, lcs = [], decontam.lcs
    monkeypatch.setattr(decontam, "lcs", lambda a, b: seen.append(set(b.tolist())) or lcs(a, b))
    assert [r[:2] for r in index.matches(pa.array(texts), 0.35, 0.6, 0.5)] == [(1, 5)]
    assert seen and all(len(x) > 1 for x in seen)


def test_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    """A'A over the corpus, against brute force over every 48 words of every document: over 2000 of them, some longer, some repeated, some odd."""
    import numpy as np

    items = [words(500 + i, 30, 200) for i in range(3)]
    rows = [(i, words(i, 100 if i % 10 else 20, 200), "en", "s") for i in range(2300)] + [(7, words(7, 100, 200), "en", "s"), (None, words(8, 60, 200), None, None), (9000, None, None, None), (9001, "", None, None)]
    given, svd = [], decontam.randomised_svd
    monkeypatch.setattr(decontam, "randomised_svd", lambda rows, *a, **k: given.append(rows) or svd(rows, *a, **k))
    index = decontam.indexes(docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), 0.6)[0]
    width = len(index.vocabulary)
    got, n = decontam.corpus_product(given[0], np.eye(width), gram=False)
    import pyarrow as pa

    place = {w: int(np.searchsorted(index.vocabulary, h)) for t in items for _, x in decontam.folded(pa.array([t])) for w, h in zip(t.split(), x.hash, strict=True)}
    idf = index.idf[decontam.bucket(index.vocabulary)]
    want, many = np.zeros((width, width)), 0
    for _, t, _, _ in rows:
        t = (t or "").split()
        for a in range(0, len(t), 48):
            v = np.zeros(width)
            for w in t[a : a + 48]:
                if w in place and idf[place[w]] >= decontam.STOP_IDF:
                    v[place[w]] += idf[place[w]]
            if v.any():
                want += np.outer(v, v) / (v @ v)
                many += 1
    assert n == many > 2000 and np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_corpus_is_read_once_for_the_latent_space(spark, monkeypatch):
    """One pass makes A'A where it fits; products with wider matrices give the same space and the same results."""
    import numpy as np

    items = [words(500 + i, 30, 400) for i in range(6)]
    rows = [(i, words(i, 90, 400) + (" " + items[i] if i < 6 else ""), "en", "s") for i in range(120)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    passes, product = [], decontam.corpus_product
    monkeypatch.setattr(decontam, "corpus_product", lambda *a, **k: passes.append(1) or product(*a, **k))
    once = decontam.indexes(docs(spark, rows), bench, 0.6)[0]
    got = {(r["doc_id"], r["item_id"], r["common_words"]) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert not passes and {(i, i, 30) for i in range(6)} <= got
    monkeypatch.setattr(decontam, "GRAM_WORDS", 0)
    wide = decontam.indexes(docs(spark, rows), bench, 0.6)[0]
    assert len(passes) == 3 and np.allclose(once.weight, wide.weight, rtol=1e-3, atol=1e-3)


def test_latent_space_takes_one_python_worker_a_task(spark, monkeypatch):
    """Workers stay and count with their executor's memory; each also keeps only half of A'A, which is symmetric."""
    import numpy as np

    items = [words(500 + i, 30, 400) for i in range(6)]
    d = docs(spark, [(i, words(i, 90, 400), "en", "s") for i in range(40)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plans, added, wrote = [], decontam.added_up, decontam.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
    monkeypatch.setattr(decontam, "added_up", lambda parts, *a: plan(parts) or added(parts, *a))
    monkeypatch.setattr(decontam, "written", lambda df, *a: plan(df) or wrote(df, *a))
    index = decontam.indexes(d, bench, 0.6)[0]
    assert plans == [1]
    monkeypatch.setattr(decontam, "GRAM_WORDS", 0)
    decontam.indexes(d, bench, 0.6)
    assert plans == [1, 1, 1, 1, 1]  # rows written, then passed three times
    width = len(index.vocabulary)
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((50, width)) < 0.05, rng.random((50, width)), 0).astype(np.float32)
    row, col = np.nonzero(dense)
    half = np.zeros(width * (width + 1) // 2, np.float32)
    decontam.gram_of(col.astype(np.int32), dense[row, col], np.bincount(row, minlength=50), width, half)
    assert np.allclose(half, (dense.T @ dense)[np.triu_indices(width)], atol=1e-4)


def test_lcs():
    import numpy as np

    for seed in range(20):
        r = random.Random(seed)
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 30))], [r.randrange(6) for _ in range(r.randrange(1, 40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(np.array(a), np.array(b))[0] == t[-1][-1]


# ------------------------------------------------------------------ personal data
PII = "Mail bob.x@a-b.co.uk, host 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 or 4111111111111112, call +1 (555) 123-4567, iban DE89 3704 0044 0532 0130 00; a@b, 1.2.3."


def test_pii_spans(spark):
    import re

    got = pii.pii_report(clash(docs(spark, [(1, PII, "en", "s"), (2, "é " + PII, "en", "s"), *ODD[:2]]))).orderBy("doc_id").collect()
    first = got[0] if got[0]["n_email"] else got[1]
    assert (first["n_email"], first["n_ip"], first["n_card"], first["n_phone"], first["n_iban"]) == (1, 1, 1, 1, 1)
    want = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"10\.0\.0\.1"), ("card", r"4111 1111 1111 1111"), ("phone", r"\+1 \(555\) 123-4567")):
        want += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, PII)]
    report = {r["doc_id"]: r for r in pii.pii_report(docs(spark, [(7, PII, "en", "s")])).collect()}[7]
    assert report["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and report["spans"].startswith(",".join(want))
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in pii.pii_report(docs(spark, ODD)).collect())


def test_pii_base_patterns_as_written():
    """The fast matchers against the patterns as stated, on random strings."""
    import re

    stated = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def want(t):
        for kind, p in stated.items():
            for m in re.finditer(p, t):
                d = re.findall("[0-9]", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn("".join(d)), "phone": 8 <= len(d) <= 15}[kind]
                if ok:
                    yield kind, m.start(), m.end()

    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice("ab@@..+-- ()0123456789" + "1" * 6) for _ in range(r.randrange(60)))
        assert [s for s in pii.propose(t) if s[0] != "iban"] == list(want(t)), t
    for _ in range(300):
        t = "".join(r.choice("0123456789") for _ in range(16))
        assert [s for s in pii.propose(t) if s[0] == "card"] == [s for s in want(t) if s[0] == "card"]


def test_pii_is_linear_and_redacts(spark):
    long = "a" * 300_000 + "1" * 300_000 + "." * 1000 + "+1" * 1000 + "@" * 10_000
    assert list(pii.propose(long)) == []
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, [(9, PII, "en", "s"), (1, None, None, None)])).collect()}
    assert got[1] is None and "<email>" in got[9] and "<card>" in got[9] and "bob" not in got[9] and "300.1.1.1" in got[9]


def test_scores():
    t = "my credit card is 4111111111111111"
    assert pii.score(t, "card", 18, 34) > pii.score("sample " + t[18:], "card", 7, 23)


# ------------------------------------------------------------------ mixing
def water(sizes, weights, total, cap):
    free, target = set(range(len(sizes))), {}
    while True:
        level = {i: total * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = [i for i in free if level[i] > cap * sizes[i] + 1e-9]
        if not over:
            return target | level
        for i in over:
            target[i] = cap * sizes[i]
            total -= target[i]
            free.discard(i)


def test_mixing(spark):
    rows = [(i, words(i, 5 + i % 40), "en", s) for i, s in enumerate(["a"] * 100 + ["b"] * 30 + ["c"] * 5 + [None] * 20)] + [(900, None, "en", "a"), (901, "", "en", "d")]
    d = clash(docs(spark, rows))
    got = mixing.mix(d).collect()
    names = ["a", "b", "c", "d", None]
    sizes = [sum(len((t or "").split()) for _, t, _, s in rows if s == n) for n in names]
    want = water(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes), 2.0)
    assert len(got) == len(rows)
    for i, n in enumerate(names):
        mine = [r for r in got if r["source"] == n]
        assert all(abs(r["target"] - want[i]) < 1e-5 and r["source_size"] == sizes[i] and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[i]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None, None, None)])).first()["taken"] == 0


def test_mixing_of_repeated_rows(spark):
    got = mixing.mix(docs(spark, [(1, "a b c d", "en", "s")] * 10 + [(2, words(1, 60), "en", "t")])).filter("source = 's'").collect()
    assert all(r["taken"] <= 8 for r in got) and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 10


# ------------------------------------------------------------------ long repeats
def brute_repeats(rows, length, shared):
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for n in (length, shared):
        seen = {}
        for t in texts:
            for i in range(len(t) - n + 1):
                seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
        for t in texts:
            gone = [False] * len(t)
            for j in range(len(t) - n + 1):
                if seen[t[j : j + n]] > 1:
                    gone[j : j + n] = [True] * n
            kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
            out.append((len(t), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted((i or -1, *x, y[1], y[2]) for (i, *_), x, y in zip(rows, out, out[len(rows) :], strict=False))


def repeats(df):
    return sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_shared"], r["n_passages"]) for r in df.collect())


def test_long_repeats_as_brute_force(spark):
    shared, other = words(1, 30), words(2, 40)
    rows = [
        (1, words(3, 50) + shared + words(4, 50), "en", "s"), (2, shared + words(5, 20), "en", "s"), (3, words(6, 70) + " " + other, "en", "s"), (4, other[7:] + words(7, 10) + other[:-3], "en", "s"),
        (5, "ab" * 200, "en", "s"), (6, "é" * 150 + shared[5:], "en", "s"), (7, words(8, 60), "en", "s"), (8, words(8, 60), "en", "s"), (9, words(8, 60)[:-1] + "X", "en", "s"), (10, None, "en", "s"), (11, "", "en", "s"), (12, "short", "en", "s"), (13, "short", "en", "s"),
        (None, words(9, 30) + shared[:80] + words(10, 30), "en", "s"), (None, words(11, 90), "en", "s"), (None, words(11, 90)[50:], "en", "s"), (14, words(11, 40), "en", "s"), (None, None, None, None), (15, shared[:75], "en", "s"), (15, shared[:75], "en", "s"),
    ]
    got = repeats(suffixes.without_repeats(clash(docs(spark, rows)), 100, 70))
    assert got == brute_repeats(rows, 100, 70)
    assert repeats(suffixes.without_repeats(docs(spark, rows), 100, 70, hot_rows=1)) == got
    assert repeats(suffixes.without_repeats(docs(spark, rows), 100, 100)) == brute_repeats(rows, 100, 100)
    assert suffixes.without_repeats(docs(spark, [])).count() == 0


def test_long_repeats_of_whole_table(spark, sf):
    """The query over all of a test table, against brute force."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert repeats(registry.queries()["op6_suffixes"](spark, sf)) == brute_repeats(rows, 400, suffixes.SHARED)


def test_runs_of_a_text_in_parts():
    """Parts of a very long text cut no run in two: a run of starts has one row, and every start has one."""
    import numpy as np
    import pyarrow as pa

    rows = [c for _, *cols in suffixes.anchor_runs(pa.array([words(1, 600_000, 1000)]), 400) for c in zip(*cols, strict=True)]
    assert len({(g, p) for g, p, _, _ in rows}) == len(rows)
    starts = np.sort(np.concatenate([np.arange(first, last + 1) for _, _, first, last in rows]))
    assert (starts == np.arange(5 * 600_000 - 1 - 400 + 1)).all()


def test_repeat_at_the_border_of_parts(spark):
    """Strings of 400 bytes that start just before and just at the border of parts, each again in a text of its own."""
    border = (1 << suffixes.PLACE_BITS) - 1 - 400
    long = words(1, 240_000, 1000)
    rows = [(None, long, "en", "s"), *((2 + i, words(50 + i, 60) + "#" + long[border - d : border - d + 400] + "%" + words(70 + i, 60), "en", "s") for i, d in enumerate((1, 0)))]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.without_repeats(docs(spark, rows)).collect()}
    assert got == {None: 401, 2: 400, 3: 400}


def test_refinement_of_random_groups():
    import numpy as np

    for seed in range(12):
        r = np.random.default_rng(seed)
        n, cols, lengths = 40, 30, (8, 12)
        group = np.sort(r.integers(0, 6, n))
        group = np.unique(group, return_inverse=True)[1]
        columns = r.integers(97, 99, (cols, n)).astype(np.uint8) if seed % 2 else np.repeat(r.integers(97, 99, (cols, 6)), 8, axis=1)[:, :n].astype(np.uint8)
        columns[r.integers(0, cols, 20), r.integers(0, n, 20)] = 120
        low, high = r.integers(0, 8, n), r.integers(22, cols + 1, n)
        starts = cols - max(lengths) + 1
        for length, found in zip(lengths, suffixes.refine(columns, low, high, group, lengths, starts), strict=True):
            for c in range(starts):
                for x in range(n):
                    ok = low[x] <= c and c + length <= high[x]
                    want = ok and any(y != x and group[y] == group[x] and low[y] <= c and c + length <= high[y] and (columns[c : c + length, x] == columns[c : c + length, y]).all() for y in range(n))
                    assert found[c, x] == want


# ------------------------------------------------------------------ top-k
def test_topk_as_brute_force(spark):
    import math

    r = random.Random(2)
    rows = [(i, [r.choice((-0.5, 0.25, r.uniform(-1, 1))) for _ in range(8)]) for i in range(120)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8), (504, [1.0, 1.0]), (7, None)]
    rows += [rows[3], rows[20], rows[20], (30, [1.0] * 8), (1001, [3e6] * 8), (1002, [-2e7, 1e-3] * 4), (1010, [1e6, 1e6 + 1] * 4)]

    def check(rows):
        e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
        back = [(x["vec_id"], x["embedding"]) for x in e.collect()]
        v = [(i, [math.floor(256 * x) for x in x_]) for i, x_ in back if i is not None and x_ and all(x is not None and math.isfinite(x) for x in x_)]
        want = []
        for a, (q, x) in enumerate(v):
            if q % 10 == 0:
                score = lambda y: max(-(2**63), min(2**63 - 1, sum(m * n for m, n in zip(x, y, strict=False))))  # noqa: B023, E731
                s = sorted((-score(y), c) for b, (c, y) in enumerate(v) if a != b)[:5]
                want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
        found = topk.top_k(e, 10, 5)
        assert sorted(tuple(x)[:4] for x in found.collect()) == sorted(want)

    check(rows)
    check([*rows, (1020, [1e30] * 8), (1021, [-1e35] * 8)])
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_threshold_stops_early():
    import numpy as np

    r = np.random.default_rng(1)
    v = np.floor(r.exponential(20, (4000, 3)))
    lists = topk.Lists(np.arange(4000), v)
    ids, scores, depth = lists.top(-1, np.array([3.0, 1.0, 0.0]), 5)
    s = v @ np.array([3.0, 1.0, 0.0])
    o = np.lexsort((np.arange(4000), -s))[:5]
    assert list(ids) == list(o) and depth < 4000


# ------------------------------------------------------------------ licences
def test_licences(spark):
    mit = dict((n, t) for n, t in licenses.TEMPLATES)["mit"]
    rows = [(1, words(1, 60) + "\nLicensed under the Apache License, Version 2.0.\n" + words(2, 60), "en", "s"), (2, mit, "en", "s"), (3, mit.replace(" to ", "\n to "), "en", "s"), (4, words(3, 500), "en", "s"), *ODD]
    got = {(r["doc_id"], r["line"], r["license"]) for r in licenses.scan(clash(docs(spark, rows))).collect()}
    assert got >= {(1, 2, "apache-2.0-notice"), (2, 1, "mit"), (3, 0, "mit")} and not {x for x in got if x[0] in (4, 5, 6)}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_size_bounds():
    for m in range(1, 60):
        low, high = licenses.size_bounds(m, 0.8)
        for n in range(1, 120):
            assert (low <= n <= high) == (2 * min(n, m) / (n + m) >= 0.8 - 1e-12)


# ------------------------------------------------------------------ language
def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_language(spark):
    sample = {"en": "the house and the river with this that there", "de": "das haus und der fluss mit nicht eine schön", "fr": "la maison et le fleuve avec cela être où"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(sample[x].split(), k=20)), x, "s") for i in range(300) for x in [r.choice(list(sample))]]
    odd = [(1000, None, "en", "s"), (1001, "12 34 !!", "en", "s"), (1002, "", None, None), (None, "the house", "en", "s"), (1003, "the house and " * 20000, None, "s")]
    d = clash(docs(spark, rows + odd))
    got = langid.identify(d, langid.fit(d)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(by[i]["held_out"] == (held(i, 4) == 2) for i, *_ in rows)
    out = [by[i]["lang_pred"] == x for i, _, x, _ in rows if by[i]["held_out"]]
    assert sum(out) / len(out) > 0.95
    plain = docs(spark, [(1, "\U000e0041\U000e0042", None, None), (2, "\U000f0000\ue000", None, None), (3, "\u4e00\U00030000", None, None)])
    assert [x["lang_pred"] == "und" for x in langid.identify(plain, langid.fit(d)).orderBy("doc_id").collect()] == [True, True, False]
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "en"]
    empty = docs(spark, [(1, "hello", None, None)])
    assert langid.identify(empty, langid.fit(empty)).first()["lang_pred"] == "und"
    assert langid.identify(docs(spark, []), langid.fit(docs(spark, []))).count() == 0
    assert langid.identified_only(docs(spark, rows + odd), langid.fit(d)).filter("doc_id in (1000, 1001, 1002)").count() == 0


def test_every_language_is_learnt(spark):
    rows = [(i, f"{chr(0x4e00 + i % 300) * 6} {chr(0x5e00 + i % 300) * 4}", f"l{i % 300:03d}", "s") for i in range(2400)]
    d = docs(spark, rows)
    assert langid.fit(d, max_train=100).langs == sorted({x for _, _, x, _ in rows})
    got = langid.identify(d, langid.fit(d, max_train=2400)).join(d, "doc_id").selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert got > 0.9


# ------------------------------------------------------------------ language model
def test_language_model(spark):
    import collections
    import math

    r = random.Random(4)
    pool = ["".join(r.choice("abcde") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(r.choices(pool, k=r.randrange(1, 80))), "en", "s") for i in range(200)] + [(1000, None, None, None), (1001, "", "en", "s"), (1002, "Q" * 50_000, "en", "s"), (1002, "Q" * 50_000, "en", "s"), (None, "abc abc", "en", "s"), (1003, "é Ü \x1f\xa0x", "en", "s")]
    got = lm.score(clash(docs(spark, rows))).collect()
    tokens = {i: (t or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))).split() for i, t, *_ in rows}
    count, n_docs = collections.Counter(), 0
    for i, t, *_ in rows:
        if i is not None and held(i, 5) != 1:
            count.update(tokens[i])
            n_docs += 1
    n, v = sum(count.values()) + n_docs, len(count) + 1
    z = math.log10(n + 0.5 * (v + 1))
    assert len(got) == len(rows)
    for x in got:
        t = tokens[x["doc_id"]]
        base = sum(math.log10(count[w] + 0.5) - z for w in t) + math.log10(n_docs + 0.5) - z
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t) + 1, sum(count[w] > 0 for w in t) + 1, n)
        assert abs(x["base_score"] - base) < 1e-6 and x["score"] < 0 and x["held_out"] == (x["doc_id"] is not None and held(x["doc_id"], 5) == 1)
    plain, junk = spark.createDataFrame([(2, " ".join(pool[:20])), (3, " ".join(w[::-1] + "zq" for w in pool[:20]))], "doc_id long, text string").collect()
    scored = {x["doc_id"]: x["bits_per_byte"] for x in lm.score(docs(spark, rows + [(5000, plain["text"], "en", "s"), (5001, junk["text"], "en", "s")])).collect()}
    assert scored[5000] < scored[5001]
    assert lm.score(docs(spark, [])).count() == 0 and lm.score(docs(spark, [(1, None, None, None)])).first()["n_tokens"] == 1


def fitted(spark, texts, parts, tree_words=lm.TREE_WORDS):
    d = spark.createDataFrame([(t, True) for t in texts], "text string, learn boolean").repartition(parts)
    vocab = lm.vocabulary(d, 4).persist()
    tokens = sum(len(t.split()) + 1 for t in texts)
    return lm.fit(d.select("text"), vocab, tokens, tree_words)


def test_all_training_text_is_learnt_from(spark):
    """However it is dealt: the counts and the refining table have seen every bit of every training word."""
    texts = [" ".join(f"{i * i % 971:03d}" for i in range(j, j + 300)) for j in range(0, 9000, 300)]
    one, many = fitted(spark, texts, 1), fitted(spark, texts, 7)
    assert (one.counts.plain == many.counts.plain).all() and (one.counts.states == many.counts.states).all()
    assert one.mixer.refine.sum() == many.mixer.refine.sum() == one.counts.plain.sum()


def test_scores_as_bit_by_bit(spark):
    """The model's own numbers, used by a scorer that codes one bit after another."""
    import collections
    import math

    import numpy as np

    r = random.Random(8)
    pool = ["".join(r.choice("abcdé,") for _ in range(r.randrange(1, 6))) for _ in range(150)]
    texts = [" ".join(r.choices(pool, k=r.randrange(0, 60))) for _ in range(60)]
    m = fitted(spark, texts, 3, tree_words=40)
    tree = m.tree
    assert 1 < len(tree.h) <= 41
    u32 = (1 << 32) - 1

    def mix(x):
        x = x * 0x85EBCA6B & u32
        return x ^ x >> 15

    def chained(salt, *parts):
        x = salt * 0x9E3779B1 & u32
        for p in parts:
            x = mix(x + p & u32)
        return x

    def word_hash(w):
        return int(lm.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0])

    end, code = int(lm.END_HASH), {int(h): int(x) for h, x in zip(tree.h, tree.symbol, strict=True)}

    def symbols(text):
        ws, past = [w for w in text.encode().split(b" ") if w], []
        for w in [*ws, None]:
            h = end if w is None else word_hash(w)
            one = past[-1][0] >> 32 if past else 0
            tail = past[-1][1][-1] if past else 0
            before = past[-1][1][-2] if past and len(past[-1][1]) > 1 else 0
            yield code.get(h, 0), [chained(1, one), chained(2, tail, before)]
            if w is not None and h not in code:
                for j, b in enumerate(w + b" "):
                    x = [w[j - k] if j >= k else 0x100 if j == k - 1 else 0x200 + tail if j == k - 2 else 0 for k in (1, 2, 3)]
                    total = 0
                    for i, c in enumerate(w[:j]):
                        total += int(lm.mix64(np.array([c + (i << 9)], np.uint64))[0])
                    so_far = int(lm.mix64(np.array([total & (1 << 64) - 1], np.uint64))[0]) & u32
                    yield tree.bytes_at + b, [chained(13, *x), chained(15, so_far)]
            if w is not None:
                past.append((h, w))

    def bits(text):
        for symbol, context in symbols(text):
            for s in range(tree.start[symbol], tree.start[symbol + 1]):
                node, depth = int(tree.step[s]) >> 1, s - int(tree.start[symbol])
                place = min(depth, 19) + 20 * (symbol >= tree.bytes_at)
                yield node, int(tree.step[s]) & 1, place, [mix(c ^ (node * 0x9E3779B1 & u32)) * 0xC2B2AE35 % (1 << 32) >> 32 - lm.SLOT_BITS for c in context]

    met = collections.Counter((i, s, b) for t in texts for n, b, _, slots in bits(t) for i, s in [(0, n), *enumerate(slots, 1)])
    for text in [*texts[:6], "zz abc", "", "a"]:
        total = 0.0
        for node, bit, place, slots in bits(text):
            n0, n1 = met[0, node, 0], met[0, node, 1]
            x, gate = [math.log((n1 + lm.ADDED_0) / (n0 + lm.ADDED_0))], 0
            for i, s in enumerate(slots, 1):
                state = int(lm.states(np.array([met[i, s, 0]]), np.array([met[i, s, 1]]))[0])
                assert met[i, s, 0] + met[i, s, 1] > lm.EXACT or (lm.N0[state], lm.N1[state]) == (met[i, s, 0], met[i, s, 1])
                x.append(math.log((lm.N1[state] + lm.ADDED) / (lm.N0[state] + lm.ADDED)))
                gate += 4 ** (i - 1) * int(lm.seen(lm.N0[state] + lm.N1[state]))
            w = m.mixer.by_seen[:, gate] + m.mixer.by_place[:, place]
            stretch = max(-14, min(14, sum(a * b for a, b in zip(w, x, strict=True))))
            p = 1 / (1 + math.exp(-stretch))
            n = m.mixer.refine[place, int(lm.bucket(np.array([np.float32(stretch)]))[0])]
            p = (p + (n[1] + 8 * p) / (n.sum() + 8)) / 2
            total += math.log2(p if bit else 1 - p)
        data = text.encode()
        got = m.log2p(lm.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0]
        assert abs(got - total) < 1e-3 * max(1, abs(total))


def test_tables_of_the_model_are_made_once(spark, monkeypatch):
    """However many pieces of text are scored; and each piece as it is alone."""
    import numpy as np

    texts = [words(70 + i, 30, 50) for i in range(6)]
    m, made, without = fitted(spark, texts, 1), [], lm.Counts.without
    monkeypatch.setattr(lm.Counts, "without", lambda c: made.append(1) or without(c))

    def piece(some):
        off = np.cumsum([0, *(len(t) for t in some)])
        return lm.Words(np.frombuffer("".join(some).encode(), np.uint8), off)

    assert np.allclose(m.log2p(piece(texts)), [m.log2p(piece([t]))[0] for t in texts]) and len(made) == 1


def test_codes_are_a_distribution(spark):
    """In any context the probabilities of all words with codes and the escape add up to 1, and those of all bytes."""
    import numpy as np

    m = fitted(spark, [words(i, 200, 60) for i in range(20)], 2)
    for first, last in ((0, m.tree.bytes_at), (m.tree.bytes_at, m.tree.bytes_at + 256)):
        for seed in (1, 77):
            s = object.__new__(lm.Symbols)
            s.symbol = np.arange(first, last)
            s.text = np.arange(last - first)
            s.context = [np.full(last - first, seed * i, np.uint32) for i in range(1, lm.PREDICTORS)]
            assert abs((2 ** m.coded(s, last - first)).sum() - 1) < 1e-5


def test_contexts_cross_words(spark):
    """A model of texts in which words follow each other in one order scores that order above a shuffled one."""
    import numpy as np

    ws = [f"w{i}" for i in range(40)]
    m = fitted(spark, [" ".join(ws[i:] + ws[:i]) for i in range(40)], 3)
    both = [" ".join(ws), " ".join(random.Random(3).sample(ws, 40))]
    ordered, shuffled = (m.log2p(lm.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))[0] for t in both)
    assert ordered > shuffled / 3
