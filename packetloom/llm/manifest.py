"""Merkle manifest of a dataset: Pregel-style supersteps over RDDs carry hashes up to the root and sibling paths down."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import written

#: A vertex holds the nodes below one ancestor so many levels up, so that a superstep covers so many levels.
STEP_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A vertex: its group, its number in its superstep, and its nodes in order.
BLOCK = "g long, block long, nodes array<string>"
#: What comes down: for each level a side and a digest: L or R for a sibling to the left or right, N for none.
PATH = "g long, block long, path array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """sha256 of the values, each its number of UTF-8 bytes, a colon and itself, or - if null."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in as_text]), 256)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with its place in its group (from 0, nulls first) and the group's number of rows, ``name`` and ``name``_of.

    Rows are sorted over all partitions; a group's rows in a partition follow those in the partitions before,
    so only sums by group and partition are windowed: a group of any size costs a window row a partition.
    Equal rows are told apart by where they were read, so that copies of one row can be split.
    """
    d = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*group, *order, "__tie"]]
    d = d.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by).sortWithinPartitions(*by)
    d = d.withColumn("__at", F.monotonically_increasing_id()).drop("__tie")
    d = written(d.withColumns({"__part": F.shiftright("__at", 33), "__g": F.coalesce(F.to_json(F.array(*[F.col(c).cast("string") for c in group])) if group else F.lit(""), F.lit(""))}), "manifest_sorted")
    sums = d.groupBy("__g", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    w = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__g", "__part", "__from", before.alias("__before"), F.sum("__n").over(w).alias(f"{name}_of"))
    d = d.join(written(sums, "manifest_offsets"), ["__g", "__part"])
    return d.withColumn(name, F.col("__before") + F.col("__at") - F.col("__from")).drop("__g", "__part", "__at", "__from", "__before")


# ------------------------------------------------------------------ vertices
def heights(n: int) -> int:
    """Levels above n leaves: folds by two until one node is left."""
    return (n - 1).bit_length()


def over(n: int, bits: int) -> int:
    """Nodes so many levels above n leaves."""
    return -(-n >> bits)


def folded(nodes: list[str], levels: int) -> list[list[str]]:
    """The block's levels from its leaves up, ``levels`` folds of every two nodes (the last may be one)."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """The path of leaf i inside its block, from below: side and digest for each fold."""
    out = []
    for now in levels[:-1]:
        j = i ^ 1
        out.append(("L" if j < i else "R") + now[j] if j < len(now) else "N")
        i >>= 1
    return out


def climbed(leaf: str, path: list[str]) -> str:
    for step in path:
        leaf = digest(step[1:], leaf) if step[0] == "L" else digest(leaf, step[1:])
    return leaf


def proof(path: list[str]) -> str:
    """The hash of all siblings from the leaf's level to the root's; digests of one fold stand left to right."""
    return digest(*[p[1:] for p in path])


def lifts(n: int, step: int, bits: int) -> int:
    """Folds that blocks of superstep ``step`` make, of a group of n leaves."""
    return max(0, min(bits, heights(n) - step * bits))


# ------------------------------------------------------------------ supersteps
def climb(blocks: DataFrame, counts: DataFrame, most: int, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each superstep, (g, root)) from blocks of leaves (g, block, nodes); counts: (g, n).

    In a superstep every vertex whose children are all there folds them and messages its parent; a vertex of a
    group whose only block is done keeps its root. Each superstep's vertices are written to the shared
    folder, so a lost executor repeats one superstep.
    """
    spark = blocks.sparkSession
    steps, roots = [blocks], []
    for s in range(max(1, -(-heights(most) // bits))):

        def send(rows: Iterable[Row], s: int = s) -> Iterator[tuple[int, int, int, str, int]]:
            for r in rows:
                up = folded(r["nodes"], lifts(r["n"], s, bits))[-1]
                assert len(up) == 1, "a block folds to one node"
                yield r["g"], r["block"] >> bits, r["block"] & ((1 << bits) - 1), up[0], r["n"]

        said = steps[-1].join(counts, "g").rdd.mapPartitions(send)
        said = written(spark.createDataFrame(said, "g long, parent long, child int, hash string, n long"), "manifest_messages")
        done = F.col("n") <= 1 << (bits * (s + 1))
        roots.append(said.filter(done).select("g", F.col("hash").alias("root")))
        if most <= 1 << (bits * (s + 1)):
            break

        def gather(x: tuple[tuple[int, int], Iterable[tuple[int, str, int]]], s: int = s) -> tuple[int, int, list[str]]:
            (g, parent), got = x
            kids = sorted(got)
            want = min(1 << bits, over(kids[0][2], bits * (s + 1)) - (parent << bits))
            if len(kids) != want or any(k[0] != i for i, k in enumerate(kids)):
                raise ValueError(f"vertex {(g, s + 1, parent)} is not complete: {len(kids)} of {want} children")
            return g, parent, [h for _, h, _ in kids]

        up = said.filter(~done).rdd.map(lambda r: ((r["g"], r["parent"]), (r["child"], r["hash"], r["n"])))
        parts = max(1, min(4 * up.getNumPartitions(), over(most, bits * (s + 2))))
        steps.append(written(spark.createDataFrame(up.groupByKey(parts).map(gather), BLOCK), "manifest_vertices"))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return steps, found


def descend(steps: list[DataFrame], counts: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(g, block, path): the path above every block of leaves; ``above``: (g, path) above each group's root.

    Reverse supersteps: a vertex knows its own path and sends each child its siblings in front of it.
    Groups of fewer supersteps join in where their only block is.
    """
    spark = above.sparkSession
    down = None
    for s in range(len(steps) - 1, 0, -1):
        top = counts.filter((F.col("n") > 1 << (bits * s)) & (F.col("n") <= 1 << (bits * (s + 1))))
        mine = above.join(top.select("g"), "g", "left_semi").select("g", F.lit(0).cast("long").alias("block"), "path")
        mine = mine if down is None else mine.unionByName(down)

        def send(rows: Iterable[Row], s: int = s) -> Iterator[tuple[int, int, list[str]]]:
            for r in rows:
                levels = folded(r["nodes"], lifts(r["n"], s, bits))
                for i in range(len(r["nodes"])):
                    yield r["g"], (r["block"] << bits) + i, siblings(levels, i) + r["path"]

        told = steps[s].join(counts, "g").join(mine, ["g", "block"]).rdd.mapPartitions(send)
        down = written(spark.createDataFrame(told, PATH), "manifest_paths")
    low = counts.filter(F.col("n") <= 1 << bits)
    mine = above.join(low.select("g"), "g", "left_semi").select("g", F.lit(0).cast("long").alias("block"), "path")
    return mine if down is None else mine.unionByName(down)


def blocks_of(rows: DataFrame, bits: int, *carried: str) -> DataFrame:
    """Rows (g, at, ...) as blocks (g, block, rows): at most 2**bits rows each, in order."""
    one = F.struct("at", *carried)
    return rows.groupBy("g", F.shiftright("at", bits).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("rows"))


VERIFIED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(docs: DataFrame, tampered: Column | None = None, n_chars: Column | None = None, bits: int = STEP_BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A row's leaf hashes doc_id, source, lang, n_chars and text. Leaves of a language ascend by doc_id (null first,
    ties by leaf) and every two become one node until one is left, the subroot; subroots in the order of languages
    (null first, bytewise) become the root alike. folded_root is folded from the leaf of the row as given with
    ``n_chars`` where ``tampered`` holds, else from the leaf itself, along the original siblings; ``verified`` says
    whether it is the root. Texts are hashed where they are read and never move. A language, and the number of
    languages, may be of any size: leaves are sorted over all partitions and held by blocks of 2**bits. Repeated
    rows have a leaf each; other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(*[docs[c].alias(c) for c in FIELDS])
    cols = [F.col(c) for c in FIELDS]
    leaf = leaf_hash(*cols)
    changed = [n_chars if c == "n_chars" and n_chars is not None else F.col(c) for c in FIELDS]
    odd = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(*changed)) if tampered is not None else F.lit(None).cast("string")
    hashed = d.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), odd.alias("odd"))
    # Written first: to find the bounds of its ranges a sort reads its input once more, and texts should be read once.
    hashed = ranked(written(hashed, "manifest_hashed"), ["lang"], ["doc_id", "leaf"], "at")

    langs = hashed.groupBy("lang").agg(F.max("at_of").alias("n"))
    langs = written(ranked(langs, [], ["lang"], "g").drop("g_of"), "manifest_groups")
    most, n_langs = langs.agg(F.max("n"), F.count(F.lit(1))).first()
    if not n_langs:
        return spark.createDataFrame([], VERIFIED)
    rows = hashed.join(langs.drop("n"), hashed["lang"].eqNullSafe(langs["lang"])).select("g", "at", "doc_id", "leaf", "odd")
    base = written(blocks_of(rows, bits, "doc_id", "leaf", "odd"), "manifest_leaves")
    counts = langs.select("g", "n")
    steps, roots = climb(base.select("g", "block", F.col("rows.leaf").alias("nodes")), counts, most, bits)
    roots = written(roots, "manifest_roots")

    of_langs = spark.createDataFrame([(0, n_langs)], "g long, n long")
    top_rows = roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.col("root").alias("leaf"))
    top = written(blocks_of(top_rows, bits, "leaf"), "manifest_top")
    top_steps, top_root = climb(top.select("g", "block", F.col("rows.leaf").alias("nodes")), of_langs, n_langs, bits)
    root = top_root.first()["root"]
    start = spark.createDataFrame([(0, [])], "g long, path array<string>")
    over = descend(top_steps, of_langs, start, bits)

    def of_subroots(rows: Iterable[Row]) -> Iterator[tuple[int, str, list[str]]]:
        for r in rows:
            nodes = [x["leaf"] for x in r["rows"]]
            levels = folded(nodes, lifts(n_langs, 0, bits))
            for i, x in enumerate(r["rows"]):
                yield x["at"], nodes[i], siblings(levels, i) + r["path"]

    above = spark.createDataFrame(top.join(over, ["g", "block"]).rdd.mapPartitions(of_subroots), "g long, subroot string, path array<string>")
    above = written(above, "manifest_above")
    paths = descend(steps, counts, above.select("g", "path"), bits)

    def of_leaves(rows: Iterable[Row]) -> Iterator[tuple]:
        for r in rows:
            levels = folded([x["leaf"] for x in r["rows"]], lifts(r["n"], 0, bits))
            for i, x in enumerate(r["rows"]):
                path = siblings(levels, i) + r["path"]
                found = climbed(x["odd"] or x["leaf"], path)
                yield x["doc_id"], x["leaf"], r["subroot"], root, proof(path), found, found == root

    whole = base.join(counts, "g").join(above.select("g", "subroot"), "g").join(paths, ["g", "block"])
    return spark.createDataFrame(whole.rdd.mapPartitions(of_leaves), VERIFIED)


def report(docs: DataFrame) -> DataFrame:
    """``verified`` with n_chars one more where 7 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0
    return verified(docs, hit, F.col("n_chars") + 1)


ORACLE = r"""
WITH RECURSIVE crc_bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
d AS (SELECT *, n_chars + (CASE WHEN xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 7 = 0 THEN 1 ELSE 0 END) AS odd_chars
      FROM documents, crc_table),
h AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(odd_chars::VARCHAR) || ':' || odd_chars, '-') || tail) AS odd
      FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
up(lang, lvl, hs) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM p GROUP BY lang
                      UNION ALL SELECT lang, lvl + 1, [sha256(hs[2 * i - 1] || coalesce(hs[2 * i], '')) for i in range(1, (len(hs) + 1) // 2 + 1)] FROM up WHERE len(hs) > 1),
sub AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up WHERE len(hs) = 1),
top(lvl, hs) AS (SELECT 0, list(subroot ORDER BY place) FROM sub
                 UNION ALL SELECT lvl + 1, [sha256(hs[2 * i - 1] || coalesce(hs[2 * i], '')) for i in range(1, (len(hs) + 1) // 2 + 1)] FROM top WHERE len(hs) > 1),
low AS (SELECT p.doc_id, p.lang, p.pos, list(CASE WHEN (p.pos >> lvl) & 1 = 1 THEN 'L' || hs[p.pos >> lvl] WHEN hs[(p.pos >> lvl) + 2] IS NULL THEN 'N' ELSE 'R' || hs[(p.pos >> lvl) + 2] END ORDER BY lvl) AS path
        FROM p JOIN up ON p.lang IS NOT DISTINCT FROM up.lang AND len(hs) > 1 GROUP BY ALL),
high AS (SELECT sub.lang, list(CASE WHEN (place >> lvl) & 1 = 1 THEN 'L' || hs[place >> lvl] WHEN hs[(place >> lvl) + 2] IS NULL THEN 'N' ELSE 'R' || hs[(place >> lvl) + 2] END ORDER BY lvl) AS path
         FROM sub JOIN top ON len(hs) > 1 GROUP BY sub.lang),
w AS (SELECT p.doc_id, p.leaf, p.odd, sub.subroot, (SELECT hs[1] FROM top WHERE len(hs) = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
      FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN low ON low.lang IS NOT DISTINCT FROM p.lang AND low.pos = p.pos LEFT JOIN high ON high.lang IS NOT DISTINCT FROM p.lang),
f AS (SELECT *, list_reduce(list_prepend(odd, path), lambda a, b: CASE b[1] WHEN 'L' THEN sha256(b[2:] || a) ELSE sha256(a || b[2:]) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] for x in path], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
