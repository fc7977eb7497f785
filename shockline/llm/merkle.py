"""Merkle manifest of a dataset as a persistent, path-copying tree.

Every row is a leaf; the leaves of a source make a tree of runs of three, and
the sources' roots make one more.  The trees are cut into aligned blocks of
3**6 nodes, so a block is built in one task and its root is a leaf of the next
blocks.  A changed leaf makes a version of the tree that copies the leaf's
ancestors alone and shares all other nodes: within its block from the block's
nodes, and above it along the block's own path, which was handed down from the
root and serves all versions of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockline.llm.shared import crc_of, cut

WIDTH = 3
#: Levels that a block holds.
HEIGHT = 6


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """Levels above a block's nodes: ``height`` of them, or up to the root if it is the only block of its tree of n."""
    levels = [nodes]
    while len(levels[-1]) > 1 if n <= WIDTH**height else len(levels) <= height:
        last = levels[-1]
        levels.append([H(*last[i : i + WIDTH]) for i in range(0, len(last), WIDTH)])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Per level from the bottom: the digests before and after the node in its run, joined."""
    out = []
    for level in levels[:-1]:
        first = place - place % WIDTH
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + WIDTH])))
        place //= WIDTH
    return out


def copies(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version copies: the ancestors of its leaf, from the bottom to the root."""
    out = []
    for before, after in path:
        leaf = H(before, leaf, after)
        out.append(leaf)
    return out


def packed(path: list[tuple[str, str]]) -> str:
    return "".join(f"{before}<{after}>" for before, after in path)


def unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split("<")) for x in path.split(">")[:-1]]


def leaf_digest(text: Column) -> Column:
    """H of a document's fields, each ``-`` if null, else its bytes' number, a colon and its value."""
    field = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    fields = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*map(field, [*fields, text])).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, node, changed: the leaf of each row, and the one of its tampered form where that differs.

    ``tree`` names the source so that names sort like sources, null first.
    Where 2 divides the crc32 of doc_id, tampering deletes the line feeds.
    """
    text = F.col("text")
    tampered = (crc_of("doc_id") % 2 == 0) & text.contains("\n")
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    changed = F.when(tampered, leaf_digest(F.replace(text, F.lit("\n"), F.lit(""))))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(text).alias("node"), changed.alias("changed"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``pos`` (from 0) in the order within their tree and ``n``, the tree's rows.

    The rows are sorted by ranges over all trees, so a tree of any size lies in
    many tasks; what is summed per tree is one row per tree and task.
    """
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    parts = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    tree = Window.partitionBy("tree")
    before = F.sum("k").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("k").over(tree).alias("n"))
    found = ordered.join(parts, ["tree", "part"])
    return found.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def blocks_of(rows: DataFrame, height: int, *columns: str) -> DataFrame:
    """tree, n, block, items: at most WIDTH ** height rows each, in order, as structs of pos, node and the columns."""
    item = F.struct("pos", "node", *columns)
    block = F.expr(f"pos div {WIDTH**height}")
    return rows.groupBy("tree", "n", block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def roots_of(blocks: DataFrame, height: int) -> DataFrame:
    """tree, n, pos, node: the blocks' roots as the nodes of the level above."""
    span = WIDTH**height

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_pylist()
            roots = [grow(nodes, k, height)[-1][0] for k, nodes in zip(n, batch.column(3).to_pylist(), strict=True)]
            cols = [batch.column(0), pa.array([-(-k // span) for k in n], pa.int64()), batch.column(2), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["tree", "n", "pos", "node"])

    return blocks.select("tree", "n", "block", F.col("items.node").alias("nodes")).mapInArrow(mapped, "tree string, n long, pos long, node string")


@dataclass
class Forest:
    """Blocks of every round, from the leaves up, and each tree's root (tree, node)."""

    height: int
    rounds: list[DataFrame]
    roots: DataFrame


def build(rows: DataFrame, height: int, *columns: str) -> Forest:
    """Forest over rows(tree, pos, n, node, columns).  A lone node is its tree's root."""
    rounds, roots = [], None
    most = rows.agg(F.max("n").alias("n")).head()["n"] or 0
    while True:
        blocks = cut(blocks_of(rows, height, *columns))
        rounds.append(blocks)
        above = roots_of(blocks, height)
        most, columns = -(-most // WIDTH**height), ()
        if most <= 1:
            return Forest(height, rounds, cut((above if roots is None else above.unionByName(roots)).select("tree", "node")))
        above = cut(above)
        done = above.where("n = 1")
        roots = done if roots is None else roots.unionByName(done)
        rows = above.where("n > 1")


def paths_down(forest: Forest, starts: DataFrame) -> DataFrame:
    """tree, block, path, root: the way from each leaf block's root to the top; starts(tree, path, root) for the trees' roots.

    Goes down round by round: a block joins its own path, one row, and hands its nodes theirs.
    """
    at_root = starts.select("tree", F.lit(0).cast("long").alias("block"), "path", "root")
    found = None
    for blocks in reversed(forest.rounds):
        top = blocks.where(F.col("n") <= WIDTH**forest.height).select("tree", "block").join(at_root, ["tree", "block"])
        if found is not None:
            top = top.unionByName(found)
        if blocks is forest.rounds[0]:
            return top
        found = cut(handed_down(blocks.join(top, ["tree", "block"]), forest.height).select("tree", "block", "path", "root"))
    raise AssertionError("a forest has a round")


def handed_down(blocks: DataFrame, height: int) -> DataFrame:
    """tree, block (the node's place, which is a block below), node, label, path, root for each node of the blocks.

    ``label`` is the item's, where items have one.
    """
    label = "items.label" if "label" in blocks.schema["items"].dataType.elementType.names else "items.node"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, path, root, first, nodes, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels, k = grow(nodes, n, height), len(nodes)
                paths = [packed(siblings(levels, i)) + path for i in range(k)]
                cols = [[tree] * k, range(first, first + k), nodes, labels, paths, [root] * k]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], ["tree", "block", "node", "label", "path", "root"])

    rows = blocks.select("tree", "n", "path", "root", (F.col("block") * WIDTH**height).alias("first"), F.col("items.node").alias("nodes"), F.col(label).alias("labels"))
    return rows.mapInArrow(mapped, "tree string, block long, node string, label string, path string, root string")


@dataclass
class Manifest:
    """The written tree: leaf blocks joined with their path to the root, and the root (null without leaves)."""

    blocks: DataFrame
    root: str | None
    height: int


def manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """The tree of all rows of docs(doc_id, source, lang, n_chars, text).

    Leaves ascend by doc_id within their source, null ids first; rows that
    share an id go by their digests, and equal rows are leaves of their own.
    """
    forest = build(placed(cut(leaves(docs)), "doc_id", "node", "changed"), height, "doc_id", "changed")
    sources = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("label"), "node")
    upper = build(placed(sources, "label"), height, "label")
    root = upper.roots.head()
    none = F.lit("")
    if root is None:
        return Manifest(forest.rounds[0].withColumns({"path": none, "subroot": none}), None, height)
    tops = paths_down(upper, upper.roots.select("tree", none.alias("path"), none.alias("root")))
    starts = cut(handed_down(upper.rounds[0].join(tops, ["tree", "block"]), height).select(F.col("label").alias("tree"), "path", F.col("node").alias("root")))
    paths = paths_down(forest, starts).withColumnRenamed("root", "subroot")
    return Manifest(forest.rounds[0].join(paths, ["tree", "block"]), root["node"], height)


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(tree: Manifest) -> DataFrame:
    """PROOF per leaf: the digest of its siblings up to the root, and the root of its version.

    An untouched leaf's version is the tree itself: it shares its block's root,
    from which the block's path is folded once for all of them.
    """
    whole, height = tree.root, tree.height

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for n, path, subroot, ids, nodes, changed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels, upper = grow(nodes, n, height), unpacked(path)
                beyond = "".join(before + after for before, after in upper)
                base = ([levels[-1][0]] + copies(levels[-1][0], upper))[-1]
                for k, (id_, leaf, other) in enumerate(zip(ids, nodes, changed, strict=True)):
                    own = siblings(levels, k)
                    folded = base if other is None else ([other] + copies(other, own + upper))[-1]
                    proof = H(*(before + after for before, after in own), beyond)
                    for column, value in zip(out, (id_, leaf, subroot, whole, proof, folded, folded == whole), strict=True):
                        column.append(value)
            types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in PROOF.split(", ")])

    return _per_block(tree).mapInArrow(mapped, PROOF)


def versions(tree: Manifest) -> DataFrame:
    """doc_id, level (from 1), node: what the version of each changed leaf adds to the tree, its root last."""
    height = tree.height

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for n, path, _, ids, nodes, changed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels, upper = grow(nodes, n, height), unpacked(path)
                for k, (id_, other) in enumerate(zip(ids, changed, strict=True)):
                    if other is not None:
                        for level, node in enumerate(copies(other, siblings(levels, k) + upper), 1):
                            for column, value in zip(out, (id_, level, node), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["doc_id", "level", "node"])

    return _per_block(tree).mapInArrow(mapped, "doc_id long, level int, node string")


def _per_block(tree: Manifest) -> DataFrame:
    return tree.blocks.select("n", "path", "subroot", *(F.col(f"items.{c}").alias(c) for c in ("doc_id", "node", "changed")))


def digest(docs: DataFrame) -> DataFrame:
    """The result of op12, a row per row of docs.

    Texts are read and hashed once, and only digests are sorted and shuffled.
    Null fields count as ``-``; a null text stays null when it is tampered; a
    null doc_id has the crc32 of the empty text and comes first in its source;
    repeated rows are leaves of their own; further columns are ignored; an
    empty table gives no rows.
    """
    return proofs(manifest(docs))


def oracle(levels: int = 12, upper: int = 6) -> str:
    """SQL for ``digest``, level by level: sources of up to 3**levels rows, 3**upper sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    parts = [
        """codes AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)""",
        """crcs AS (
    SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM documents, codes)""",
        f"""l0 AS MATERIALIZED (
    SELECT coalesce('+' || source, '') AS tree, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
        {leaf("text")} AS node, CASE WHEN crc % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS used FROM crcs)""",
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (n + 2) // 3 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 3, n)")

    climb("l", levels)
    tops = " UNION ALL ".join(f"SELECT tree, node FROM l{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"u0 AS MATERIALIZED (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, node FROM ({tops}))")
    climb("u", upper)
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT node FROM u{k} WHERE n = 1" for k in range(upper + 1)) + ")")
    parts.append("t0 AS (SELECT l.doc_id, l.tree, l.node AS leaf, l.pos, '' AS proof, l.used AS fold, u.node AS subroot, u.pos AS upos FROM l0 l JOIN u0 u ON u.source = l.tree)")
    last = "t0"

    def rise(name: str, tree: str, pos: str, k: int, new: str, old: str) -> None:
        parts.append(
            f"""{new} AS MATERIALIZED (
    SELECT t.* REPLACE (t.{pos} // 3 AS {pos}, proof || coalesce(s.b || s.a, '') AS proof, CASE WHEN s.b IS NULL THEN fold ELSE sha256(s.b || fold || s.a) END AS fold)
    FROM {old} t LEFT JOIN (
        SELECT x.tree, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS b, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS a
        FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.tree, x.pos) s ON s.tree = {tree} AND s.pos = t.{pos})"""
        )

    for k in range(levels):
        rise("l", "t.tree", "pos", k, f"t{k + 1}", last)
        last = f"t{k + 1}"
    for k in range(upper):
        rise("u", "''", "upos", k, f"v{k}", last)
        last = f"v{k}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.node AS verified FROM {last}, root r"
