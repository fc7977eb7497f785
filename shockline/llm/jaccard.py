"""Similarity join on word n-grams by vertical partitioning.

The n-grams of all documents have one global order: by frequency class, then by
hash.  Frequencies are counted by fragments of the hash space.  A document that
could have a partner has enough n-grams that occur elsewhere; the others are
done.  Two documents at the threshold share one of the rarest n-grams of their
prefixes, which gives the candidates.  The order is cut into fragments, the
overlap of a pair is counted in each, and the counts are summed per pair.

Documents with the same set are one node, held by one row.  Among many that share a prefix
n-gram only links between different components matter: first each document is
compared with two of its largest group, then a few leaders of each group with
all others; the components are found, and what is still apart goes on with more
leaders, until nothing is left to compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.blocks import open_block, write_blocks
from shockline.llm.shared import components, cut, join_facts
from shockline.llm.text import mix, shingles, slices, words

LEVELS = 16


def keys_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of the hash space, and 32 bits within it: a key to count by."""
    fragment = ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    return (fragment << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def block_sets(offsets: bytes, size: int, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sets side by side, and their edges."""
    sets = []
    for run in open_block(offsets, size, data):
        w = words(run, lower=True)
        sets += [shingles(w.hash[a:b], n) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    edges = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=edges[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), edges


def count_fragment(part: pd.DataFrame) -> pd.DataFrame:
    """For the rows of a fragment (one per block): the frequency class of each of the row's keys; class 0 occurs once."""
    keys = [np.frombuffer(k, np.uint32) for k in part["keys"]]
    counts = np.concatenate([np.frombuffer(c, np.uint16) for c in part["counts"]])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(found))
    level = np.minimum(np.ceil(np.log2(total)), LEVELS - 1).astype(np.uint8)[inverse]
    edges = np.cumsum([0, *map(len, keys)])
    packed = [pa.compress(level[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame({"block": part["block"], "fragment": part["fragment"], "n": np.diff(edges), "levels": packed})


SIGNS = "doc_id long, text_hash string, m long, set_hash string, block long"


def sign(s: np.ndarray) -> str:
    """Size and a 128-bit hash of a set."""
    one, two = mix(s), mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return f"{len(s):x}-{int(one.sum(dtype=np.uint64)):016x}{int(two.sum(dtype=np.uint64)):016x}"


def signatures(blocks: DataFrame, n: int) -> DataFrame:
    """SIGNS of every row: the MD5 of its text, the size of its set, the set's hash, and the block that holds it."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, edges = block_sets(row["offsets"], row["size"], row["data"], n)
                signs = [sign(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                texts = [hashlib.md5(run.data[a:b].tobytes()).hexdigest() for run in open_block(row["offsets"], row["size"], row["data"]) for a, b in zip(run.offsets[:-1], run.offsets[1:], strict=True)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(texts, pa.string()), pa.array(np.diff(edges), pa.int64()), pa.array(signs, pa.string()), pa.array([row["block"]] * len(signs), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SIGNS.split(", ")])

    return cut(blocks.mapInArrow(mapped, SIGNS))


NODES = "doc_id long, m long, weight double, prefix array<long>, segments array<struct<f:int,t:array<long>>>"


def profiles(blocks: DataFrame, reps: DataFrame, n: int, percent: int, per_fragment: int = 1_500_000) -> DataFrame:
    """NODES of the sets in reps (node, set_hash, block) that may have a partner, each of the one row in that block;
    doc_id is the node.  The mean frequency class of its n-grams, those of the prefix that occur elsewhere and, by
    fragments of the global order, all that occur elsewhere."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("size").alias("s")).collect()[0]["s"] or 0
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (6 * per_fragment)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, _ = block_sets(row["offsets"], row["size"], row["data"], n)
                keys, counts = np.unique(keys_of(flat, fragments), return_counts=True)
                where = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
                low, counts = keys.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
                pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                cols = [
                    pa.array([int(where[a]) for a, _ in pairs], pa.int64()),
                    pa.array([row["block"]] * len(pairs), pa.int64()),
                    pa.array([low[a:b].tobytes() for a, b in pairs], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in pairs], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["fragment", "block", "keys", "counts"])

    spread = blocks.mapInArrow(grams, "fragment long, block long, keys binary, counts binary")
    levels = spread.groupBy("fragment").applyInPandas(count_fragment, "block long, fragment long, n long, levels binary")
    per_block = levels.groupBy("block").agg(F.collect_list(F.struct("fragment", "n", "levels")).alias("levels"))
    wanted = reps.groupBy("block").agg(F.collect_list(F.struct("node", "set_hash")).alias("wanted"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, edges = block_sets(row["offsets"], row["size"], row["data"], n)
                parts = sorted(row["levels"] or [], key=lambda p: p["fragment"])
                level = np.concatenate([np.frombuffer(pa.decompress(p["levels"], decompressed_size=p["n"], codec="zstd", asbytes=True), np.uint8) for p in parts] or [np.zeros(0, np.uint8)])
                _, inverse = np.unique(keys_of(flat, fragments), return_inverse=True)
                level = level[inverse]
                wanted = {r["set_hash"]: r["node"] for r in row["wanted"]}
                rows: list[tuple] = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    m, lv = b - a, level[a:b]
                    least = -(-percent * m // 100)
                    if not m or (lv > 0).sum() < least or (node := wanted.pop(sign(flat[a:b]), None)) is None:
                        continue
                    order = np.lexsort((flat[a:b], lv))
                    tokens, lv = flat[a:b][order], lv[order]
                    rare, weight = int((lv == 0).sum()), float(lv.mean())
                    prefix = tokens[rare : max(rare, m - least + 1)].view(np.int64).tolist()
                    tokens, lv = tokens[rare:], lv[rare:]
                    f = lv.astype(np.int64) * 4 + (tokens >> np.uint64(62)).astype(np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(f)) + 1).tolist(), len(f)]
                    segments = [{"f": int(f[c]), "t": tokens[c:d].view(np.int64).tolist()} for c, d in zip(cuts[:-1], cuts[1:], strict=True)]
                    rows.append((node, m, weight, prefix, segments))
                segment = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.list_(pa.int64()))]))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), segment]
                for k in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000], strict=True), types, strict=True)], [c.split()[0] for c in NODES.split(", ", 4)])

    joined = blocks.join(per_block.join(wanted, "block"), "block").select("offsets", "size", "data", "levels", "wanted")
    return cut(joined.mapInArrow(place, NODES))


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, common: partial overlaps per fragment of the order, summed per pair."""
    a, b = (segments.select(F.col("doc_id").alias(k), "f", F.col("t").alias("t" + k)) for k in "ab")
    met = pairs.join(a, "a").join(b, ["b", "f"])
    partial = met.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("common"))


def met_by_gram(x: DataFrame, y: DataFrame, parts: int = 32) -> DataFrame:
    """x joined with y by gram; x is small, and rows of y with a common gram are dealt out over parts."""
    plain = x.where("not common").drop("common").join(y.where("not common").drop("common"), "gram")
    xs = x.where("common").drop("common").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    ys = y.where("common").drop("common").withColumn("part", F.pmod(F.xxhash64("y_doc_id"), F.lit(parts)).cast("int"))
    return plain.unionByName(xs.join(ys, ["gram", "part"]).drop("part"))


def links(nodes: DataFrame, percent: int, first_leaders: int = 2, max_rounds: int = 40) -> DataFrame:
    """(a, b) links that give the components of all links between nodes (doc_id, m, weight, prefix, segments)."""
    segments = nodes.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.f", "s.t")
    sizes = nodes.select("doc_id", "m")
    index = nodes.select("doc_id", "m", "weight", F.posexplode("prefix").alias("pos", "gram"), F.size("prefix").alias("np"))
    # Places count from the prefix's end, as n-grams that occur once were left out before it.
    index = index.select("gram", "doc_id", "m", "weight", (F.col("np") - F.col("pos")).alias("left"))
    # What copies of a text have in common is common, and what each changed is not: the text itself, if it is there, has
    # the n-grams of the highest frequency classes, and its copies are nearer to it than to each other.
    centre = F.max(F.struct("weight", "doc_id"))["doc_id"].alias("centre")
    facts = cut(index.groupBy("gram").agg(F.count("*").alias("k"), F.min("doc_id").alias("low"), centre).where("k > 1"))
    index = cut(join_facts(index, facts, "gram", "k").drop("common", "weight"))

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (sizes.select(F.col("doc_id").alias(k), F.col("m").alias("m" + k)) for k in "ab")
        got = overlaps(pairs, segments).join(a, "a").join(b, "b")
        return cut(got.where(f"100 * common >= {percent} * (ma + mb - common)").select("a", "b"))

    # Most of a large group is found by comparing each document with two others of its most common prefix n-gram.
    star = index.groupBy("doc_id").agg(F.max(F.struct("k", "gram", "low", "centre")).alias("s"))
    star = star.select("doc_id", F.explode(F.array("s.low", "s.centre")).alias("other")).where("doc_id <> other")
    found = linked(star.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct())
    comp = components(found)
    index = index.drop("k", "low", "centre")
    for r in range(max_rounds):
        at = index.join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        at = cut(at.withColumn("comp", F.coalesce("component", "doc_id")).drop("component"))
        groups = at.groupBy("gram", "comp").agg(F.count("*").alias("k"))
        groups = groups.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("big"), F.sum("k").alias("members"), F.count("*").alias("comps"))
        groups = cut(groups.where("comps > 1").select("gram", "members", F.col("big.comp").alias("big"), (F.col("members") - F.col("big.k")).alias("minor")))
        chance = F.lit(float(first_leaders * 4**r)) / F.col("minor")
        spread = F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
        open_ = join_facts(at, groups, "gram", "members").withColumn("lead", (F.col("comp") != F.col("big")) & (spread < chance)).drop("big", "minor", "members")
        open_ = cut(open_)
        if open_.isEmpty():
            break
        x = open_.where("lead").select("gram", "common", *(F.col(c).alias("x_" + c) for c in ("doc_id", "m", "left", "comp")))
        y = open_.select("gram", "common", *(F.col(c).alias("y_" + c) for c in ("doc_id", "m", "left", "comp", "lead")))
        met = met_by_gram(x, y).where("x_comp <> y_comp and (not y_lead or x_doc_id < y_doc_id)")
        met = met.where(f"100 * least(x_m, y_m) >= {percent} * greatest(x_m, y_m)")
        # At the first n-gram two prefixes share, no more than what follows in both can be common.
        # ``left`` n-grams of the prefix from this one on, and ceil(percent * m / 100) - 1 after the prefix.
        rest = lambda k: f"({k}_left + ({percent} * {k}_m + 99) div 100 - 1)"
        met = met.where(f"(100 + {percent}) * least({rest('x')}, {rest('y')}) >= {percent} * (x_m + y_m)")
        pairs = met.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()
        found = found.unionByName(linked(pairs))
        comp = components(found)
        index = open_.where("not lead").select("gram", "doc_id", "m", "left")
    else:
        raise RuntimeError(f"candidates were left after {max_rounds} rounds")
    return found


def classes(every: DataFrame, blocks: DataFrame, n: int, percent: int, merge_ids: bool) -> tuple[DataFrame, DataFrame]:
    """reps (set_hash, node, rep: the smallest doc_id, block) of the sets that aren't empty, and (node, root) of those
    linked with another; with ``merge_ids`` sets of one doc_id count as linked."""
    some = every.where("m > 0 and doc_id is not null")
    # A node is a set, taken from one row: of the smallest doc_id, in its first block.
    reps = some.groupBy("set_hash").agg(F.min(F.struct("doc_id", "block")).alias("r")).select("set_hash", F.col("r.doc_id").alias("rep"), F.col("r.block").alias("block"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))  # written, so that a set keeps its number
    found = links(profiles(blocks, reps, n, percent), percent)
    if merge_ids:
        ids = some.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).where("a <> b").select("doc_id")
        mixed = some.join(ids, "doc_id").join(reps.select("set_hash", F.col("node").alias("b")), "set_hash").select("doc_id", "b").distinct()
        same = mixed.join(mixed.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a <> b").select("a", "b")
        found = found.unionByName(same)
    return reps, components(found).select(F.col("id").alias("node"), F.col("component").alias("root"))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; further columns are ignored).

    A document's set: the distinct n-word shingles of its whole text with A-Z in
    lower case; with fewer words, the sequence as one; a null or blank text has
    none and links with nothing.  Two documents link when the intersection is at
    least ``percent`` hundredths of the union; component_id is the smallest
    doc_id reachable.  Repeated rows link with each other; a null doc_id is in
    no component (null), and rows of one id are one document, also where their
    texts differ.  An empty table gives no rows.  Shingles are told apart by
    64-bit hashes, sets by 128 bits.
    """
    blocks = write_blocks(docs)
    every = signatures(blocks, n)
    reps, comp = classes(every, blocks, n, percent, merge_ids=True)
    of = reps.select("set_hash", "node", "rep").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("rep").alias("component"))
    named = of.join(least, "root").select("set_hash", "component")
    out = every.select("doc_id", "m", "set_hash").join(named, "set_hash", "left")
    component = F.when((F.col("m") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("m").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group of near copies.

    First by doc_id, then by hashes of set and text.  Rows that repeat doc_id
    and text are one; texts of one doc_id that are no near copies each stay.
    Rows with a null doc_id, and blank texts, stay.
    """
    blocks = write_blocks(docs)
    every = signatures(blocks, n)
    reps, comp = classes(every, blocks, n, percent, merge_ids=False)
    roots = reps.select("set_hash", "node").join(comp, "node", "left").select("set_hash", F.coalesce("root", "node").alias("root"))
    some = every.where("doc_id is not null and m > 0").groupBy("set_hash").agg(F.min(F.struct("doc_id", "set_hash", "text_hash")).alias("first"))
    first = some.join(roots, "set_hash").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    blank = every.where("doc_id is not null and m = 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = cut(first.unionByName(blank).distinct())
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    keyed = keyed.withColumn("id", F.col("doc.doc_id")).withColumn("hash", F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")))
    once = keyed.join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return once.unionByName(keyed.where("id is null")).select(*(F.col(f"doc.`{c}`") for c in docs.columns))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS m FROM s),
t AS (SELECT doc_id, len(sh)::BIGINT AS m, unnest(list_transform(sh, lambda x: hash(x))) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.m AS ma, y.m AS mb, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id AND 10 * x.m >= 8 * y.m AND 10 * y.m >= 8 * x.m GROUP BY ALL),
k AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (ma + mb - c)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.m AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.m
"""
