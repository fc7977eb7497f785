"""Line deduplication, centroids and the Merkle manifest against plain computations."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockline.llm import centroids, lines, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, pos int, key string, `a.b` string, tree string, n long"
BLANKS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """rows of (doc_id, text, lang, source, n_chars), with further columns of clashing names."""
    return spark.createDataFrame([(*r, True, 1, 2, "k", "dot", "t", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = [f"A line that Many documents hold, number {k}" for k in range(6)] + ["ÄÖ shared line with ünïcode", "short", "", "  \t"]
    out = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else f"own line {i} {k} {'x' * rng.randint(0, 30)}" for k in range(rng.randint(1, 12))]
        parts = [rng.choice(["", " ", "\t\x0b"]) + (p.upper() if rng.random() < 0.2 and p.isascii() else p) + rng.choice(["", "\r", " "]) for p in parts]
        out.append((i, "\n".join(parts), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]) if i % 3 else "hot", rng.choice([None, 7])))
    out += [(100, None, None, "a", None), (101, "", "en", None, 0), (102, "\n\n", "en", "a", 2), (103, "word " * 40_000, "en", "b", 5), (7, out[7][1], "en", "a", 1), (7, out[7][1], "en", "a", 1), (None, out[3][1], "en", "a", 1), (None, "null id\nA line that Many documents hold, number 0", None, "hot", 1)]
    return out


def plain_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOW)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        parts = (text or "").split("\n")
        keep = [p for p in parts if len(holders.get(key(p), ())) < 3 or i == max((x for x in holders[key(p)] if x is not None), default=None)]
        out.append((i, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return out


def test_lines_against_plain_python(spark, rows):
    want = plain_lines(rows)
    docs = frame(spark, rows)
    got = [tuple(r) for r in lines.kept_texts(docs).collect()]
    assert Counter(got) == Counter(want)
    assert sum(n for _, _, n, _ in want) > 50
    told = [tuple(r) for r in lines.digest(docs).collect()]
    assert Counter(told) == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    kept = lines.dedup_lines(docs)
    assert kept.schema.names == docs.schema.names
    assert Counter((r["doc_id"], r["text"], r["source"], r["a.b"]) for r in kept.collect()) == Counter((w[0], w[3], r[3], "dot") for w, r in zip(want, rows, strict=True))
    assert lines.digest(docs.limit(0)).collect() == []


def test_a_line_in_very_many_documents(spark):
    """Past the size from which a key is common, and with all copies of one text."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("This very line is in all documents\nown line of a document "), F.col("id").cast("string"), F.lit("\ntail")).alias("text"))
    got = lines.digest(docs).groupBy("n_lines", "n_dropped").count().collect()
    assert {tuple(r) for r in got} == {(3, 1, 3999), (3, 0, 1)}


def plain_means(vectors, k, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=rank)[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, near, strict=True))


def test_centroids_against_plain_python(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(5, 64))
    vectors = [(i, (middles[i % 5] + rng.normal(size=64) * 0.3).tolist()) for i in range(120)]
    vectors += [(200 + k, vectors[0][1]) for k in range(60)]  # a hot group of copies
    vectors += [(1, vectors[4][1]), (None, vectors[2][1]), (None, vectors[3][1]), (1, vectors[4][1])]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [math.nan] + [1.0] * 63), (305, [math.inf] * 64), (306, [1.0] * 65)]
    kind = "vec_id long, embedding array<double>, cluster string, v int"
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors + bad], kind)
    for k, rounds in ((16, 3), (3, 1), (500, 2), (4, 0)):
        got = Counter(tuple(r) for r in centroids.cluster(df, k, rounds).collect())
        assert got == plain_means(vectors, k, rounds)
    assert centroids.cluster(df.limit(0)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(*r, "x", 1) for r in bad], kind)).collect() == []
    same = spark.createDataFrame([(i, [0.5] * 64, "x", 1) for i in range(40)], kind)  # all centroids tie; all but the first are empty
    assert {(r["cluster"], r["distance"]) for r in centroids.cluster(same).collect()} == {(0, 0)}


def test_dot_products_follow_moved_components_alone(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-100, 100, size=(50, 8))
    before, after = rng.integers(-9, 9, size=(3, 8)), None
    after = before.copy()
    after[1, [2, 5]] += 7
    state = spark.createDataFrame([(i, x.tolist(), (v[i] @ before.T).tolist()) for i, x in enumerate(v)], "vec_id long, v array<int>, dots array<long>")
    for r in centroids.assign(state, before, after).collect():
        assert r["dots"] == (v[r["vec_id"]] @ after.T).tolist()
        assert r["distance"] == ((v[r["vec_id"]] - after[r["cluster"]]) ** 2).sum()


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, p):
    out = []
    for level in levels[:-1]:
        a = p - p % 3
        out.append(("".join(level[a:p]), "".join(level[p + 1 : a + 3])))
        p //= 3
    return out


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, text, lang, source, n: H(*map(field, (i, source, lang, n, text)))
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and zlib.crc32(str("" if i is None else i).encode()) % 2 == 0 else text
        groups[source].append(((i is not None, i or 0), leaf(i, text, lang, source, n), leaf(i, cut, lang, source, n), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for p, (_, own, used, i) in enumerate(sorted(groups[s])):
            path = plain_path(trees[s], p) + plain_path(top, k)
            value = used
            for a, b in path:
                value = H(a, value, b)
            out.append((i, own, trees[s][-1][0], top[-1][0], H(*(a + b for a, b in path)), value, value == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_plain_python(spark, rows, height):
    docs = frame(spark, rows)
    tree = merkle.manifest(docs, height)
    got = Counter(tuple(r) for r in merkle.proofs(tree).collect())
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}
    # A version's last copied node is its root; it copies one node per level.
    roots = {r["doc_id"]: r["node"] for r in merkle.versions(tree).orderBy("level").collect() if r["doc_id"] is not None}
    folded = {r[0]: r[5] for r in got if not r[6] and r[0] is not None}
    assert folded.items() <= roots.items()


def test_manifest_of_many_sources_one_row_and_none(spark):
    many = [(i, f"t\n{i}", "en", f"source {i:03}", 1) for i in range(40)]
    for rows in (many, many[:1], [(5, None, None, None, None)], [(5, "x\ny", None, None, None)] * 10):
        assert Counter(tuple(r) for r in merkle.proofs(merkle.manifest(frame(spark, rows), 2)).collect()) == plain_manifest(rows)
    assert merkle.digest(frame(spark, many).limit(0)).collect() == []
