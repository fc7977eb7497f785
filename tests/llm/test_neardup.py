"""Near-duplicate vectors with planted pairs, buckets of several blocks and signatures of more than four bits."""

import numpy as np

from shockline.llm import neardup


def planted(seed, n_far, groups, dim=32):
    """Unlike vectors, near copies of some of them, and groups of vectors about one middle, at cosines on both sides of 0.95."""
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((n_far, dim))]
    near = parts[0][: n_far // 8]
    parts.append(near + 0.3 * np.linalg.norm(near, axis=1, keepdims=True) * rng.standard_normal(near.shape) / np.sqrt(dim))
    for size, spread in groups:
        middle = rng.standard_normal(dim)
        parts.append(middle + spread * np.linalg.norm(middle) * rng.standard_normal((size, dim)) / np.sqrt(dim))
    x = np.concatenate(parts)
    return x[rng.permutation(len(x))]


def plain(x, cosine):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(np.triu(link)), strict=True):
        i, j = find(int(a)), find(int(b))
        root[max(i, j)] = min(i, j)
    return link.sum(axis=1), [find(k) for k in range(len(x))]


def test_recall_over_buckets_of_several_blocks(spark):
    """5000 vectors; the groups of 1500 and 1300 fill buckets of more than one block, and tables have five bits."""
    x = planted(1, 2000, [(1500, 0.15), (1300, 0.24)])
    bits, _ = neardup.plan(len(x), 0.95, bucket=160)
    assert len(x) > 5000 and bits > 4 and neardup.BLOCK < 1300
    df = spark.createDataFrame([(k, v.tolist(), "label") for k, v in enumerate(x)], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, bucket=160).collect()}
    want, comps = plain(x, 0.95)
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert want.sum() > 1_000_000 and (want == 0).sum() > 1000
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert sum(got[k]["component_id"] == c for k, c in enumerate(comps)) >= 0.999 * len(x)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_blocks_change_nothing(spark, monkeypatch):
    """Small tables of one block or of many give the same links, each counted once."""
    x = planted(2, 200, [(120, 0.2), (60, 0.1)], dim=16)
    want, comps = plain(x, 0.95)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (7, 50, 1024):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, bucket=8).collect()}
        assert sum(got[k] != (int(want[k]), comps[k]) for k in got) <= 2
