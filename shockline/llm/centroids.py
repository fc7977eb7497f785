"""k-means over integer vectors with an incremental distance matrix.

Per vector the exact dot products with all centroids are kept in a written
table.  When centroids move, only the components that changed are multiplied
again and added to them; distances and the nearest centroid follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.shared import cut

#: Components are held within this, so that distances of up to 256 components fit 64 bits.
BOUND = 1 << 26


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: the vectors of ``dims`` components, none null or non-finite, as integers floor(scale * x)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ok = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            ids, lists = batch.column(0).filter(ok), lists.filter(ok)
            flat = lists.flatten()
            x = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(lists), dims)
            good = np.isfinite(x).all(axis=1)
            v = np.clip(np.floor(x[good] * scale), -BOUND, BOUND).astype(np.int32)
            out = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * dims, pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), out], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).mapInArrow(mapped, "vec_id long, v array<int>")


def first_centroids(kept: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; equal hashes go by components.  Fewer if there are fewer."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in kept.select(rank.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.reshape(-1)))


def assign(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """state(vec_id, v, dots), whose dots are with the centroids ``before`` -> vec_id, v, dots, cluster, distance with ``after``.

    Without ``dots`` those of ``before`` are zero.  Of each centroid only the components that changed are read.
    """
    k, dims = after.shape
    moved = after - before
    changed = [(c, np.flatnonzero(moved[c])) for c in range(k) if moved[c].any()]
    square = (after * after).sum(axis=1)
    has_dots = "dots" in state.columns

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            dots = _matrix(batch.column(2), k) if has_dots else np.zeros((len(v), k), np.int64)
            for c, at in changed:
                dots[:, c] += v[:, at] @ moved[c, at]
            distance = (v * v).sum(axis=1)[:, None] - 2 * dots + square
            best = distance.argmin(axis=1)  # the smaller number among equals
            cols = [batch.column(0), batch.column(1), _lists(dots), pa.array(best.astype(np.int32)), pa.array(distance[np.arange(len(v)), best])]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "dots", "cluster", "distance"])

    return state.select("vec_id", "v", *["dots"] * has_dots).mapInArrow(mapped, "vec_id long, v array<int>, dots array<long>, cluster int, distance long")


def means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floor(sum / count) per component of each cluster; empty ones stay.

    Each task sums what it reads, so k rows of it meet; the driver gets k sums.
    """
    k, dims = centroids.shape

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            for c in np.unique(cluster):
                own = cluster == c
                n[c] += own.sum()
                sums[c] += v[own].sum(axis=0)
        some = np.flatnonzero(n)
        for c in some:
            cols = [pa.array(np.full(dims, c, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n[c])), pa.array(sums[c])]
            yield pa.RecordBatch.from_arrays(cols, ["cluster", "place", "n", "s"])

    parts = assigned.select("cluster", "v").mapInArrow(mapped, "cluster int, place int, n long, s long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r["cluster"], r["place"]] = r["s"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 per kept vector.

    vectors(vec_id, embedding): those of another length, or with a null or
    non-finite component, have no row; further columns are ignored.  Each row
    is a vector of its own, also where ids repeat or are null (their text is
    then empty).  With fewer than k vectors each is a centroid at the start; an
    empty table gives no rows.  Components beyond 2**26 in size are held to
    that.  Every round reads the table of the round before and writes its own
    in the shared folder, so a lost executor costs its tasks only; the driver
    holds k centroids.
    """
    kept = cut(integer_vectors(vectors, dims, scale))
    first = first_centroids(kept, k, seed)
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    centroids = np.array(first, np.int64)
    state = cut(assign(kept, np.zeros_like(centroids), centroids))
    for r in range(rounds):
        new = means(state, centroids)
        rows = assign(state, centroids, new)
        state = cut(rows if r < rounds - 1 else rows.select("vec_id", "cluster", "distance"))
        centroids = new
    if not rounds:
        state = state.select("vec_id", "cluster", "distance")
    total = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    whole = sum(r["s"] for r in total)
    facts = [(r["cluster"], int(r["s"]), int(whole), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in total]
    told = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """SQL for ``cluster`` on distinct ids, written out round by round."""
    parts = [
        f"""vectors AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
    SELECT vec_id, any_value(v) AS v, min(m) % {k} AS cluster, min(m) // {k} AS distance FROM (
        SELECT x.vec_id, x.v, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * {k} + c.c AS m
        FROM vectors x CROSS JOIN c{r} c) GROUP BY vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
    SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
            SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY cluster, j)
        GROUP BY cluster) m ON m.cluster = c.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(c.v, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.cluster"""
