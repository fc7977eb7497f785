"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, components.

Each table gives a vector a bucket: the signs of its products with some random
hyperplanes.  Within a bucket all pairs are compared exactly, in double
precision.  A pair that shares several buckets is counted in the first table
where it does, so no pair has to be written out to be counted once.  Large
buckets are cut into blocks that are compared block by block.  Equal vectors
are compared as one that stands for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.shared import components, cut

BLOCK = 1024


def plan(n: int, cosine: float, miss: float = 1e-4, bucket: int = 256) -> tuple[int, int]:
    """Hyperplanes per table and tables for n vectors: buckets of about ``bucket`` unlike vectors, and as many tables
    as it takes for a pair at the threshold to share none with a chance of ``miss`` at most."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / bucket))) if n > bucket else 4
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(miss) / math.log1p(-same)))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables))


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (bytes of floats of 4 bytes where those hold the same values, else of 8) per row; v is null where the
    vector has no direction or no id."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = None
                if i is not None and v and not any(x is None for x in v):
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        top = np.abs(x).max()
                        x = x / top if top > 1e100 or top < 1e-100 else x  # squares stay finite
                        with np.errstate(over="ignore"):
                            short = x.astype(np.float32)
                        body = (b"4" + (short + np.float32(0)).tobytes()) if (short == x).all() else b"8" + (x + 0.0).tobytes()
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(packed, "vec_id long, v binary")


def opened(bodies: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.stack([np.frombuffer(b, np.float32 if b[:1] == b"4" else np.float64, offset=1).astype(np.float64) for b in bodies])


def packed_signatures(sigs: np.ndarray, bits: int) -> list[bytes]:
    """Rows of signatures in the fewest whole bytes each."""
    wide = np.ascontiguousarray(sigs.astype("<i8")).view(np.uint8).reshape(*sigs.shape, 8)[:, :, : -(-bits // 8)]
    return [row.tobytes() for row in np.ascontiguousarray(wide)]


def bucketed(reps: DataFrame, dim: int, bits: int, tables: int, seed: int) -> DataFrame:
    """rep, copies, v, sigs (bytes of a signature per table), table, bucket."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = hyperplanes(dim, bits, tables, seed)
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = opened(batch.column(2).to_pylist())
            sigs = (x @ planes > 0).reshape(len(x), tables, bits) @ weights
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed_signatures(sigs, bits), pa.binary()), pa.array(sigs.tolist(), pa.list_(pa.int64()))], ["rep", "copies", "v", "sigs", "buckets"])

    rows = reps.select("rep", "copies", "v").mapInArrow(hashed, "rep long, copies long, v binary, sigs binary, buckets array<long>")
    return rows.select("rep", "copies", "v", "sigs", F.posexplode("buckets").alias("table", "bucket"))


def compare(part: pd.DataFrame, cosine: float, tables: int) -> pd.DataFrame:
    """Links of one block, or between two: partial link counts and, per vector, a link to a component's smallest id."""
    table, same = int(part["table"].iat[0]), bool(part["bi"].iat[0] == part["bj"].iat[0])
    part = part.sort_values("rep", kind="stable")
    left = part if same else part[part["own"] == part["bi"]]
    right = part if same else part[part["own"] == part["bj"]]
    ids_l, ids_r = left["rep"].to_numpy(), right["rep"].to_numpy()
    if not len(ids_l) or not len(ids_r):
        return pd.DataFrame({"id": [], "n_links": [], "to": []}).astype("int64")
    x = unit(opened(left["v"].tolist()))
    y = x if same else unit(opened(right["v"].tolist()))
    sig_l, sig_r = (np.frombuffer(b"".join(s["sigs"]), np.uint8).reshape(len(s), tables, -1) for s in (left, right))
    a, b = np.nonzero(x @ y.T >= cosine)
    keep = a < b if same else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    fresh = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 18):
        s = slice(k, k + (1 << 18))
        fresh[s] = ~(sig_l[a[s], :table] == sig_r[b[s], :table]).all(axis=2).any(axis=1)
    a, b = a[fresh], b[fresh]
    if not len(a):
        return pd.DataFrame({"id": [], "n_links": [], "to": []}).astype("int64")
    wl, wr = left["copies"].to_numpy(), right["copies"].to_numpy()
    ids = np.concatenate([ids_l, ids_r])
    shift = len(ids_l)
    count = np.bincount(np.concatenate([a, b + shift]), weights=np.concatenate([wr[b], wl[a]]), minlength=len(ids))
    root = list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(a.tolist(), (b + shift).tolist(), strict=True):
        if same:
            q -= shift
        i, j = find(p), find(q)
        if i != j:
            if ids[j] < ids[i]:
                i, j = j, i
            root[j] = i
    if same:
        count = count[:shift] + count[shift:]
        ids = ids[:shift]
    on = np.flatnonzero(count)
    return pd.DataFrame({"id": ids[on], "n_links": count[on].astype("int64"), "to": ids[[find(int(k)) for k in on]]})


def comparing(cosine: float, tables: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda part: compare(part, cosine, tables)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, seed: int = 7, miss: float = 1e-4, bucket: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding; further columns are ignored).

    A vector that is null, empty, zero or holds null or non-finite components
    links with nothing and is a component of its own.  Vectors of different
    lengths never link.  Every row is a vector of its own: repeated rows count
    as copies of each other, and rows of one vec_id with other vectors each have
    the links of theirs.  A null vec_id gets 0 links and a null component.  An
    empty table gives no rows.
    """
    plain = cut(usable(vectors))
    groups = plain.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    reps = cut(groups.withColumn("rep", F.monotonically_increasing_id()))  # written, so that a vector keeps its number
    links = None
    dim = F.expr("(octet_length(v) - 1) div if(startswith(v, X'34'), 4, 8)")
    for row in reps.groupBy(dim.alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        bits, tables = plan(row["n"], cosine, miss, bucket)
        rows = bucketed(reps.where(dim == row["dim"]), row["dim"], bits, tables, seed)
        sizes = rows.groupBy("table", "bucket").agg(F.count("*").alias("m")).where("m > 1")
        sizes = sizes.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        rows = rows.join(sizes, ["table", "bucket"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = rows.select("rep", "copies", "v", "sigs", "table", "bucket", "own", other)
        rows = rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other")
        found = rows.groupBy("table", "bucket", "bi", "bj").applyInPandas(comparing(cosine, tables), "id long, n_links long, to long")
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = reps.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("to")).limit(0)
    links = cut(links)
    counts = links.groupBy(F.col("id").alias("rep")).agg(F.sum("n_links").alias("links"))
    comps = components(links.select(F.col("id").alias("a"), F.col("to").alias("b"))).select(F.col("id").alias("rep"), "component")
    each = reps.select("v", "rep", "least_id", "copies").join(counts, "rep", "left").join(comps, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    least = each.groupBy("root").agg(F.min("least_id").alias("component_id"))
    each = each.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = plain.where("v is not null").join(each, "v").select("vec_id", "n_links", "component_id")
    # Vectors without a direction have no key to be joined by.
    out = out.unionByName(plain.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(m.c, e.vec_id) AS component_id, e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.vec_id = e.vec_id
"""
