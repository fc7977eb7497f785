"""Language identification with error-correcting output codes.

Every language has a codeword.  For each bit a binary logistic classifier over
hashed byte n-grams says which half of the languages a text belongs to; the
text gets the language whose codeword has the least total logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockline.llm.shared import as_struct, crc_of
from shockline.llm.text import LOWER, mix, slices

WIDTH = 4096
#: Bytes as letters: white space, digits and marks all count as one gap.
SHAPE = LOWER.copy()
SHAPE[:65] = 32
SHAPE[91:97] = 32
SHAPE[123:128] = 32
_codes = [(mix(np.arange(k, k + 256, dtype=np.uint64)) % np.uint64(WIDTH)).astype(np.uint16) for k in (1000, 2000, 3000)]


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to 7 languages, else 12 * log2(n) fixed random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.arange(1, 2 ** (n - 1))
        return np.where((bits[None, :] << 1 | 1) >> np.arange(n)[:, None] & 1, 1.0, -1.0) if n > 2 else np.array([[1.0], [-1.0]])
    width = int(np.ceil(12 * np.log2(n)))
    return np.where(mix(np.arange(n * width, dtype=np.uint64)).reshape(n, width) >> np.uint64(63), 1.0, -1.0)


def features(run) -> np.ndarray:
    """Square roots of n-gram counts (2 and 3 bytes of words, with their edges), of length 1, per document."""
    out = np.zeros((len(run), WIDTH), np.float32)
    shape = SHAPE[run.data]
    if len(shape) >= 3:
        one, two, three = (c[shape] for c in _codes)
        pair = one[:-1] ^ two[1:]
        triple = pair[:-1] ^ three[2:]
        gap = shape == 32
        dull_pair = gap[:-1] & gap[1:]
        dull_triple = gap[:-2] & gap[1:-1] | gap[1:-1] & gap[2:]
        for i in range(len(run)):
            a, b = int(run.offsets[i]), int(run.offsets[i + 1])
            if b - a < 2:
                continue
            p, t = pair[a : b - 1], triple[a : max(a, b - 2)]
            counts = np.bincount(p[~dull_pair[a : b - 1]], minlength=WIDTH) + np.bincount(t[~dull_triple[a : max(a, b - 2)]], minlength=WIDTH)
            out[i] = np.sqrt(counts)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


@dataclass
class Coder:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share in the softmax of minus the losses, and the loss gap to the second."""
        margin = (x @ self.weights + self.bias).astype(np.float64)
        loss = np.logaddexp(0, -margin) @ (self.code > 0).T + np.logaddexp(0, margin) @ (self.code < 0).T
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        ranked = np.sort(loss, axis=1)
        gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, p[np.arange(len(x)), best] / p.sum(axis=1), gap


def fit(x: np.ndarray, langs: list[str], rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> Coder:
    names = sorted(set(langs))
    code = codewords(len(names))
    y = code[[names.index(v) for v in langs]]
    counts = {v: langs.count(v) for v in names}
    weight = np.array([len(langs) / (len(names) * counts[v]) for v in langs], np.float32)[:, None] / len(langs)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, rounds + 1):
        g = (-y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * weight).astype(np.float32)
        for param, grad, k in ((w, x.T @ g + decay * w, 0), (b, g.sum(axis=0), 2)):
            m, v = moments[k], moments[k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Coder(names, code, w, b)


def train(docs: DataFrame, per_lang: int = 400, held_out: int | None = 2, folds: int = 4, most_rows: int = 20_000) -> Coder:
    """Fits the classifiers to a bounded sample: ``per_lang`` documents with a text of every language, fewer of each
    (one at least) where they would be more than ``most_rows``.  No language is left out.

    Documents whose crc32 of doc_id modulo ``folds`` is ``held_out`` are left
    out.  The sample has the lowest hashes of doc_id and text, so it is the same
    every time, null ids spread, and repeated rows count once.  Only hashes are
    ranked; texts are picked where they are read, by what is broadcast, which
    the bounds keep small.
    """
    known = docs.where("lang is not null and text is not null and trim(text) <> ''")
    if held_out is not None:
        known = known.where(crc_of("doc_id") % folds != held_out)
    known = known.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("rank"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n"))
    sizes = docs.sparkSession.createDataFrame(sizes.collect(), sizes.schema)
    n_langs = sizes.count()
    if not n_langs:
        return Coder([], np.ones((0, 1)), np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32))
    each = max(1, min(per_lang, most_rows // n_langs))
    # Twice the share that is wanted, so that enough are left; then exactly the lowest of each language.
    few = known.join(F.broadcast(sizes), "lang").where(F.col("rank") < F.lit(2.0 * each * (1 << 40)) / F.col("n")).select("lang", "rank").distinct()
    ranks = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("place") <= each).select("lang", "rank")
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ranks.collect(), ranks.schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run in slices(batch.column(2)):
                for x in features(run):
                    at = np.flatnonzero(x).astype(np.uint16)
                    rows.append(at.tobytes() + x[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["lang", "rank", "x"])

    chosen = known.join(wanted, ["lang", "rank"], "left_semi").select("lang", "rank", "text").mapInArrow(mapped, "lang string, rank long, x binary")
    rows = sorted(chosen.distinct().collect(), key=lambda r: (r["lang"], r["rank"], r["x"]))
    if not rows:
        return Coder([], np.ones((0, 1)), np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for row, r in zip(x, rows, strict=True):
        n = len(r["x"]) // 6
        row[np.frombuffer(r["x"], np.uint16, n)] = np.frombuffer(r["x"][2 * n :], np.float32)
    return fit(x, [r["lang"] for r in rows])


RESULT = "lang_pred string, score double, ambiguous boolean"


def told(coder: Coder, texts: pa.Array, least_gap: float) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and ambiguity of whole texts."""
    langs, scores, close = [], [], []
    letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
    for run in slices(texts):
        if not coder.langs:
            langs += ["und"] * len(run)
            scores += [0.0] * len(run)
            close += [True] * len(run)
            continue
        for i, (k, p, gap) in enumerate(zip(*coder.decode(features(run)), strict=True)):
            ok = letter[run.first + i]
            langs.append(coder.langs[k] if ok else "und")
            scores.append(float(min(1.0, p)) if ok else 0.0)
            close.append(bool(gap < least_gap) or not ok)
    return langs, scores, close


def predict(docs: DataFrame, coder: Coder, least_gap: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous (the two nearest codewords lie within ``least_gap``) per row of docs.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language could be learned.  All texts are read whole; further
    columns are ignored; repeated rows and null ids give a row each; an empty
    table gives none.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, close = told(coder, batch.column(1), least_gap)
            cols = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(mapped, f"doc_id long, {RESULT}")


def keep_told(docs: DataFrame, coder: Coder, least_gap: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language ``predict`` can tell: not ``und`` and not ambiguous."""
    place = docs.columns.index("text")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, close = told(coder, batch.column(0).field(place), least_gap)
            yield batch.filter(pa.array([k != "und" and not c for k, c in zip(langs, close, strict=True)], pa.bool_()))

    rows = as_struct(docs)
    return rows.mapInArrow(mapped, rows.schema).select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """The result of op6: all documents, with the fold that training never saw marked held_out."""
    found = predict(docs, train(docs))
    return found.select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
