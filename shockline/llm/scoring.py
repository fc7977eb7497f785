"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model over words (trigrams), smoothed with a Dirichlet
prior at every order: ``P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu)``,
where h' is h without its first word, and
``P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))``.  As an automaton every seen
n-gram below the highest order is a state; a seen n-gram is an arc from the
state of its words but the last, and a state's failure arc, of weight
``mu / (c(h) + mu)``, leads to the state of h'.  The empty state has arcs for
all words.  A text is read once from left to right, from the state of a text's
end.

Nothing of the model has to fit into one task: n-grams are counted by fragments
of the hash space, and each block of documents gets back the counts of its own
n-grams, which are the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.blocks import open_block, write_blocks
from shockline.llm.shared import cut
from shockline.llm.text import PLACE, mix, words

END = np.uint64(0x9E6C63D0876A9A99)
ALPHA = 0.1


def trains(doc_id: int | None, held_out: int = 0, folds: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held_out


def tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a block's documents side by side, each with its end; their edges; which documents train."""
    parts, edges = [], [0]
    for run in open_block(row["offsets"], row["size"], row["data"]):
        w = words(run, lower=True)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            parts += [w.hash[a:b], np.array([END])]
            edges.append(edges[-1] + int(b - a) + 1)
    train = np.array([trains(i) for i in row["doc_ids"]], bool)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(edges), train


def grams_of(tokens: np.ndarray, edges: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of 1 to ``order`` words the sorted hashes of a block's n-grams, and the number of the one that
    ends with each token.

    A text begins after an end.  The k-gram (k > 2) of one of its first k - 2 tokens would reach beyond that; its number is -1.
    """
    out, h = [np.unique(tokens, return_inverse=True)], tokens
    place = np.arange(len(tokens)) - np.repeat(edges[:-1], np.diff(edges))
    for k in range(2, order + 1):
        last = np.zeros_like(tokens)
        last[1:] = h[:-1]
        if k == 2:
            last[edges[:-1]] = END
        h = mix(last * PLACE[0] + tokens * PLACE[1])
        whole = np.flatnonzero(place >= k - 2)
        found, inverse = np.unique(h[whole], return_inverse=True)
        numbers = np.full(len(tokens), -1)
        numbers[whole] = inverse
        out.append((found, numbers))
    return out


def _cuts(h: np.ndarray, fragments: int) -> list[tuple[int, int, int]]:
    """(fragment, first, end) of sorted hashes."""
    where = (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(h)] if len(h) else [0]
    return [(int(where[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _opened(body: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _shift(fragments: int, width: int) -> np.uint64:
    """By how many bits a place within a fragment is cut to fit into ``width`` bytes."""
    return np.uint64(max(0, 64 - 8 * width - (fragments.bit_length() - 1)))


def _keys(h: np.ndarray, fragment: int, fragments: int, width: int) -> bytes:
    """Sorted hashes of a fragment as steps from one to the next, ``width`` bytes each, byte planes apart."""
    first = np.uint64(-(-(fragment << 32) // fragments) << 32)
    steps = np.diff((h - first) >> _shift(fragments, width), prepend=np.uint64(0))
    return pa.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)


def _places(body: bytes, n: int, width: int) -> np.ndarray:
    """Places within the fragment of n keys."""
    planes = np.frombuffer(pa.decompress(body, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.reshape(width, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _width(order: int) -> int:
    """Words are told apart by 64 bits, longer n-grams by 40 bits within their fragment."""
    return 8 if order == 1 else 5


def count_fragment(part: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a fragment's n-grams, for each block those of its own; summary: (V, N) of the fragment's words."""
    order = int(part["order"].iat[0])
    keys = [_places(k, n, _width(order)) for k, n in zip(part["keys"], part["n"], strict=True)]
    edges = np.cumsum([0, *map(len, keys)])
    counts = np.concatenate([_opened(c, n, np.uint32) for c, n in zip(part["counts"], map(len, keys), strict=True)])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
    back = total[inverse]
    packed = [_packed(back[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    first = np.arange(len(part)) == 0
    return pd.DataFrame({"block": part["block"], "order": order, "fragment": part["fragment"], "n": np.diff(edges), "counts": packed, "kinds": np.where(first, int((total > 0).sum()), 0), "tokens": np.where(first, int(total.sum()), 0)})


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Automaton:
    """The states and arcs that some documents can reach.

    grams[k]: number of the n-gram of k + 1 words that ends with each token, or -1; counts[k]: how often each of them
    occurs in training tokens; words: the probability of each word; edges: where documents begin in the tokens; end: the
    number of a text's end.  State 0 is the empty one; those of words follow, then those of longer n-grams.
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, edges: np.ndarray, end: int, mu: float):
        self.width, self.empty = len(words), np.log10(words).tolist()
        base = np.cumsum([1, *map(len, counts)])  # the first state of each length
        self.fail = [0.0, *np.log10(mu / (counts[0] + mu)).tolist()]
        self.to = [0] * len(self.fail)
        self.arcs: dict[int, tuple[float, int]] = {}
        p = words
        for k in range(1, len(grams)):
            before = np.full(len(grams[0]), -1)
            before[1:] = grams[k - 1][:-1]
            if k == 1:
                before[edges[:-1]] = end
            at = np.empty(len(counts[k]), np.int64)  # some place of each n-gram
            whole = np.flatnonzero(grams[k] >= 0)
            at[grams[k][whole]] = whole
            context, shorter = before[at], grams[k - 1][at]
            p = (counts[k] + mu * p[shorter]) / (counts[k - 1][context] + mu)
            longest = k + 1 == len(grams)
            target = base[k - 1] + shorter if longest else base[k] + np.arange(len(at))
            on = np.flatnonzero(counts[k] > 0)
            code = (base[k - 1] + context[on]) * self.width + grams[0][at[on]]
            self.arcs.update(zip(code.tolist(), zip(np.log10(p[on]).tolist(), target[on].tolist(), strict=True), strict=True))
            if not longest:
                self.fail += np.log10(mu / (counts[k] + mu)).tolist()
                self.to += (base[k - 1] + shorter).tolist()

    def score(self, tokens: list[int], state: int) -> float:
        """log10 probability of the words (by number) read from a state on."""
        total, arcs, fail, to, empty, width = 0.0, self.arcs, self.fail, self.to, self.empty, self.width
        for w in tokens:
            while state:
                arc = arcs.get(state * width + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += fail[state]
                state = to[state]
            else:
                total += empty[w]
                state = w + 1
        return total


def parts_of(edges: np.ndarray, most: int = 250_000) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``most`` tokens, which bounds an automaton's size; a longer one is alone."""
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, side="right")) - 1)
        yield i, j
        i = j


def local(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a part numbered anew (-1 stays), their counts, and their former numbers."""
    found, new = np.unique(numbers, return_inverse=True)
    if len(found) and found[0] < 0:
        found, new = found[1:], new - 1
    return new, counts[found], found


def score(docs: DataFrame, order: int = 3, mu: float = 2.0, per_fragment: int = 1_500_000) -> DataFrame:
    """RESULT for every row of docs (doc_id, text; further columns are ignored).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and each text has
    an end, counted as a token, so a null or empty text has one.  Repeated rows
    train and score each; a null id counts as the empty text for the fold.  With
    no training text N is 0 and every word is unknown.  An empty table gives no
    rows.  Words are told apart by 64-bit hashes, longer n-grams by at least 40
    bits beside their fragment.  ``order`` is 2 at least.
    """
    blocks = write_blocks(docs)
    size = blocks.agg(F.sum("size").alias("s")).collect()[0]["s"] or 0
    fragments = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * per_fragment)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, edges, train = tokens_of(row)
                weight = np.repeat(train, np.diff(edges)).astype(float)
                for k, (found, numbers) in enumerate(grams_of(tokens, edges, order), 1):
                    whole = numbers >= 0
                    counts = np.bincount(numbers[whole], weights=weight[whole], minlength=len(found)).astype(np.uint32)
                    parts = _cuts(found, fragments)
                    cols = [
                        pa.array([k] * len(parts), pa.int32()),
                        pa.array([f for f, _, _ in parts], pa.int64()),
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([b - a for _, a, b in parts], pa.int64()),
                        pa.array([_keys(found[a:b], f, fragments, _width(k)) for f, a, b in parts], pa.binary()),
                        pa.array([_packed(counts[a:b]) for _, a, b in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["order", "fragment", "block", "n", "keys", "counts"])

    spread = blocks.select("block", "doc_ids", "offsets", "size", "data").mapInArrow(grams, "order int, fragment long, block long, n long, keys binary, counts binary")
    answers = cut(spread.groupBy("order", "fragment").applyInPandas(count_fragment, "block long, order int, fragment long, n long, counts binary, kinds long, tokens long"))
    sums = answers.where("order = 1").agg(F.sum("kinds").alias("v"), F.sum("tokens").alias("n")).collect()[0]
    v, n_train = int(sums["v"] or 0), int(sums["n"] or 0)
    whole_train = n_train + ALPHA * (v + 1)
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("order", "fragment", "n", "counts")).alias("answers"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, edges, train = tokens_of(row)
                grams, counts = [], []
                for k, (found, numbers) in enumerate(grams_of(tokens, edges, order), 1):
                    mine = sorted((a for a in row["answers"] if a["order"] == k), key=lambda a: a["fragment"])
                    grams.append(numbers)
                    counts.append(np.concatenate([_opened(a["counts"], a["n"], np.int64) for a in mine]) if len(found) else np.zeros(0, np.int64))
                    if k == 1:
                        end = int(np.searchsorted(found, END))
                rows = []
                for i, j in parts_of(edges):
                    a, b = int(edges[i]), int(edges[j])
                    numbers, count, kinds = zip(*(local(g[a:b], c) for g, c in zip(grams, counts, strict=True)), strict=True)
                    p = (count[0] + ALPHA) / whole_train
                    begins = edges[i : j + 1] - a
                    first = int(np.searchsorted(kinds[0], end))
                    machine = Automaton(list(numbers), list(count), p, begins, first, mu)
                    each, known, words = np.log10(p)[numbers[0]], count[0][numbers[0]] > 0, numbers[0].tolist()
                    for d, (x, y) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True), i):
                        rows.append((row["doc_ids"][d], not train[d], y - x, int(known[x:y].sum()), n_train, math.fsum(each[x:y].tolist()), machine.score(words[x:y], first + 1)))
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return blocks.join(per_block, "block").select("doc_ids", "offsets", "size", "data", "answers").mapInArrow(scored, RESULT)
