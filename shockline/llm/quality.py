"""Document quality by labelling lines with a linear-chain conditional random field.

A line is content or boilerplate.  Its features are shares of characters and
words, put into bins; Viterbi decoding of each whole text marks its lines, and
the share of the text's words on content lines decides.

Only documents are labelled, and a poor one may well hold good lines.  So the
field is fitted twice: without the chain to lines that have their document's
label, which tells what lines of poor documents look like those of good ones,
and then with the chain to the lines marked so, and to good documents with the
lines of a poor one put in their middle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.shared import as_struct, crc_of
from shockline.llm.text import Run, Words, counts_in, hash_spans, ngrams, slices, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
LETTERS[128:] = True
DIGITS = np.zeros(256, bool)
DIGITS[[*b"0123456789"]] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
LEADS = np.ones(256, bool)  # the first bytes of code points
LEADS[128:192] = False
STOPS = np.zeros(256, bool)
STOPS[[*b".!?"]] = True

#: Bin edges of each numeric feature of a line.
BINS = {
    "words": (1, 3, 6, 12, 25, 60),
    "letters": (0.2, 0.5, 0.7, 0.85, 0.95),
    "digits": (0.01, 0.1, 0.3),
    "symbols": (0.001, 0.02, 0.05, 0.1, 0.2),
    "capitals": (0.001, 0.05, 0.2, 0.5),
    "word_length": (2, 3, 4.5, 6, 8),
    "seen_before": (0.5,),
    "ends_sentence": (0.5,),
    "repeated_words": (0.05, 0.2, 0.5),
}
WIDTH = sum(len(b) + 1 for b in BINS.values())


@dataclass
class Lines:
    """Features of the lines of a run; first[i] is document i's first line.  Lines without a word don't count."""

    bins: np.ndarray
    words: np.ndarray
    first: np.ndarray


@dataclass
class Facts:
    """Counts per document of a run."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _again(h: np.ndarray) -> np.ndarray:
    """Which values equal an earlier one."""
    again = np.ones(len(h), bool)
    again[np.unique(h, return_index=True)[1]] = False
    return again


def read(run: Run, symbols: np.ndarray) -> tuple[Facts, Lines]:
    data, n = run.data, len(run)
    w: Words = words(run)
    inside = np.zeros(len(data), bool)
    if len(w.start):
        step = np.zeros(len(data) + 1, np.int8)
        step[w.start] += 1
        np.subtract.at(step, w.end, 1)
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    leads = LEADS[data]
    chars = counts_in(inside & leads, run.offsets)
    marks = counts_in(symbols[data], run.offsets)
    repeat = np.zeros(len(w.start), bool)
    for i in range(n):
        a, b = w.first[i], w.first[i + 1]
        if b - a < 4:
            continue
        g = ngrams(w.hash[a:b], 3)
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice) + a
        repeat[at] = repeat[at + 1] = repeat[at + 2] = True
    repeats = counts_in(repeat, w.first)

    # Lines: cut at \n and at documents' ends.
    newline = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([newline + 1, run.offsets]))
    cuts = cuts[cuts <= len(data)]
    begin, end = cuts[:-1], cuts[1:]
    nwords = np.searchsorted(w.start, end) - np.searchsorted(w.start, begin)
    solid = nwords > 0
    begin, end, nwords = begin[solid], end[solid], nwords[solid]
    first = np.searchsorted(begin, run.offsets)
    stop = end - ((end > begin) & (data[end - 1] == 10)) if len(end) else end
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, begin, 1)
    np.subtract.at(keep, stop, 1)
    h = hash_spans(data, np.cumsum(keep[:-1], dtype=np.int8).astype(bool), stop - begin)
    seen = np.zeros(len(h), bool)
    for i in range(n):
        if first[i + 1] - first[i] > 1:
            seen[first[i] : first[i + 1]] = _again(h[first[i] : first[i + 1]])
    dups = counts_in(seen, first)
    facts = Facts(np.diff(w.first), chars, marks, dups, repeats)

    def over(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[stop] - total[begin]

    solid_chars = np.maximum(over(inside & leads), 1)
    wrep = np.zeros(len(repeat) + 1, np.int64)
    np.cumsum(repeat, out=wrep[1:])
    wa = np.searchsorted(w.start, begin)
    last = w.end[np.maximum(wa + nwords - 1, 0)] - 1 if len(begin) else begin
    values = {
        "words": nwords,
        "letters": over(LETTERS[data] & leads) / solid_chars,
        "digits": over(DIGITS[data]) / solid_chars,
        "symbols": over(symbols[data]) / solid_chars,
        "capitals": over(CAPITALS[data]) / solid_chars,
        "word_length": solid_chars / np.maximum(nwords, 1),
        "seen_before": seen,
        "ends_sentence": STOPS[data[last]] if len(begin) else seen,
        "repeated_words": (wrep[wa + nwords] - wrep[wa]) / np.maximum(nwords, 1),
    }
    bins, at = np.zeros((len(begin), len(BINS)), np.int16), 0
    for k, (name, edges) in enumerate(BINS.items()):
        bins[:, k] = at + np.searchsorted(np.array(edges, float), values[name].astype(float), side="right")
        at += len(edges) + 1
    return facts, Lines(bins, nwords, first)


@dataclass
class Field:
    """Weights of the chain: emit[feature, label], move[label, next]; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, bins: np.ndarray) -> np.ndarray:
        """The labels of one document's lines with the highest score; a tie goes to content."""
        scores = self.emit[bins].sum(axis=1).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        s0, s1 = scores[0]
        for e0, e1 in scores[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b >= a, d >= c))
            s0, s1 = (b if b >= a else a) + e0, (d if d >= c else c) + e1
        label = int(s1 >= s0)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return np.array(out[::-1], np.int8)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], chain: bool = True, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam; docs: (bins, labels) of the lines of a sequence.

    Every sequence counts the same, whatever its length, and so do, over all of
    them, both labels.  Without ``chain`` no weight is given to neighbours.
    """
    emit, move = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: len(d[0]))
    if not docs:
        return Field(emit, move)
    content = sum(float(y.mean()) for _, y in docs)
    weight = [len(docs) / (2 * max(x, 1e-9)) for x in (len(docs) - content, content)]
    groups = []
    for i in range(0, len(docs), 64):
        part = docs[i : i + 64]
        t = max(len(b) for b, _ in part)
        bins = np.zeros((len(part), t, len(BINS)), np.int64)
        mask, gold = np.zeros((len(part), t)), np.zeros((len(part), t), np.int64)
        for k, (b, y) in enumerate(part):
            bins[k, : len(b)], mask[k, : len(b)], gold[k, : len(b)] = b, 1, y
        groups.append((bins, mask, gold, np.array([(weight[1] * y.mean() + weight[0] * (1 - y.mean())) / len(y) for _, y in part])))
    total = sum(w.sum() for *_, w in groups)
    state = [(np.zeros_like(emit), np.zeros_like(emit)), (np.zeros_like(move), np.zeros_like(move))]
    for step in range(1, rounds + 1):
        ge, gm = decay * emit, decay * move
        for bins, mask, y, w in groups:
            e = emit[bins].sum(axis=2)
            n, t, _ = e.shape
            alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            alpha[:, 0] = e[:, 0]
            for k in range(1, t):
                new = np.logaddexp(alpha[:, k - 1, :1] + move[0], alpha[:, k - 1, 1:] + move[1]) + e[:, k]
                alpha[:, k] = np.where(mask[:, k, None] > 0, new, alpha[:, k - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for k in range(t - 2, -1, -1):
                q = e[:, k + 1] + beta[:, k + 1]
                new = np.stack([np.logaddexp(move[s, 0] + q[:, 0], move[s, 1] + q[:, 1]) for s in (0, 1)], axis=1)
                beta[:, k] = np.where(mask[:, k + 1, None] > 0, new, 0)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            g = (p - np.eye(2)[y] * mask[:, :, None]) * w[:, None, None] / total
            for f in range(len(BINS)):
                np.add.at(ge, bins[:, :, f].ravel(), g.reshape(-1, 2))
            if t > 1 and chain:
                pair = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
                told = np.eye(2)[y[:, :-1]][:, :, :, None] * np.eye(2)[y[:, 1:]][:, :, None, :]
                pair = (np.exp(pair) - told) * mask[:, 1:, None, None]
                gm = gm + (pair * w[:, None, None, None]).sum(axis=(0, 1)) / total
        for x, g, (m, v) in zip((emit, move), (ge, gm), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(emit, move)


def mark(docs: list[tuple[np.ndarray, int]], sure: float = 2.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bins, labels of the lines) from (bins, label of the document).

    A line of a poor document is content if it looks more like the lines of
    good ones; a line of a good one is boilerplate if it looks much more like
    those of poor ones.  Where that would leave no line with the document's
    label, all keep it.
    """
    alone = fit([(b, np.full(len(b), y)) for b, y in docs], chain=False)
    out = []
    for bins, label in docs:
        e = alone.emit[bins].sum(axis=1)
        lines = (e[:, 1] - e[:, 0] >= (-sure if label else 0)).astype(np.int64)
        out.append((bins, lines if (lines == label).any() else np.full(len(bins), label)))
    return out


def joined(marked: list[tuple[np.ndarray, np.ndarray]], docs: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Good documents with the lines of a poor one in their middle, one for every poor document."""
    good = [m for m, (_, y) in zip(marked, docs, strict=True) if y]
    poor = [m for m, (_, y) in zip(marked, docs, strict=True) if not y]
    out = []
    for k, (bins, lines) in enumerate(poor if good else []):
        around, told = good[k % len(good)]
        at = len(around) // 2
        out.append((np.concatenate([around[:at], bins, around[at:]]), np.concatenate([told[:at], lines, told[at:]])))
    return out


def line_bins(docs: DataFrame, max_lines: int) -> DataFrame:
    """doc_id, label, bins (bytes of an int16 matrix): lines of the whole text, or ``max_lines`` running ones from a
    place that depends on the text."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run in slices(batch.column(2)):
                _, lines = read(run, SYMBOLS)
                for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True):
                    if b - a > max_lines:
                        a += zlib.crc32(lines.bins[a:b].tobytes()) % (b - a - max_lines + 1)
                        b = a + max_lines
                    out.append(lines.bins[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "bins"])

    return docs.select("doc_id", "label", "text").mapInArrow(mapped, "doc_id long, label int, bins binary")


def train(docs: DataFrame, labels: DataFrame, per_label: int = 750, max_lines: int = 200) -> Field:
    """Fits the field to a bounded sample of labelled documents.

    labels: doc_id, quality (1: good, 0: poor; null rows are left out).  The
    sample has about ``per_label`` documents of each label, those of the lowest
    crc32 of doc_id, and of each at most ``max_lines`` running lines; of rows
    with one doc_id one counts.  Without labels every line is content.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    share = {r["label"]: min(1.0, per_label / r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Field(np.zeros((WIDTH, 2)), np.zeros((2, 2)))
    below = F.lit(0.0)
    for label, part in sorted(share.items()):
        below = F.when(F.col("label") == label, F.lit(part * 2.0**32)).otherwise(below)
    chosen = F.broadcast(known.where(crc_of("doc_id") <= below))  # about per_label rows of each label
    rows = line_bins(docs.select("doc_id", "text").join(chosen, "doc_id"), max_lines).groupBy("doc_id", "label").agg(F.min("bins").alias("bins")).collect()
    found = [(np.frombuffer(r["bins"], np.int16).reshape(-1, len(BINS)).astype(np.int64), r["label"]) for r in sorted(rows, key=lambda r: (r["label"], r["bins"])) if r["bins"]]
    marked = mark(found)
    return fit(marked + joined(marked, found))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def score(docs: DataFrame, field: Field, least_share: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Per row: counts, base_failed, the share of its words on content lines, and kept (columns RESULT).

    base_failed: under 50 words, or over half of them in repeated three-word
    windows.  A null or blank text has no words and is not kept.  Repeated rows
    and null ids give a row each; an empty table gives none; texts of any length
    are read whole.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch.column(1)):
                facts, lines = read(run, SYMBOLS)
                n = len(run)
                content, marked = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i in range(n):
                    a, b = lines.first[i], lines.first[i + 1]
                    if b > a:
                        label = field.viterbi(lines.bins[a:b])
                        content[i] = int((lines.words[a:b] * label).sum())
                        marked[i] = int(label.sum())
                failed = (facts.n_words < 50) | (100 * facts.n_repeat_words > 50 * facts.n_words)
                share = content / np.maximum(facts.n_words, 1)
                kept = ~failed & (share >= least_share)
                cols = [facts.n_words, facts.word_chars, facts.n_symbols, facts.n_dup_lines, facts.n_repeat_words, failed, kept, share, np.diff(lines.first), marked]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, n), *(pa.array(c) for c in cols)], names)

    return docs.select(key, "text").mapInArrow(mapped, RESULT)


def keep_quality(docs: DataFrame, field: Field, least_share: float = 0.5) -> DataFrame:
    """The rows of docs that ``score`` keeps, with all their columns, in the tasks that read them."""
    place = docs.columns.index("text")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for run in slices(batch.column(0).field(place)):
                facts, lines = read(run, SYMBOLS)
                for i in range(len(run)):
                    a, b, n = lines.first[i], lines.first[i + 1], int(facts.n_words[i])
                    if n >= 50 and 100 * facts.n_repeat_words[i] <= 50 * n:
                        kept[run.first + i] = (lines.words[a:b] * field.viterbi(lines.bins[a:b])).sum() >= least_share * n
            yield batch.filter(pa.array(kept))

    rows = as_struct(docs)
    return rows.mapInArrow(mapped, rows.schema).select("doc.*")
