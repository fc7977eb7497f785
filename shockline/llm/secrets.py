"""Secret scanning with corpus-wide ownership.

Candidates are found in every text, then counted over the corpus: in how many
repositories and at how many owners does the same value occur?  A value copied
widely, over owners or over the repositories of few, is an example; one that
few hold looks live.  The documents table
has no repository column: ``owner`` is the column named (``source``), and each
document stands for a repository of its owner.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.shared import cut, join_facts
from shockline.llm.text import LOWER, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "opaque")

SPANS = "doc_id long, owner string, row string, kind string, start long, end long, value_hash string"

_run_chars = np.zeros(256, bool)
_run_chars[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def entropy(value: str) -> float:
    counts = np.bincount(np.frombuffer(value.encode("ascii"), np.uint8))
    p = counts[counts > 0] / len(value)
    return float(-(p * np.log2(p)).sum())


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the candidates in code points, by start, then kind.

    assign, access and hex are found leftmost and non-overlapping per kind.
    opaque: 20 characters or more with letters, digits and 3.5 bits of entropy a
    character, where no span of the other kinds overlaps.
    """
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = iter(sorted((a, b) for _, a, b, _ in found))
    a, b = next(taken, (len(text), len(text)))
    for m in OPAQUE.finditer(text):
        v = m[0]
        while b <= m.start() < len(text):  # both lists are in order, so each is gone through once
            a, b = next(taken, (len(text), len(text) + 1))
        if a < m.end():
            continue
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and entropy(v) >= 3.5:
            found.append(("opaque", m.start(), m.end(), v))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def worth(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents of a run may hold a candidate: a run of 16 value characters, or a cue."""
    n = len(offsets) - 1
    may = np.zeros(n, bool)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _run_chars[data]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = (end - begin) >= 16
    for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        i = int(np.searchsorted(offsets, b, side="right")) - 1
        while i < n and offsets[i] < e:  # a run may cross from one document to the next
            may[i] = True
            i += 1
    whole = LOWER[data].tobytes()
    for cue in CUES:
        at = whole.find(cue)
        while at >= 0:
            may[int(np.searchsorted(offsets, at, side="right")) - 1] = True
            at = whole.find(cue, at + 1)
    return may


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row per candidate of each whole text (columns SPANS); ``row`` tells repeated rows apart by their text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owners = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for run in slices(batch.column(2)):
                for i in np.flatnonzero(worth(run.data, run.offsets)).tolist():
                    text = run.text(i)
                    if not (spans := find(text)):
                        continue
                    row = hashlib.md5(text.encode()).hexdigest()
                    for kind, a, b, value in spans:
                        out.append((ids[run.first + i], owners[run.first + i], row, kind, a, b, hashlib.sha256(value.encode()).hexdigest()))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SPANS.split(", ")])

    return docs.select("doc_id", F.col(owner).cast("string").alias("owner"), "text").mapInArrow(scan, SPANS)


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash -> n_spans, n_repos, n_owners.

    Counted per (value, owner, repository) and (value, owner) first, so a value copied everywhere is no hot key.
    """
    per_repo = spans.groupBy("value_hash", "owner", "doc_id").agg(F.count("*").alias("n_spans"))
    per_owner = per_repo.groupBy("value_hash", "owner").agg(F.sum("n_spans").alias("n_spans"), F.count("*").alias("n_repos"))
    return per_owner.groupBy("value_hash").agg(F.sum("n_spans").alias("n_spans"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, owner: str = "source", example_owners: int = 3, example_repos: int = 50) -> DataFrame:
    """Every candidate span with n_repos, n_owners, live and reported.

    A value is widely copied, an example, if ``example_owners`` owners have it,
    or ``example_repos`` repositories of whatever owners; others are live.
    Spans of assign, access and hex are always reported; the method adds the
    opaque ones that are live.  A null text or one without candidates has no
    row; a null owner counts as one owner; repeated rows of a doc_id count once
    as a repository; empty tables give no rows.  The texts are read once: the
    candidates, which are small, are written.
    """
    spans = cut(candidates(docs, owner))
    joined = join_facts(spans, cut(ownership(spans)), "value_hash", "n_spans").drop("n_spans", "common")
    live = joined.withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))
    return live.withColumn("reported", (F.col("kind") != "opaque") | F.col("live"))


def spans_of(found: DataFrame) -> DataFrame:
    """Per (doc_id, row): its spans in order, as an array of structs."""
    rank = F.expr("array_position(array({}), kind)".format(",".join(f"'{k}'" for k in KINDS)))
    one = F.struct(F.col("start"), rank.alias("rank"), "kind", "end", "live", "reported", "n_owners", "n_repos")
    return found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(one)).alias("spans"))


def with_spans(docs: DataFrame, keep: list[str], owner: str = "source", example_owners: int = 3, example_repos: int = 50) -> DataFrame:
    """doc (a struct of the columns of docs in ``keep``) and spans, an array that is empty where nothing was found.

    Nulls, repeated rows and further columns, whatever their names, stay.
    """
    per = spans_of(scan(docs, owner, example_owners, example_repos)).withColumnRenamed("doc_id", "id")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.col("doc_id").alias("of"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    same = F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row"))
    return keyed.join(per, same, "left").select("doc", F.coalesce("spans", F.array()).alias("spans"))


def redact(docs: DataFrame, owner: str = "source", example_owners: int = 3, example_repos: int = 50, mark: str = "[SECRET]") -> DataFrame:
    """docs whose live reported spans are replaced by ``mark``; overlapping spans by one.  Widely copied examples stay."""
    pieces = F.expr(
        f"""aggregate(filter(spans, s -> s.live and s.reported),
            named_struct('at', 0L, 'out', ''),
            (acc, s) -> if(s.end <= acc.at, acc, named_struct('at', s.end,
                'out', concat(acc.out, if(s.start >= acc.at, concat(substring(doc.text, int(acc.at + 1), int(s.start - acc.at)), '{mark}'), '')))),
            acc -> concat(acc.out, substring(doc.text, int(acc.at + 1))))"""
    )
    text = F.when(F.exists("spans", lambda s: s["live"] & s["reported"]), pieces).otherwise(F.col("doc.text"))
    found = with_spans(docs, docs.columns, owner, example_owners, example_repos)
    return found.select(*(text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def digest(docs: DataFrame, owner: str = "source", example_owners: int = 3, example_repos: int = 50) -> DataFrame:
    """The result of op3: counts and joined spans per document; n_repos and n_owners are those of its most copied value."""
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    kept = F.filter("spans", lambda s: s["reported"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    most = lambda name: F.coalesce(F.array_max(F.transform("spans", lambda s: s[name])), F.lit(0)).alias(name)
    return with_spans(docs, ["doc_id"], owner, example_owners, example_repos).select(
        "doc.doc_id",
        *(n(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(kept).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"] & s["reported"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
        most("n_repos"),
        most("n_owners"),
    )
