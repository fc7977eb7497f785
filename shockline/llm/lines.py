"""Line-level deduplication over a whole corpus.

Every line is normalised and hashed; a hash's documents are counted; lines of
keys that too many documents hold are dropped everywhere but in one document;
what stays is put together again by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shockline.llm.shared import cut, join_facts
from shockline.llm.text import slices

#: What is stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
RESULT = [StructField("doc_id", LongType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType())]


def key_of(line: bytes) -> bytes:
    """The line's key: without outer blanks, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def line_hashes(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id, row, pos, key: a row per line whose key has ``least_chars`` code points.

    ``key`` is a hash of 128 bits, ``row`` one of the whole text, which tells rows of one doc_id apart.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch.column(2)):
                docs_at, places, keys = [], [], []
                whole = run.data.tobytes()
                for i in range(len(run)):
                    for pos, line in enumerate(whole[run.offsets[i] : run.offsets[i + 1]].split(b"\n")):
                        key = key_of(line)
                        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
                            docs_at.append(run.first + i)
                            places.append(pos)
                            keys.append(hashlib.blake2b(key, digest_size=16).digest())
                at = pa.array(docs_at, pa.int64())
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "pos", "key"])

    return keyed(docs).select("doc_id", "row", "text").mapInArrow(mapped, "doc_id long, row long, pos int, key binary")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, row, text (null: empty), and ``doc``, a struct of further columns, if any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = [F.struct(*(F.col(f"`{c}`") for c in more)).alias("doc")] if more else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"), *doc)


def widespread(lines: DataFrame, least_docs: int = 3) -> DataFrame:
    """key, n_docs, n_lines, largest (doc_id): the keys that ``least_docs`` documents or more hold.

    Counted per (key, doc_id) first, so that a line in every document is no hot
    key: what meets in the end are a task's sums.  Null ids are one document,
    smaller than all others.
    """
    per_doc = lines.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    per_key = per_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc_id").alias("largest"))
    return per_key.where(F.col("n_docs") >= least_docs)


def dropped_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """doc_id, row, dropped: the places (from 0) of the lines that go, for documents that lose any."""
    lines = cut(line_hashes(docs, least_chars))
    found = join_facts(lines, cut(widespread(lines, least_docs)), "key", "n_lines")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def kept_texts(docs: DataFrame, *more: str, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (what stays, joined by a line feed), and ``doc`` with the columns ``more``.

    Lines are parted at line feeds alone; a null or empty text is one empty
    line; a text that loses all lines is empty.  A key counts once per
    document, whatever the number of its lines and rows: rows that repeat a
    doc_id are one document, and so are null ids.  The document of the largest
    doc_id keeps all its lines of the key; ties of ids keep them in each row.
    Repeated rows give a row each, an empty table none.
    """
    gone = dropped_lines(docs, least_docs, least_chars).select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))
    rows = keyed(docs, *more).join(gone, same, "left")
    rows = rows.select("doc_id", "text", "dropped", *["doc"] * bool(more))
    schema = StructType([*RESULT, *rows.schema.fields[3:]])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch.column(1)):
                whole, part = run.data.tobytes(), [c.slice(run.first, len(run)) for c in batch.columns]
                texts, n_lines, n_gone = [], [], []
                for i, gone in enumerate(part[2].to_pylist()):
                    text = whole[run.offsets[i] : run.offsets[i + 1]]
                    n_lines.append(text.count(b"\n") + 1)
                    n_gone.append(len(gone or ()))
                    if gone:
                        out, lost = text.split(b"\n"), set(gone)
                        text = b"\n".join([x for k, x in enumerate(out) if k not in lost])
                    texts.append(text)
                cols = [part[0], pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *part[3:]]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(mapped, schema)


def dedup_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """docs, with all their columns whatever their names, without the lines that are found in too many documents.

    A null text becomes the empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    found = kept_texts(docs, *others, least_docs=least_docs, least_chars=least_chars)
    return found.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def digest(docs: DataFrame, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """The result of op13: lines before, lines dropped and the sha256 of what stays, per row of docs."""
    found = kept_texts(docs, least_docs=least_docs, least_chars=least_chars)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH parted AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parted),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
wide AS (
    SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.pos, k.line, w.key IS NOT NULL AND k.doc_id <> w.largest AS gone FROM keyed k LEFT JOIN wide w ON k.key = w.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
