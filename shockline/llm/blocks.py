"""Blocks of whole documents, written once to the shared folder.

Operators that look at the texts twice (to count, and to use the counts) need
the same blocks both times; a written table gives them, whatever is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.llm.shared import cut
from shockline.llm.text import SLICE_BYTES, Run, slices

COLUMNS = "block long, doc_ids array<long>, offsets binary, size long, data binary"


def block_size(text_bytes: int, least: int = 2 << 20, most: int = 16 << 20) -> int:
    """Bytes of a block: ``least`` up to 1 GB of texts, and beyond that with the root of their size up to ``most``.

    Blocks are looked up in fragments whose number grows with the texts; larger blocks keep a fragment's share of a
    block from becoming a handful of n-grams.  ``most`` bounds a task's memory.
    """
    return int(min(most, least * max(1.0, text_bytes / (1 << 30)) ** 0.5))


def write_blocks(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """block, doc_ids, offsets, size, data (compressed texts side by side) of about ``block_bytes`` each, by default
    ``block_size`` of all texts."""
    if block_bytes is None:
        block_bytes = block_size(docs.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        ends = [0]

        def flush() -> pa.RecordBatch:
            nonlocal at
            data = b"".join(parts)
            cols = [pa.array([at]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(ends, np.int64).tobytes()]), pa.array([len(data)])]
            packed = pa.compress(data, codec="zstd", asbytes=True)
            at += 1
            ids.clear()
            parts.clear()
            del ends[1:]
            return pa.RecordBatch.from_arrays([*cols, pa.array([packed], pa.binary())], [c.split()[0] for c in COLUMNS.split(", ")])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for run in slices(batch.column(1), block_bytes):
                if parts and ends[-1] + len(run.data) > block_bytes:
                    yield flush()
                ids += keys[run.first : run.first + len(run)]
                parts.append(run.data.tobytes())
                ends += (run.offsets[1:] + ends[-1]).tolist()
        if ids:
            yield flush()

    return cut(docs.select("doc_id", "text").mapInArrow(mapped, COLUMNS))


def open_block(offsets: bytes, size: int, data: bytes) -> Iterator[Run]:
    """The documents of a block in runs of a smaller size; Run.first is the first one's place in the block."""
    whole = np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    ends = np.frombuffer(offsets, np.int64)
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_BYTES, side="right")) - 1)
        yield Run(i, whole[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j
