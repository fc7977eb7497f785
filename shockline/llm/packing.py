"""Cost-balanced packing of documents into training sequences.

The cost of a sequence is ``linear * tokens + quadratic * sum(piece tokens ** 2)``:
attention stays within a piece.  Within a block of documents, pieces go in
descending length to the sequence of the lowest cost that has room.  A block's
sequences hold exactly its tokens: as many of ``capacity`` as fit, and the rest
in sequences of power-of-two lengths, which need no padding.  A piece that fits
nowhere whole is cut over the rooms that are left.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shockline.llm.text import slices
from shockline.llm.tokens import WordBpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def rooms_for(tokens: int, capacity: int) -> list[int]:
    """Lengths of the sequences that hold exactly so many tokens."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1]


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """(document, start, length, sequence, offset) of each piece; the sequences' lengths; their costs."""
    rooms = rooms_for(sum(lengths), capacity)
    left, cost = np.array(rooms, np.int64), np.zeros(len(rooms))
    placed: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        placed.append((doc, start, n, seq, rooms[seq] - int(left[seq])))
        left[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    pieces, at = [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            put(doc, k * capacity, capacity, at)
            at += 1
        if n % capacity:
            pieces.append((n % capacity, doc, whole * capacity))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    # Sequences by cost; one whose room is too small for this piece waits until pieces are smaller.
    ready = [(cost[s], s) for s in range(at, len(rooms))]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []  # (-room, sequence)
    over = []
    for n, doc, start in pieces:
        while waiting and -waiting[0][0] >= n:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (cost[s], s))
        while ready:
            _, s = heapq.heappop(ready)
            if left[s] >= n:
                put(doc, start, n, s)
                if left[s]:
                    heapq.heappush(ready, (cost[s], s))
                break
            heapq.heappush(waiting, (-int(left[s]), s))
        else:
            over.append((n, doc, start))
    free = [s for s in np.argsort(-left, kind="stable").tolist() if left[s]]
    for n, doc, start in over:
        while n:
            s = free[0]
            k = min(n, int(left[s]))
            put(doc, start, k, s)
            n, start = n - k, start + k
            if not left[s]:
                free.pop(0)
    return placed, rooms, cost.tolist()


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, block_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of all documents (columns PIECES), packed block by block inside the tasks that read them: nothing is shuffled.

    docs: doc_id, text (more columns are ignored).  A null text is empty and has
    the end id only, so every document, repeated rows too, has at least one
    piece; an empty table has none.  Texts of any length are encoded whole and
    cut into pieces of at most ``capacity``.  A null doc_id stays null.  A block
    ends once it has ``block_tokens`` tokens, which bounds a task's memory.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        bodies: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            lengths = [len(b) // 4 for b in bodies]
            placed, rooms, cost = pack(lengths, capacity, linear, quadratic)
            cols = [
                [ids[d] for d, *_ in placed],
                [s for _, s, *_ in placed],
                [n for _, _, n, *_ in placed],
                [zlib.crc32(bodies[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in placed],
                [lengths[d] for d, *_ in placed],
                [base + q for *_, q, _ in placed],
                [o for *_, o in placed],
                [rooms[q] for *_, q, _ in placed],
                [cost[q] for *_, q, _ in placed],
            ]
            base += len(rooms)
            ids.clear()
            bodies.clear()
            held = 0
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "sequence_cost" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for run in slices(batch.column(1)):
                for k, body in enumerate(bpe.encode_run(run), run.first):
                    ids.append(keys[k])
                    bodies.append(body + tail)
                    held += len(body) // 4 + 1
                    if held >= block_tokens:
                        yield flush()
        if bodies:
            yield flush()
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(packed, PIECES)
