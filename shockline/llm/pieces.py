"""Exact encoding with a SentencePiece BPE model by backtracking.

Longest matches come from an Aho-Corasick automaton over the pieces.  A token
may follow another if merging the text of the two gives the same two again; a
dead end marks its position in a bitfield and goes back to a shorter token.
Merges never join a non-space to a following space sign or reach over a
character that no piece has, so a text is cut there and each distinct part is
encoded once (as long as it stays in a bounded memo).  Time grows with the
length of a part, whatever it repeats.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shockline.llm.text import slices
from shockline.llm.tokens import Memo

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceBpe:
    _made: dict[str, "PieceBpe"] = {}

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.name != "identity":
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.byte_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        n = len(self.text)
        self.size = [len(t) for t in self.text]
        self.age = [-1] * n  # rank of the merge that makes a token; -1: a single character
        self.halves = [(i, i) for i in range(n)]
        self.shorter = [-1] * n  # the longest other token that a token begins with
        valid: set[str] = set()
        for piece, i in self.ids.items():
            *_, last = self.merge_steps(piece)
            if len(last) == 1 and last[0] == piece:  # others are never the outcome of merges
                valid.add(piece)
        for piece in valid:
            i = self.ids[piece]
            if len(piece) > 1:
                before = [s for s in self.merge_steps(piece) if len(s) == 2][-1]
                self.age[i], self.halves[i] = int(self.rank[piece]), (self.ids[before[0]], self.ids[before[1]])
                self.shorter[i] = next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in valid), -1)
        self.automaton = ahocorasick.Automaton()
        for piece in valid:
            self.automaton.add_word(piece, (len(piece) - 1, self.ids[piece]))
        self.automaton.make_automaton()
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self._part, 300_000)

    @classmethod
    def of(cls, path: str) -> "PieceBpe":
        """One per path and worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merge_steps(self, text: str) -> Iterator[list[str]]:
        """The parts of a short text before, between and after its merges."""
        rank, parts = self.rank, list(text)
        yield list(parts)
        while len(parts) > 1:
            ranked = [(r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
            if not ranked:
                return
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            yield list(parts)

    def merge(self, text: str) -> list[str]:
        """The outcome of merging single characters, best rank first, leftmost among equals."""
        rank = self.rank
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, whole = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or parts[k] + parts[j] != whole:
                continue
            parts[k], parts[j] = whole, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of two tokens gives the same two again.

        The merges that made them are gone through from the last to the first:
        if the parts that met at the border would have merged before the next
        merge on either side, the border is not one.
        """
        rank, text, age, halves = self.rank, self.text, self.age, self.halves
        limit = float("inf")
        while True:
            whole = rank.get(text[a] + text[b])
            if whole is not None and whole < limit:
                return False
            if age[a] > age[b]:
                limit, a = age[a], halves[a][1]
            elif age[b] < 0:
                return True
            else:
                limit, b = age[b] + 0.5, halves[b][0]  # among equals the left one merges first

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()]

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text without two adjacent space signs."""
        n, size, shorter, pairs = len(text), self.size, self.shorter, self.pairs
        longest = [-1] * n
        for end, (less, token) in self.automaton.iter(text):
            longest[end - less] = token
        stops = [k for k, token in enumerate(longest) if token < 0]
        stops.append(n)
        dead = bytearray(n // 8 + 1)  # a bit per position: no way on from there
        out: list[int] = []
        begin = 0
        for stop in stops:  # between characters that no piece has
            stack: list[int] = []
            pos, token, last = begin, longest[begin] if begin < stop else -1, -1
            while pos < stop:
                while token >= 0:
                    to = pos + size[token]
                    if not dead[to >> 3] >> (to & 7) & 1:
                        if last < 0:
                            break
                        ok = pairs.get((last, token))
                        if ok is None:
                            ok = pairs[last, token] = self.fits(last, token)
                        if ok:
                            break
                    token = shorter[token]
                if token >= 0:
                    stack.append(token)
                    pos += size[token]
                    last, token = token, longest[pos] if pos < stop else -1
                else:
                    dead[pos >> 3] |= 1 << (pos & 7)
                    token = stack.pop()
                    pos -= size[token]
                    last, token = stack[-1] if stack else -1, shorter[token]
            out += stack
            if stop < n:
                out += self._bytes(text[stop])
            begin = stop + 1
        return out

    def age_memos(self) -> None:
        self.memo.age()
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()

    def _direct(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.merge(text):
            i = self.ids.get(p)
            out += self._bytes(p) if i is None else [i]
        return out

    def _part(self, part: str) -> tuple[str, bytes]:
        end = len(part)
        while end > 2 and not part[end - 1].isalnum() and part[end - 2 : end] not in self.joins:  # no piece reaches over here
            end -= 1
        if end < len(part):
            each = [self.memo[part[:end]], *map(self.memo.__getitem__, part[end:])]
            return ",".join([ids for ids, _ in each]), b"".join([back for _, back in each])
        # Runs of space signs have merges of equal rank, for which pairs don't decide.
        ids = self._direct(part) if SPACE + SPACE in part else self.backtrack(part)
        return ",".join(map(str, ids)), self.decode_pieces(ids)

    def decode_pieces(self, ids: list[int]) -> bytes:
        return b"".join([bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].replace(SPACE, " ").encode() for i in ids])

    def parts(self, text: str) -> list[str]:
        return PART.findall((SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in self.memo[p][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        out = self.decode_pieces(ids)
        if self.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", errors="replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        found = list(map(self.memo.__getitem__, self.parts(text)))
        ids = ",".join([f[0] for f in found])
        back = b"".join([f[1] for f in found])
        if self.dummy_prefix and back[:1] == b" ":
            back = back[1:]
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids: the ids of every whole text.  Null and empty texts have none; repeated rows give a row each."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(model)
        for batch in batches:
            for run in slices(batch.column(1)):
                bpe.age_memos()
                ids = [bpe.encode(run.text(i)) for i in range(len(run))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, len(run)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(mapped, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and RESULT for every whole text, encoded and decoded in one pass.

    Null and empty texts have 0 tokens.  Texts of any length and runs of any
    character are encoded whole; repeated rows and null ids give a row each;
    further columns are ignored; an empty table gives no rows.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(model)
        for batch in batches:
            for run in slices(batch.column(1)):
                bpe.age_memos()
                n, ids, back = zip(*(bpe.digest(run.text(i)) for i in range(len(run))), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, len(run)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(mapped, f"doc_id long, {RESULT}")
