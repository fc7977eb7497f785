"""Encoding with the vocabulary files of public tokenizers, word by word.

Both encoders split a text where no token can span, so each distinct word is
encoded once and found in a bounded memo after that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shockline.llm.text import LOWER, WHITE, Run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """word -> value, in two generations of bounded size: words in use stay, the others go."""

    def __init__(self, make, most: int = 600_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value

    def age(self):
        """Between texts: a full generation becomes the old one."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


# Kinds of bytes for WordBpe's cuts: white space, ASCII letters, digits, signs, the apostrophe, all others.
_BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(6)
KIND = np.full(256, _OTHER, np.uint8)
KIND[[b for b in range(33, 127)]] = _SIGN
KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
KIND[48:58], KIND[39], KIND[WHITE] = _DIGIT, _QUOTE, _BLANK
#: BEGINS[8 * kind + next kind]: a word begins at the second byte.
BEGINS = np.zeros(64, bool)
for _kind, _then in {
    _BLANK: (_LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER),
    _LETTER: (_DIGIT, _SIGN, _QUOTE),
    _DIGIT: (_LETTER, _DIGIT, _SIGN, _QUOTE),
    _SIGN: (_LETTER, _DIGIT),
    _QUOTE: (_DIGIT,),  # letters may be the rest of a contraction
}.items():
    BEGINS[[8 * _kind + k for k in _then]] = True


class WordBpe:
    """Ids of a tokenizers file whose pre-tokenizer drops white space, as little-endian unsigned 32-bit bytes.

    A run of texts is cut at white space and between letters, digits and signs,
    where the pre-tokenizer always cuts, Arrow numbers its distinct words, and
    the ids of those are dealt out to all places.
    """

    _made: dict[str, "WordBpe"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(lambda word: self._raw(word.decode()), 100_000)
        vocab = self.tokenizer.get_vocab()
        # Special tokens are found before letters are lowered, and only as they are written.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for t in special]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> "WordBpe":
        """One per path and worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone are one pre-token each: they are encoded together and parted at word ends."""
        for i in range(0, len(words), 20_000):
            part = [w for w in words[i : i + 20_000] if (t := w.decode()).isalpha() and (t.isascii() or t.lower().isalpha())]
            if not part:
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                continue  # some letter isn't one to the tokenizer; each word is then encoded by itself
            body, begin = ids.tobytes(), 0
            for w, end in zip(part, (4 * cuts).tolist(), strict=True):
                self.memo[w] = body[begin:end]
                begin = end

    def _bodies(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct words."""
        memo = self.memo
        memo.age()
        found = list(map(memo.get, words))
        missing = [k for k, body in enumerate(found) if body is None]
        self._learn([words[k] for k in missing if words[k] not in memo.old])
        for k in missing:
            found[k] = memo[words[k]]
        return found

    def _words(self, run: Run, low: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, numbered; the number of words before each text, and of all."""
        kind = KIND[low]
        # Letters of two bytes from U+00C0 to U+00FF: all but the signs of multiplication and division.
        lead = np.flatnonzero(low == 0xC3)
        lead = lead[(low[lead + 1] != 0x97) & (low[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        inside = kind != _BLANK
        begins = np.empty(len(low), bool)
        begins[1:] = BEGINS[8 * kind[:-1] + kind[1:]]
        edge = run.offsets[:-1][run.offsets[:-1] < len(low)]
        begins[edge] = inside[edge]
        body = low[inside]
        at = np.append(np.flatnonzero(begins[inside]), len(body)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])
        return words.dictionary_encode(), np.searchsorted(np.flatnonzero(begins), run.offsets)

    def encode_run(self, run: Run) -> list[bytes]:
        """The ids of each text, without special tokens added."""
        n = len(run)
        if not len(run.data):
            return [b""] * n
        low = LOWER[run.data]  # A-Z only; the tokenizer sees to the rest
        plain = low.tobytes()
        edges = run.offsets.tolist()
        special = set()
        if any(s in plain for s in self.special):
            special = {i for i in range(n) if any(plain.find(s, edges[i], edges[i + 1]) >= 0 for s in self.special)}
        # A letter before anything from U+0300 on stays as it is: the tokenizer composes first, and with some marks lower case alone composes.
        mark = np.flatnonzero(run.data[1:] >= 0xCC)
        low[mark] = run.data[mark]
        words, first = self._words(run, low)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        bodies = self._bodies(distinct)
        store = np.frombuffer(b"".join(bodies), "<u4")
        held = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        number = words.indices.to_numpy()
        each = held[number]
        to = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=to[1:])
        # Where a place's ids lie in the store, less where they go.
        shift = (np.cumsum(held) - held)[number] - to[:-1]
        ids = store[np.repeat(shift, each) + np.arange(to[-1])].tobytes()
        cuts = (4 * to[first]).tolist()
        return [self._raw(run.text(i)) if i in special else ids[cuts[i] : cuts[i + 1]] for i in range(n)]

    def forget(self) -> None:
        """Gives the memo's memory back: a worker process is used again by other stages."""
        self.memo.clear()
        self.memo.old = {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens added."""
        bodies = [t.encode() for t in texts]
        offsets = np.zeros(len(bodies) + 1, np.int64)
        np.cumsum([len(b) for b in bodies], out=offsets[1:])
        return self.encode_run(Run(0, np.frombuffer(b"".join(bodies), np.uint8), offsets))
