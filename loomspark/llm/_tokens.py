"""Exact token ids of a byte-level BPE file, fast.

The tokenizers library encodes each distinct chunk once; texts are put together from the chunks' ids. A text is cut only
where no token can span and where the encoding of neither side depends on the other: before a single space or line feed
between two visible characters, after such a line feed, and between a letter and common punctuation. Everything else,
such as runs of white space or scripts without spaces, stays in one chunk and is encoded by the library as it is.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from loomspark.llm._text import PIECE_BYTES, pieces

#: Distinct chunks kept by a worker; beyond it, the memory starts anew. It bounds memory and never changes a result.
REMEMBERED = 700_000

_B = np.arange(256)
_VISIBLE = (_B > 0x20) & (_B < 0x7F)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_PUNCTUATION = np.isin(_B, np.frombuffer(b".,;:!?|", np.uint8))
_TWO = (_B >= 0xC3) & (_B <= 0xDF)


def cuts(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start positions of chunks, text starts included."""
    n = len(d)
    before, before2, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], before2[2:], after[:-1] = d[:-1], d[:-2], d[1:]
    single = (_VISIBLE[before] | _TWO[before2]) & (_VISIBLE[after] | _TWO[after])
    cut = (d == 32) & single
    line = (d == 10) & single
    cut |= line
    cut[1:] |= line[:-1]
    cut |= _PUNCTUATION[d] & (_LETTER[before] | ((before2 == 0xC3) & (before != 0x97) & (before != 0xB7)))
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes with the tokenizers library, remembering the ids of chunks seen.

    The strings of special tokens are ordinary text, unless ``added`` is set: then a text that holds the string of an added
    token is encoded by the library as a whole, as its file says. New chunks that begin with a space and end visibly are encoded in a
    row, since they would be cut there again; the ids' byte lengths tell them apart afterwards.
    """

    def __init__(self, path: str, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.whole = Tokenizer.from_file(path)
        self.literals = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.content] if added else []
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # each byte is one character of a byte-level token
            self.n_bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        plain, odd = [], []
        for c in chunks:
            (plain if len(c) > 1 and c[0] == 32 and _VISIBLE[c[1]] and _VISIBLE[c[-1]] else odd).append(c)
        flat, lens = [], []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self._ids([b"".join(part).decode()])[0], np.uint32)
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))) + 1
            flat.append(ids)
            lens.append(np.diff(ends, prepend=0))
        for i in range(0, len(odd), 4096):
            lists = self._ids([c.decode() for c in odd[i : i + 4096]])
            lens.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(lens[-1].sum())))
        length = np.concatenate(lens)
        self.known.update(zip(plain + odd, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.ids = np.concatenate([self.ids, *flat])

    def encode(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts among them."""
        ids, bounds = self._chunked(d, off)
        own = self._holding(d, off)
        if not own:
            return ids, bounds
        told = self.whole.encode_batch_fast([d[off[i] : off[i + 1]].tobytes().decode() for i in own], add_special_tokens=False)
        lens, parts, at = np.diff(bounds), [], 0
        for i, e in zip(own, told, strict=True):
            parts += [ids[at : bounds[i]], np.array(e.ids, np.uint32)]
            lens[i], at = len(e.ids), bounds[i + 1]
        return np.concatenate([*parts, ids[at:]]), np.append(0, np.cumsum(lens))

    def _holding(self, d: np.ndarray, off: np.ndarray) -> list[int]:
        """The texts that hold the string of an added token."""
        found, data = set(), d.tobytes() if self.literals else b""
        for literal in self.literals:
            at = data.find(literal)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                if at + len(literal) <= off[i + 1]:
                    found.add(i)
                at = data.find(literal, at + 1)
        return sorted(found)

    def _chunked(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(d):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        at = cuts(d, off)
        bounds = np.append(at, len(d)).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(d))]).dictionary_encode()
        words = chunks.dictionary.to_pylist()
        number = list(map(self.known.get, words))
        new = [w for w, k in zip(words, number, strict=True) if k is None]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = words
            self._learn(new)
            number = list(map(self.known.__getitem__, words))
        number = np.array(number, np.int64)[chunks.indices.to_numpy()]
        lens = self.length[number]
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.start[number] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        return ids, np.append(0, ends)[np.searchsorted(at, off)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, added=True)


def encoded(column: pa.Array, path: str):
    """For runs of texts: rows, ids, offsets."""
    own = encoder(path)
    for rows, d, off in pieces(column, 2 * PIECE_BYTES):
        yield rows, *own.encode(d, off)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
