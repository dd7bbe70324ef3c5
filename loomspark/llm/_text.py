"""Vectorised text primitives shared by the operators of this subpackage.

All of them work on one flat UTF-8 buffer of many texts plus offsets, so that a word, a k-gram or a line costs a few numpy
operations instead of a Python object. Buffers are cut into pieces of about ``PIECE_BYTES`` at text boundaries: memory is
bounded by the piece or by the largest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21
U64 = np.uint64


def byte_table(pattern: bytes, invert: bool = False) -> np.ndarray:
    """A table of 256 booleans that is true for the bytes given, or for all others."""
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern, np.uint8)] = True
    return ~table if invert else table


#: Words are maximal runs of characters that are not ASCII white space.
SPACED_WORD = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", invert=True)
#: Words are maximal runs of ASCII letters, digits and all non-ASCII characters.
ALNUM_WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most ``limit`` bytes (or one longer text): rows, bytes, offsets."""
    flat, off = utf8(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield slice(at, end), flat[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a text: starts, ends and, by text, the offsets of its runs."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    heads = off[:-1][off[:-1] < np.append(off[1:], n)[: len(off) - 1]]
    first = member.copy()
    first[1:] &= ~member[:-1]
    first[heads] = member[heads]
    last = member.copy()
    last[:-1] &= ~member[1:]
    tails = heads[heads > 0] - 1
    last[tails] = member[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def run_codes(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """From byte strings in a row and their lengths: the number of each one's kind, and the kinds."""
    if not len(lens):
        return np.zeros(0, np.int64), []
    bounds = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=bounds[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def run_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte strings in a row; each kind of string is hashed once, by BLAKE2b."""
    codes, kinds = run_codes(data, lens)
    return np.frombuffer(b"".join(blake2b(k, digest_size=8).digest() for k in kinds), U64)[codes]


PRIME = U64((1 << 61) - 1)
_LOW = U64((1 << 31) - 1)


def mod_prime(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW, b >> U64(31), b & _LOW
    middle = a1 * b0 + a0 * b1  # below 2**62
    # a1 * b1 stands for its product with 2**62, which is 2.
    return mod_prime(mod_prime(a1 * b1 * U64(2)) + (middle >> U64(30)) + mod_prime(((middle & U64((1 << 30) - 1)) << U64(31)) + a0 * b0))


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    """Powers of the base modulo the prime, by doubling."""
    out = np.ones(1, U64)
    while len(out) < size:
        out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), int(PRIME)), U64))])
    return out[:size]


class SubstringHash:
    """Hashes modulo the prime 2**61 - 1 of any substrings of a buffer, from prefix sums.

    For a base drawn at random, two different strings of n bytes collide with a probability of at most n / 2**61.
    Substrings are of less than 2**23 bytes.
    """

    BASES = (0x1B32A7C64F2E9D05, 0x0C9F3E8D57A1642B)

    def __init__(self, data: np.ndarray, which: int = 0):
        self.n = len(data)
        size = PIECE_BYTES // 2
        while size < self.n:
            size *= 2
        base = self.BASES[which]
        up = _powers(base, size)[: self.n]
        self.down = _powers(pow(base, -1, int(PRIME)), size)
        value = data.astype(U64) + U64(1)
        # Of sums modulo 2**64 the differences are exact: each is below 2**23 * 2**41.
        self.low, self.high = np.zeros(self.n + 1, U64), np.zeros(self.n + 1, U64)
        np.cumsum(value * (up & _LOW), out=self.low[1:])
        np.cumsum(value * (up >> U64(31)), out=self.high[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = self.low[end] - self.low[start], mod_prime(self.high[end] - self.high[start])
        high = times(high, np.full(1, 1 << 31, U64))
        total = mod_prime(mod_prime(low) + high)
        return mix(times(total, self.down[start]) + (mix((end - start).astype(U64)) << U64(61)))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, for each start that has n words after it in the array."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, U64(n * 0x2545F4914F6CDD1D % (1 << 64)), U64)
    for i in range(n):
        out = (out ^ words[i : i + m]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return mix(out)


def whole(start_of: np.ndarray, n: int) -> np.ndarray:
    """Which n-gram starts stay within a text, given the offsets of the texts' words."""
    total = int(start_of[-1])
    inside = np.zeros(max(0, total), bool)
    lens = np.diff(start_of)
    keep = np.maximum(lens - n + 1, 0)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, start_of[:-1], (keep > 0).astype(np.int64))
    np.add.at(edge, start_of[:-1] + keep, -(keep > 0).astype(np.int64))
    inside[:] = np.cumsum(edge[:-1]) > 0 if total else False
    return inside[: max(0, total - n + 1)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty ones are 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
