"""Repeated byte strings: anchors, runs of windows, and their column-wise comparison (used by operator 8).

Every window of ``length`` bytes has an anchor, the last of its byte k-grams of least hash, which depends on the window's
bytes alone. Consecutive windows with one anchor form a run. Equal windows have equal anchors at equal distances, so the
pieces of text around equal anchors can be laid under each other, column under column.
"""

from __future__ import annotations

import numpy as np

from loomspark.llm._text import U64, mix


def gram_hashes(d: np.ndarray, gram: int) -> np.ndarray:
    """A cheap hash of every k-gram of bytes, in the upper half; it only places the anchors."""
    n = len(d) - gram + 1
    out = np.zeros(n, U64)
    if gram >= 8:
        eight = np.ndarray((len(d) - 7,), "<u8", np.ascontiguousarray(d), 0, (1,))
        for i in sorted({*range(0, gram - 8, 8), gram - 8}):
            out = (out ^ eight[i : i + n]) * U64(0x9FB21C651E98DF25)
            out ^= out >> U64(29)
    else:
        for i in range(gram):
            out = (out * U64(257)) + d[i : i + n].astype(U64) + U64(1)
    return mix(out) & U64(0xFFFFFFFF00000000)


def anchor_runs(d: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """By run: text, first window, last window, anchor (positions in the buffer)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    n = len(d) - length + 1
    if n <= 0:
        return none
    valid = np.zeros(n + 1, np.int64)
    lens = np.diff(off)
    some = lens >= length
    if not some.any():
        return none
    valid[off[:-1][some]] += 1
    valid[off[1:][some] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    width = length - gram + 1
    # Hash in the upper half; in the lower half, a later place is less.
    least = gram_hashes(d, gram)
    least |= U64(0xFFFFFFFF) - np.arange(len(least), dtype=U64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (U64(0xFFFFFFFF) - (least[at] & U64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return np.searchsorted(off, at[first], "right") - 1, at[first], at[last], anchor[first]


def repeated_columns(d: np.ndarray, off: np.ndarray, group: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur in two pieces at the same column: the piece, and the window's place in it.

    Pieces are given by their bytes, their group (ascending numbers) and the column of their first byte. The collection's
    sorted list of suffixes is built column by column, from the last: each round inserts one symbol before every piece's
    suffix, which sorts the list anew by symbol (a stable sort of the round's column of the Burrows-Wheeler transform), and
    brings the lengths of the common prefixes of neighbours up to date: one more than the least between the two places that
    a pair of neighbours comes from. Two suffixes that share ``length`` symbols begin with the same window.
    """
    m, size = len(group), np.diff(off)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    base = np.minimum.reduceat(lo, heads) if m else lo
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, m)))
    first = lo - base[number]
    columns = int((first + size).max()) if m else 0
    # Symbols by column; 0 beyond a piece's ends.
    symbols = np.zeros((columns, m), np.uint16)
    for j in range(int(size.max()) if m else 0):
        longer = np.flatnonzero(size > j)
        symbols[first[longer] + j, longer] = d[off[longer] + j].astype(np.uint16) + np.uint16(1)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int64)  # of each place and the one before it
    last = int(first.max()) + int((size - length).max()) if m else -1
    pieces_found, places = [], []
    for column in range(columns - 1, -1, -1):
        symbol = symbols[column][order]
        key = number * 512 + symbol  # groups stay where they are, so number[order] is number
        if np.any(key[1:] < key[:-1]):
            move = np.argsort(key, kind="stable")
            key, order = key[move], order[move]
            p, q = move[:-1], move[1:]
            shared = common[q]
            gaps = np.flatnonzero((key[1:] == key[:-1]) & (q > p + 1))
            if len(gaps):
                pairs = np.stack([p[gaps] + 1, q[gaps] + 1], axis=1).ravel()
                shared[gaps] = np.minimum.reduceat(common, pairs)[::2]
            common[1:m] = shared
        common[1:m] = np.where(key[1:] == key[:-1], common[1:m] + 1, 0)
        common[0] = common[m] = 0
        if column <= last:
            begun = np.flatnonzero(np.maximum(common[:-1], common[1:]) >= length)
            own = order[begun]
            own = own[(first[own] <= column) & (column + length <= first[own] + size[own])]
            pieces_found.append(own)
            places.append(column - first[own])
    if not pieces_found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pieces_found), np.concatenate(places)
