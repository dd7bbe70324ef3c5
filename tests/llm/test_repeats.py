import hashlib
import random
from collections import Counter

import numpy as np
from llm_data import SHAPE, awkward_rows, opposite_words, prose

from loomspark.llm.repeats import op8_repeated_bytes, repeated_bytes
from loomspark.llm.spans import repeated_columns


def brute(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = Counter()
    for r, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[r[0], len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_small_alphabets_match_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(250):
        kind = draw.choice(["ab", "abcdefgh", "aé", "x"])
        rows.append((i, "".join(draw.choice(kind) for _ in range(draw.randrange(0, 200))), "en", "a", 1))
    shared = prose(1, 60)
    for i in range(60):
        a, b = sorted(draw.sample(range(len(shared)), 2))
        rows.append((1_000 + i, prose(10 + i, 5) + shared[a:b] + prose(500 + i, 5), "en", "a", 1))
    df = spark.createDataFrame(rows, SHAPE)
    for length, gram, block, group, task in ((20, 4, 4, 20_000, 50_000), (33, 8, 7, 20_000, 10), (20, 4, 4, 30, 100), (33, 12, 7, 2, 100), (33, 12, 7, 0, 100)):
        assert got(repeated_bytes(df, length, gram, block, group, task)) == brute(rows, length), (length, group)


def test_columns_find_equal_windows():
    """Pieces laid under each other by column, against all pairs."""
    draw = np.random.default_rng(4)
    for length in (1, 3, 6):
        for _ in range(60):
            m = int(draw.integers(1, 12))
            group, lo, size = np.sort(draw.integers(0, 3, m)), draw.integers(0, 5, m), draw.integers(length, length + 8, m)
            off = np.append(0, np.cumsum(size))
            d = draw.integers(0, 2, off[-1]).astype(np.uint8)
            piece, place = repeated_columns(d, off, group, lo, length)
            windows = [(group[i], lo[i] + j, d[off[i] + j : off[i] + j + length].tobytes(), i, j) for i in range(m) for j in range(size[i] - length + 1)]
            often = Counter(w[:3] for w in windows)
            assert sorted(zip(piece.tolist(), place.tolist(), strict=True)) == sorted((i, j) for *w, i, j in windows if often[tuple(w)] > 1)


def test_one_passage_in_many_settings(spark):
    """A passage shorter and one longer than a window, each in hundreds of texts: groups that are cut into blocks and windows."""
    rows = [(i, prose(i, 30) + " " + prose(9_001, 30)[:150] + " " + prose(5_000 + i, 30), "en", "a", 1) for i in range(150)]
    rows += [(1_000 + i, prose(20_000 + i, 8 + i % 9) + prose(9_002, 60)[: 196 + i % 12] + prose(30_000 + i, 8), "en", "a", 1) for i in range(150)]
    df = spark.createDataFrame(rows, SHAPE)
    for group in (20_000, 20):
        assert got(repeated_bytes(df, group=group)) == brute(rows, 200)


def test_production_parameters(spark):
    draw = random.Random(6)
    passages = [prose(i, 80) for i in range(4)]
    rows = []
    for i in range(150):
        text = prose(100 + i, draw.randrange(1, 120))
        p = draw.choice(passages)
        a = draw.randrange(0, 60)
        rows.append((i, text + p[a : a + draw.randrange(190, 600)] + prose(400 + i, draw.randrange(1, 80)), "en", "a", 1))
    rows += [(900, "ab" * 400, "en", "a", 1), (901, prose(77, 50) + "\n" + prose(77, 50), "en", "a", 1), (902, rows[0][1], "en", "a", 1)]
    rows += [(903 + i, w, "en", "a", 1) for i, w in enumerate(opposite_words())] + [(906, rows[0][1], "en", "a", 1)] * 2
    assert got(repeated_bytes(spark.createDataFrame(rows, SHAPE))) == brute(rows, 200)


def test_awkward_rows(spark, awkward):
    assert got(op8_repeated_bytes(spark, awkward)) == brute(awkward_rows(), 200)


def test_empty(spark, empty):
    assert op8_repeated_bytes(spark, empty).count() == 0
