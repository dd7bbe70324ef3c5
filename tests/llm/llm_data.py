"""Rows and texts for the tests of this folder."""

import random


WORDS = [f"{a}{b}{c}" for a in "bdfglmprst" for b in "aeiou" for c in ("n", "r", "st", "")]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + ("." if draw.random() < 0.1 else "") for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) if draw.random() < share else w for w in text.split(" "))


def awkward_rows() -> list[tuple]:
    base, long = prose(1, 300), "\n".join(prose(100 + i, 40) for i in range(600))
    personal = "Write to ann.lee@mail.example.org or call +49 (30) 1234-5678 from 10.0.0.255, card 4111 1111 1111 1111. "
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # a copy
        (3, edited(base, 2, 0.02), "en", "b", 1),
        (4, base, "en", "a", 1),
        (4, base, "en", "a", 1),  # a repeated row
        (5, None, "en", "a", None),
        (6, "", None, "a", 0),
        (7, " \t\n\r ", "fr", None, 5),
        (8, "one", "fr", "c", 3),
        (9, "one two", None, "c", 7),
        (10, long, "de", "a", len(long)),
        (11, "x" * 60_000, "de", "c", 60_000),  # one very long word
        (12, "9" * 30_000, "de", "c", 1),
        (13, "a b " * 5_000, "es", "c", 1),
        (14, "漢字かな交じり文 " * 300 + "ÉÀ ß é 𝒳 😀", "es", "c", 1),
        (15, "#*$%&|<> " * 80, "es", "c", 1),
        (16, (personal + prose(5, 60) + " ") * 5, "en", "d", 1),
        (17, personal + prose(6, 80), "en", "d", 1),
        (None, base, None, None, None),
        (None, None, None, None, None),
        (-3, prose(7, 120), "en", "d", 1),
        (1 << 62, long[5_000:60_000] + prose(8, 50), "de", "d", 1),
    ]
    return rows




def opposite_words() -> tuple[str, str]:
    """Two different words of 1,024 letters that polynomial hashes modulo a power of two can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))
