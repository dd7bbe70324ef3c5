"""Language identification by cross-parsing entropy (operator 1).

For each language a suffix automaton is built from a bounded sample of labelled text. A text is parsed greedily against
each automaton into the longest phrases that occur in the sample; the language that needs the fewest phrases, normalised
by the logarithm of its sample's length, wins. All blocks of a batch of texts are parsed in lockstep, one character a
step, so the whole text counts and the cost is a few array operations per character and language.

The sample is bounded by twice ``SAMPLE_TEXTS`` excerpts of ``EXCERPT`` characters a language, chosen by a hash of id and text
among all training rows; everything else covers all rows and whole texts. An automaton keeps every letter of its sample,
however many there are. Texts are parsed in blocks of ``BLOCK`` characters; a phrase ends with its block, or with a letter
that isn't in the sample, which counts as a phrase of its own.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if no row is labelled;
ties go to the language that comes first by name; a very long text is parsed
block by block; repeated rows are predicted alike and are one row of the sample; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._text import pieces

SAMPLE_TEXTS, EXCERPT = 48, 400
BLOCK, DENSE = 2048, 64
PIECE = 1 << 23


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """The suffix automaton of a sample over letter numbers: ways on its ``DENSE`` most frequent letters in a table, others sorted."""

    def __init__(self, text: str, code: dict[str, int]):
        seen: dict[str, int] = {}
        for c in text:
            seen[c] = seen.get(c, 0) + 1
        frequent = {c: i + 1 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))[: DENSE - 1])}
        self.column = np.zeros(len(code) + 1, np.uint8)  # 0: not in the table
        for c, i in frequent.items():
            self.column[code[c]] = i
        self.letters = len(code) + 1
        self.rare = np.zeros(self.letters, bool)
        states = automaton(text)
        table, keys, ends = np.zeros((len(states), DENSE), np.int32), [], []  # 0: no way on
        for i, ways in enumerate(states):
            for c, to in ways.items():
                if c in frequent:
                    table[i, frequent[c]] = to * DENSE
                else:
                    self.rare[code[c]] = True
                    keys.append(i * self.letters + code[c])
                    ends.append(to * DENSE)
        order = np.argsort(np.array(keys, np.int64))
        self.table, self.keys, self.ends = table.ravel(), np.array(keys, np.int64)[order], np.array(ends, np.int32)[order]

    def onward(self, state: np.ndarray, letter: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Where the letters lead from the states (in units of table rows); 0 if nowhere."""
        here = self.table[state + column]
        if len(self.keys) and len(at := np.flatnonzero(self.rare[letter])):
            wanted = (state[at] // DENSE).astype(np.int64) * self.letters + letter[at]
            i = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            here[at] = np.where(self.keys[i] == wanted, self.ends[i], 0)
        return here


class Parser:
    """The automata of all languages; each keeps every letter of its sample."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in samples]
        code = {c: i + 1 for i, c in enumerate(sorted({c for _, text in samples for c in text}))}
        self.kind = np.uint8 if len(code) < 256 else np.int32
        self.number = np.zeros(sys.maxunicode + 1, self.kind)  # 0: in no sample
        for c, i in code.items():
            self.number[ord(c)] = i
        self.automata = [Automaton(text, code) for _, text in samples]
        self.weight = np.array([math.log2(len(text) + 2) for _, text in samples])

    def phrases(self, blocks: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Phrases by language and block; blocks[i] is the i-th letter of each, by falling length."""
        count = np.zeros((len(self.names), len(lens)), np.int64)
        active = np.searchsorted(-lens, -np.arange(len(blocks)), "left")  # blocks longer than i
        for k, own_automaton in enumerate(self.automata):
            columns = own_automaton.column[blocks]
            state, own = np.zeros(len(lens), np.int32), count[k]
            for i in range(len(blocks)):
                m = active[i]
                here = own_automaton.onward(state[:m], blocks[i, :m], columns[i, :m])
                stuck = np.flatnonzero(here == 0)
                if len(stuck):
                    own[stuck] += 1
                    here[stuck] = own_automaton.onward(np.zeros(len(stuck), np.int32), blocks[i, stuck], columns[i, stuck])
                state[:m] = here
            own += state != 0
        return count


@lru_cache(2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def costs(model: Parser, texts: list[str]) -> np.ndarray:
    """The normalised phrases of each text in each language."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.cumsum(lens) - lens
    n = -(-lens // BLOCK)
    doc = np.repeat(np.arange(len(texts)), n)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin, size = off[doc] + part * BLOCK, np.minimum(BLOCK, lens[doc] - part * BLOCK)
    order = np.argsort(-size, kind="stable")
    doc, begin, size = doc[order], begin[order], size[order]
    letters = model.number[flat]
    blocks = np.zeros((int(size[0]) if len(size) else 0, len(size)), model.kind)
    for j in range(len(size)):
        blocks[: size[j], j] = letters[begin[j] : begin[j] + size[j]]
    found = model.phrases(blocks, size)
    return np.stack([np.bincount(doc, row, len(texts)) for row in found], axis=1) * model.weight


def _predict(samples: tuple[tuple[str, str], ...]):
    def run(batches):
        model = parser(samples)
        for batch in batches:
            for rows, d, off in pieces(batch.column(2), PIECE):
                texts = [d[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
                cost = np.maximum(costs(model, texts), 1e-9)
                best = cost.argmin(axis=1)
                score = (1 / cost[np.arange(len(cost)), best]) / (1 / cost).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array([model.names[i] for i in best], pa.string()), pa.array(score)], ["doc_id", "known", "lang", "score"])

    return run


def training_sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, excerpt: int = EXCERPT) -> tuple[tuple[str, str], ...]:
    """Text by language from (doc_id, text, lang): at most about 2 * texts different excerpts of each, whatever the number of rows."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = dict(usable.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    if not counts:
        return ()
    chance = F.when(F.lit(False), 0.0)
    for lang, n in counts.items():
        chance = chance.when(F.col("lang") == lang, min(1.0, 1.5 * texts / n))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30))
    rows = usable.where(draw / float(1 << 30) < chance).select("lang", F.substring(F.lower("text"), 1, excerpt).alias("text"), draw.alias("draw"))
    rows = rows.groupBy("lang", "text").agg(F.min("draw").alias("draw")).collect()  # bounded by texts: repeated rows are one
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, "\n".join(own[: 2 * texts])) for lang, own in sorted(found.items()))


def predict_language(docs: DataFrame, samples: tuple[tuple[str, str], ...], *keep: Column) -> DataFrame:
    """The columns kept of docs, then lang_pred and score."""
    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    shape = f"kept {rows.schema['kept'].dataType.simpleString()}, known boolean, lang string, score double"
    if samples:
        told = rows.select("kept", letter.alias("known"), F.when(letter, F.lower("text")).alias("text")).mapInArrow(_predict(samples), shape)
    else:
        told = rows.select("kept", F.lit(False).alias("known"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"))
    return told.select("kept.*", F.when(F.col("known"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("known"), F.col("score")).otherwise(0.0).alias("score"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    samples = training_sample(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict_language(docs, samples, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
