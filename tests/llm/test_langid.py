import zlib

import numpy as np
from llm_data import awkward_rows

from loomspark.llm.langid import BLOCK, Parser, costs, op1_language_id, predict_language, training_sample

SF = "/root/testdata/sf0.01"


def greedy(text: str, sample: str) -> int:
    """Phrases of text: longest matches in sample, found by substring search; a letter that isn't there ends its phrase."""
    count = 0
    for at in range(0, len(text), BLOCK):
        block, i = text[at : at + BLOCK], 0
        while i < len(block):
            j = i
            while j < len(block) and block[i : j + 1] in sample:
                j += 1
            i = j + 1 if j < len(block) and block[j] not in sample else j
            count += 1
    return count


def test_phrases_match_substring_search():
    draw = np.random.default_rng(0)
    for trial in range(20):
        samples = tuple((name, "".join(draw.choice(list("abcd "), 200, p=p))) for name, p in (("one", [0.4, 0.2, 0.1, 0.1, 0.2]), ("two", [0.1, 0.1, 0.4, 0.2, 0.2])))
        texts = ["".join(draw.choice(list("abcd z"), int(draw.integers(1, 5_000 if trial == 0 else 120)))) for _ in range(8)]
        model = Parser(samples)
        found = costs(model, texts) / model.weight
        for i, text in enumerate(texts):
            for k, (_, sample) in enumerate(samples):
                assert round(found[i, k], 6) == greedy(text, sample), (text, sample)


def scripts() -> dict[str, str]:
    """A sample of each of five scripts, two of them of 300 letters."""
    draw = np.random.default_rng(5)
    alphabets = {"el": range(0x3B1, 0x3C9), "en": range(0x61, 0x7B), "ja": range(0x3041, 0x3041 + 80), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x4E00 + 300)}
    alphabets["ja"] = [*alphabets["ja"], *range(0x4F00, 0x4F00 + 220)]
    return {name: " ".join("".join(chr(c) for c in draw.choice(list(a), int(draw.integers(2, 8)))) for _ in range(150)) for name, a in alphabets.items()}


def test_many_scripts_match_brute_force(spark):
    """Every letter of every sample counts: a sample's own text, and mixtures, are predicted as by substring search."""
    own = scripts()
    samples = tuple(sorted(own.items()))
    texts = list(own.values()) + [own[a][:k] + " " + own[b][::-1][:90] for a in own for b in own for k in (40, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {r.doc_id: r for r in predict_language(docs, samples, docs["doc_id"]).collect()}
    for i, text in enumerate(texts):
        cost = [greedy(text, sample) * np.log2(len(sample) + 2) for _, sample in samples]
        best = int(np.argmin(cost))
        assert told[i].lang_pred == samples[best][0]
        assert abs(told[i].score - 1 / cost[best] / sum(1 / c for c in cost)) < 1e-9
    assert [told[i].lang_pred for i in range(5)] == list(own)


def test_a_row_repeated_often_is_one_row_of_the_sample(spark):
    rows = [(7, "the same text", "en")] * 500 + [(100 + i, f"text number {i}", "en") for i in range(300)]
    sample = training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sample[0][1].split("\n").count("the same text") <= 1


def test_held_out_accuracy(spark):
    told = {r.doc_id: r for r in op1_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").collect()
    out = [r for r in docs if told[r.doc_id].held_out and told[r.doc_id].lang_pred != "und"]
    assert len(out) > 100
    assert sum(told[r.doc_id].lang_pred == r.lang for r in out) / len(out) >= 0.9
    assert all(0 <= r.score <= 1 for r in told.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(i, f"alpha beta {i}", "xx" if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.mode("overwrite").parquet((top := f"{_tmp(spark)}/held") + "/documents.parquet")
    assert {r.lang_pred for r in op1_language_id(spark, top).collect()} == {"xx"}


def _tmp(spark) -> str:
    from loomspark.llm._store import shared_folder

    return shared_folder(spark)


def test_awkward_rows(spark, awkward):
    found = op1_language_id(spark, awkward).collect()
    assert len(found) == len(awkward_rows())
    unknown = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {5, 6, 7, 12, 15} <= unknown and not {8, 9, 10, 11, 13, 14} & unknown
    assert all((r.score == 0) == (r.lang_pred == "und") for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert training_sample(docs) == ()
    assert predict_language(docs, (), docs["doc_id"]).collect()[0].lang_pred == "und"


def test_empty(spark, empty):
    assert op1_language_id(spark, empty).count() == 0
