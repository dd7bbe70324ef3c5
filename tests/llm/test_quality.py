import random
import re
from collections import Counter

from llm_data import SHAPE, awkward_rows, opposite_words, prose

from loomspark.llm.priors import PRIOR_WEIGHT
from loomspark.llm.quality import host_rates, op4_quality_rules, quality_filter, quality_verdicts


def exact(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def agree(found, rows):
    wanted = Counter((r[0], *exact(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == wanted
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_random_texts_match_brute_force(spark):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice(["a ", "b ", "é ", "\n", "#", "ab", "\t", "\x0b", "\x1c", "  ", "|x "]) for _ in range(draw.randrange(0, 160))), "en", "s", 1) for i in range(500)]
    agree(quality_verdicts(spark.createDataFrame(rows, SHAPE)).collect(), rows)


def test_bad_hosts_lose_their_good_documents(spark):
    rows = [(i, prose(i, 100), "en", "good", 1) for i in range(50)]
    rows += [(100 + i, prose(i, 100) if i < 5 else "too short", "en", "bad", 1) for i in range(60)]
    rows += [(200, prose(9_999, 100), "en", "new", 1), (201, "short", "en", "new", 1)]
    df = spark.createDataFrame(rows, SHAPE)
    kept = {r.doc_id for r in quality_verdicts(df).where("kept").collect()}
    assert kept == {*range(50), 200}
    assert {r.doc_id for r in quality_filter(df).collect()} == kept


def test_awkward_rows(spark, awkward):
    agree(op4_quality_rules(spark, awkward).collect(), awkward_rows())
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = quality_filter(docs)
    verdicts = Counter(r.doc_id for r in op4_quality_rules(spark, awkward).where("kept").collect())
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == verdicts


def test_empty(spark, empty):
    assert op4_quality_rules(spark, empty).count() == 0
    assert quality_filter(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0


def test_a_null_host_is_apart_from_an_empty_one(spark):
    rows = [(i, prose(i, 100), "en", None, 1) for i in range(20)] + [(100 + i, "bad", "en", "", 1) for i in range(400)] + [(600 + i, prose(i, 80), "en", f"h{i % 9}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SHAPE)
    kept = {r.doc_id for r in quality_verdicts(df).where("kept").collect()}
    assert kept == {*range(20), *range(600, 900)} == {r.doc_id for r in quality_filter(df).collect()}


def test_words_that_weak_hashes_confuse(spark):
    a, b = opposite_words()
    rows = [(1, f"{a}\n{b}", "en", "s", 1), (2, f"{a} x y {b} x y", "en", "s", 1), (3, f"{a}\n{a}", "en", "s", 1)]
    agree(quality_verdicts(spark.createDataFrame(rows, SHAPE)).collect(), rows)


def test_many_small_hosts_do_not_switch_the_shrinkage_off(spark):
    """Hosts of one document each differ by chance alone, and one bad document doesn't condemn its host."""
    rows = [(f"h{i}", 10 if i % 5 == 0 else 100, 0, 0, 500) for i in range(1000)] + [("big", 10 if i % 5 == 0 else 100, 0, 0, 500) for i in range(300)]
    measured = spark.createDataFrame(rows, "source string, n_words long, n_symbols long, n_repeat_words long, word_chars long")
    rates = {r.host: r.short_rate for r in host_rates(measured, "source").collect()}
    assert all(abs(r - 0.2) < 0.01 for r in rates.values())
    # Hosts of eight, drawn from one rate: little is left of their spread.
    draw = random.Random(2)
    rows = [(f"h{i // 8}", 10 if draw.random() < 0.3 else 100, 0, 0, 500) for i in range(4000)]
    found = host_rates(spark.createDataFrame(rows, measured.schema), "source").collect()
    assert max(abs(r.short_rate - 0.3) for r in found) < 0.15
    # Rates drawn from beta(3, 7), of weight 10.
    rows = [(f"h{i}", 10 if draw.random() < p else 100, 0, 0, 500) for i in range(600) for p in [draw.betavariate(3, 7)] for _ in range(draw.randrange(1, 40))]
    one = [r for r in host_rates(spark.createDataFrame(rows, measured.schema), "source").collect() if r.n > 20]
    mean = sum(r[1] == 10 for r in rows) / len(rows)
    weights = [r.n * (r.short_rate - r.short / r.n) / (mean - r.short_rate) for r in one if abs(mean - r.short_rate) > 0.02]
    assert PRIOR_WEIGHT[0] < 7 < weights[0] < 14
