import hashlib
import random
import re
from collections import Counter

from llm_data import SHAPE, awkward_rows, opposite_words, prose

from loomspark.llm.decontamination import contamination, decontaminate, op7_decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, n=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = Counter()
    for doc_id, text, *_ in docs:
        w, hit, items = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    items |= {x for x in found if x is not None}
        out[doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_planted_spans_match_brute_force(spark):
    draw = random.Random(3)
    bench = [(i, prose(i, draw.choice([3, 7, 9, 10, 11, 30, 80]))) for i in range(40)] + [(50, prose(7, 30)), (51, "do " * 30)]
    docs = []
    for i in range(300):
        text = prose(1_000 + i, draw.randrange(0, 120)).split(" ")
        for _ in range(draw.randrange(0, 3)):
            w = words(draw.choice(bench)[1])
            a = draw.randrange(len(w))
            at = draw.randrange(len(text) + 1)
            text[at:at] = [x.upper() + "," for x in w[a : a + draw.randrange(1, 40)]]
        docs.append((i, " ".join(text), "en", "a", 1))
    docs.append((999, "do " * 40, "en", "a", 1))
    df, items = spark.createDataFrame(docs, SHAPE), spark.createDataFrame(bench, "item_id long, text string")
    wanted = brute(docs, bench)
    assert got(contamination(df, items)) == wanted
    clean = {k[0] for k in wanted if not k[5]}
    assert {r.doc_id for r in decontaminate(df, items).collect()} == clean


def test_awkward_rows(spark, awkward):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{awkward}/benchmark.parquet").collect()]
    assert got(op7_decontamination(spark, awkward)) == brute(awkward_rows(), bench)
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = decontaminate(docs, spark.read.parquet(f"{awkward}/benchmark.parquet"))
    assert kept.columns == docs.columns and 10 in {r.doc_id for r in kept.collect()}


def test_empty(spark, empty, awkward):
    assert op7_decontamination(spark, empty).count() == 0
    docs, none = spark.read.parquet(f"{awkward}/documents.parquet"), spark.read.parquet(f"{empty}/benchmark.parquet")
    assert contamination(docs, none).where("contaminated").count() == 0


def test_words_that_weak_hashes_confuse(spark):
    a, b = opposite_words()
    docs = [(1, f"x {a} y", "en", "a", 1), (2, f"x {b} y", "en", "a", 1)]
    df, items = spark.createDataFrame(docs, SHAPE), spark.createDataFrame([(1, b)], "item_id long, text string")
    assert got(contamination(df, items)) == brute(docs, [(1, b)])
