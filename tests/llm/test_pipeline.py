import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__
import numpy as np
import test_decontamination
import test_neardup
import test_pii
import test_quality
from llm_data import SHAPE, edited, prose

from loomspark.llm._store import written
from loomspark.llm._tokens import default_tokenizer
from loomspark.llm.priors import PRIOR_WEIGHT
from loomspark.llm.quality import HOST_LIMIT


def test_stages_judge_their_own_input(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, awkward), f"test-{name}")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.count() <= before
        docs, before = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, awkward)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_driver_rows_keep_clean_documents(spark):
    top = "/root/testdata/sf0.001"
    kept = {r.doc_id for r in corpus_pipeline.run(spark, top).select("doc_id").distinct().collect()}
    assert 0 < len(kept) < spark.read.parquet(f"{top}/documents.parquet").count()


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered():
    names = [q for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_neardup", "benchmark_decontamination", "pii_sanitisation", "best_fit_packing"]


def good_hosts(rows):
    """The hosts that no rule's shrunk rate rejects, from the definition."""
    counts = defaultdict(lambda: [0, 0, 0, 0, 0])
    for r in rows:
        n, chars, symbols, _, repeat = test_quality.exact(r[1])
        for i, failed in enumerate((True, n < 50, 100 * repeat > 50 * n, 10 * symbols > n, chars < 2 * n or chars > 20 * n)):
            counts[r[3]][i] += failed
    total, hosts, worst = len(rows), len(counts), Counter()
    for rule in range(1, 5):
        bad = sum(c[rule] for c in counts.values())
        squares = sum(c[rule] ** 2 / c[0] for c in counts.values())
        between, within = (squares - bad**2 / total) / (hosts - 1), (bad - squares) / (total - hosts)
        size = (total - sum(c[0] ** 2 for c in counts.values()) / total) / (hosts - 1)
        weight = min(max(size * within / (between - within), PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if between > within + 1e-12 else PRIOR_WEIGHT[1]
        for h, c in counts.items():
            worst[h] = max(worst[h], (c[rule] + weight * bad / total) / (c[0] + weight))
    return {h for h in counts if worst[h] <= HOST_LIMIT}


def brute(rows, bench):
    """The documents that go into the packing, with their texts, by each stage's definition."""
    hosts = good_hosts(rows)
    rows = [r for r in rows if r[3] in hosts and (m := test_quality.exact(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    kept = {c for _, _, c in test_neardup.brute(rows, 5, 80)}
    rows = [r for r in rows if r[0] in kept]
    clean = {k[0] for k in test_decontamination.brute(rows, bench) if not k[5]}
    rows = [r for r in rows if r[0] in clean]
    out = {}
    for r, terms in zip(rows, test_pii.terms(rows), strict=True):
        spans = [(int(a), test_pii.KIND[k], int(b)) for k, a, b in (x.split(":") for x in test_pii.base(r[1]))] + [(a, 4, b) for a, b in terms]
        text, at = "", 0
        for a, k, b in sorted(spans):
            if a >= at:
                text += r[1][at:a] + ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>")[k]
            at = max(at, b)
        out[r[0]] = text + r[1][at:]
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    draw, rows = random.Random(11), []
    bench = [(i, prose(8_000 + i, 12 + 3 * i)) for i in range(6)]
    for i in range(160):
        text = prose(i, draw.choice([20, 60, 90, 140]))
        kind = i % 8
        if kind == 1 and i > 8:
            text = edited(rows[draw.randrange(len(rows))][1], i, draw.choice([0.0, 0.01, 0.03]))
        if kind == 2:
            text += " " + bench[i % 6][1] + " tail words here"
        if kind == 3:
            k = draw.randrange(9)
            text = f"{text} Ask Name{k} at p{k}@site{k}.org or +49 30 123456{k:02} soon"
        if kind == 4:
            text = " ".join(text.split()[:5] * 20)
        rows.append((1000 - i, text, "en", f"h{i % 5}" if i % 16 else "bad", len(text)))
    rows += [(2000 + i, "too short", "en", "bad", 9) for i in range(30)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wanted = brute(rows, bench)
    assert 20 < len(wanted) < 120 and any("<TERM>" in t for t in wanted.values())
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(default_tokenizer()), Counter()
    for doc_id, text in wanted.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert len(ids) <= 2048
        pieces[doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces
