"""Host-level quality rules: failures by domain, shrunk with an empirical beta prior, joined back (operator 4).

Each text is measured once in whole. Four rules are counted by host (the ``source`` of a document): too short, repetitive,
symbol-heavy and odd word length. For each rule a beta prior is fitted to all hosts by the method of moments; a host
whose shrunk failure rate of any rule passes ``HOST_LIMIT`` is rejected with all its documents; one at the limit stays. Only
per-host counts, made with map-side combination, are shuffled, so a host with a third of all rows costs no more than another.

Edge cases: a null or empty text has no words and fails the base; a very long text is measured in whole; a null source is a
host of its own, apart from an empty one; repeated rows count as often as they occur; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm._store import free_name, if_small, written
from loomspark.llm.priors import PRIOR_WEIGHT, prior_weight
from loomspark.llm._text import SPACED_WORD, U64, byte_table, mix, ngram_hash, pieces, run_hashes, runs, sums, whole

SYMBOL = byte_table(b"#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host is rejected beyond this shrunk failure rate of a rule.
HOST_LIMIT = 0.6

BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its count, and whether it is the first of its kind."""
    _, first, back, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return n[back], is_first


def measure(d: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """MEASURES of each text of a buffer."""
    member = SPACED_WORD[d]
    start, end, word_off = runs(member, off)
    n_words = np.diff(word_off)
    triples = np.flatnonzero(whole(word_off, 3))
    doc_of_word = np.repeat(np.arange(len(n_words)), n_words)
    keys = ngram_hash(run_hashes(d[member], end - start), 3)[triples] ^ mix(doc_of_word[triples].astype(U64) + U64(1))
    twice = triples[_first_of(keys)[0] >= 2]
    repeated = np.zeros(len(start), bool)
    for i in range(3):
        repeated[twice + i] = True
    words_before = np.concatenate([[0], np.cumsum(member)])
    in_line = d != 10
    a, b, line_off = runs(in_line, off)
    some = words_before[b] > words_before[a]
    doc_of_line = np.repeat(np.arange(len(n_words)), np.diff(line_off))
    again = np.zeros(len(a), bool)
    again[some] = ~_first_of(run_hashes(d[in_line], b - a)[some] ^ mix(doc_of_line[some].astype(U64) + U64(1)))[1]
    return [n_words, sums(member & ((d & 0xC0) != 0x80), off), sums(SYMBOL[d], off), sums(again, line_off), sums(repeated, word_off)]


def annotate(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of docs, then MEASURES of the text under the prefix ``q_`` (more underscores where taken)."""
    prefix = "q_"
    while any(c.startswith(prefix) for c in keep):
        prefix = f"_{prefix}"
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(prefix + m, T.LongType()) for m in MEASURES)])
    at = len(keep)

    def run(batches):
        for batch in batches:
            for rows, d, off in pieces(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[rows] for i in range(at)), *map(pa.array, measure(d, off))], names=schema.names)

    return docs.select(*keep, F.col(text).alias(free_name("_text", *keep))).mapInArrow(run, schema), prefix


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """By host: n, failures of each rule, and each rule's shrunk rate."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(F.expr(f"cast({rule} as long)")).alias(name) for name, rule in RULES.items()))
    hosts = written(hosts, "quality-counts")
    sums_ = [x for k in RULES for x in (F.sum(k).alias(k), F.sum(F.col(k) * F.col(k) / F.col("n")).alias(f"{k}_squares"))]
    all_ = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sizes"), *sums_).first()  # one row
    for k in RULES:
        mean = all_[k] / all_["n"] if all_["n"] else 0.0
        weight = prior_weight(all_["hosts"], 1, all_["n"], all_[k], all_[f"{k}_squares"], mean * all_[k], all_["sizes"] / all_["n"]) if all_["n"] else 1.0
        hosts = hosts.withColumn(f"{k}_rate", (F.col(k) + weight * mean) / (F.col("n") + weight))
    return hosts


def rejected_hosts(measured: DataFrame, host: str, name: str, limit: float = HOST_LIMIT) -> DataFrame:
    """The hosts that a rule's shrunk rate rejects, as the column name of a written table."""
    rates = host_rates(measured, host).withColumn("host_rate", F.greatest(*(F.col(f"{k}_rate") for k in RULES)))
    return written(rates.where(F.col("host_rate") > limit).select(F.col("host").alias(name)), "quality-hosts")


def quality_verdicts(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, base_failed and kept of each document."""
    found, prefix = annotate(docs, ["doc_id", "source"])
    measured = written(found.withColumnsRenamed({prefix + m: m for m in MEASURES}), "quality")
    bad = if_small(rejected_hosts(measured, "source", "bad_host", limit).withColumn("bad", F.lit(True)))
    judged = measured.join(bad, measured["source"].eqNullSafe(bad["bad_host"]), "left")
    failed = F.expr(BASE_FAILED)
    return judged.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & F.col("bad").isNull()).alias("kept"))


def quality_filter(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs, unchanged, that pass. The texts are measured twice, which costs less than shuffling them."""
    found, prefix = annotate(docs, ["source"])
    name = free_name("bad_host", *docs.columns)
    bad = if_small(rejected_hosts(found.withColumnsRenamed({prefix + m: m for m in MEASURES}), "source", name, limit))
    full, prefix = annotate(docs, docs.columns)
    passed = full.where(f"not ({BASE_FAILED.replace('n_', prefix + 'n_')})")
    return passed.join(bad, passed["source"].eqNullSafe(bad[name]), "left_anti").select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOW, _HIGH = PRIOR_WEIGHT
_WEIGHT = "(case when m.k <= 1 or m.n <= m.k or m.{k}_b - m.{k}_w <= 1e-12 then {hi} else greatest({lo}, least({hi}, m.n0 * m.{k}_w / (m.{k}_b - m.{k}_w))) end)"
_RATE = f"(h.{{k}} + {_WEIGHT} * m.{{k}}_p) / (h.n + {_WEIGHT})"
SQL = f"""
with w as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 3),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows) where n >= 2),
covered as (select doc_id, count(distinct i + j) as n_repeat_words from twice, (values (0), (1), (2)) as o(j) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
dups as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
measured as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from w left join covered using (doc_id) left join dups using (doc_id)),
h as (select source as host, count(*) as n, {", ".join(f"count(*) filter ({rule}) as {k}" for k, rule in RULES.items())} from measured group by 1),
m as (select count(*) as k, sum(n) as n, (sum(n) - sum(n * n) / sum(n)) / nullif(count(*) - 1, 0) as n0,
    {", ".join(f"sum({k}) / sum(n) as {k}_p, (sum({k} * {k} / n) - sum({k}) * sum({k}) / sum(n)) / nullif(count(*) - 1, 0) as {k}_b, (sum({k}) - sum({k} * {k} / n)) / nullif(sum(n) - count(*), 0) as {k}_w" for k in RULES)} from h),
bad as (select host from h, m where greatest({", ".join(_RATE.format(k=k, lo=_LOW, hi=_HIGH) for k in RULES)}) > {HOST_LIMIT})
select doc_id, {", ".join(MEASURES)}, ({BASE_FAILED}) as base_failed, not ({BASE_FAILED}) and not exists (select 1 from bad where bad.host is not distinct from measured.source) as kept from measured
"""
