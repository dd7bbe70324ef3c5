"""The engine's own queries over the driver's tables, each with the SQL it is held against.

Scores are rounded to six places before ranking, on both sides, so that ties are ties in either engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.database import Collection, Database
from loomspark.functions import vectors as V
from loomspark.operators import ann, changes, maintenance
from loomspark.operators.search import knn, knn_batch, normalised, recall, within_score
from loomspark.plans import filters as P
from loomspark.plans.filters import TypedFields, VariantFields, compile_filter
from loomspark.sources.files import Files, shared_folder
from loomspark.types import BatchAborted, Cancelled, Document, DocumentNotFound, DuplicateId

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _place(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _described(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with its documents' fields as metadata; embeddings without a document have none."""
    about = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return _corpus(spark, d).join(about, "id", "left")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return _corpus(spark, d).where("id = 0").select("vector").first()[0]


# Search.


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double))))"


def _inverse(a: str) -> str:
    return f"(case when {_dot(a, a)} > 0 then 1 / sqrt({_dot(a, a)}) else 0 end)"


def _score_sql(metric: str, v: str, q: str) -> str:
    raw = {"cosine": f"{_dot(v, q)} * {_inverse(q)} * {_inverse(v)}", "l2": f"0 - {_l2(v, q)}", "dot": _dot(v, q)}[metric]
    return f"round({raw}, {DIGITS}) + 0"


def _distance_sql(metric: str) -> str:
    return {"cosine": "1 - score", "l2": "sqrt(greatest(0 - score, 0))", "dot": "cast(null as double)"}[metric]


def _knn_sql(metric: str, k: int, where: str = "true", least: float | None = None, extra: str = "", after: str = "") -> str:
    return f"""
with q as (select embedding as q from embeddings where vec_id = 0),
s as (select vec_id as id, embedding, label, {_score_sql(metric, "embedding", "q")} as score from embeddings left join documents on doc_id = vec_id, q where {where})
select id, score, {_distance_sql(metric)} as distance{extra} from s {f"where score >= {least}" if least is not None else ""} order by score desc, id limit {k}"""


def _search(name: str, metric: str, k: int, where=None, sql_where: str = "true", least: float | None = None, extra: str = "", include=(), shape=None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        corpus = _described(spark, d) if where is not None else _corpus(spark, d)
        condition = None if where is None else compile_filter(where, TypedFields(corpus.schema))
        found = knn(corpus, _first_vector(spark, d), k, metric, condition, least, include=include, digits=DIGITS)
        return shape(found) if shape else found

    run.__name__ = name
    _add(name, run, _knn_sql(metric, k, sql_where, least, extra))


_search("knn_cosine", "cosine", 10)
_search("knn_l2", "l2", 10)
_search("knn_dot", "dot", 10)
_search("knn_k1", "cosine", 1)
_search("knn_k100", "cosine", 100)
_search("knn_min_score", "cosine", 50, least=0.1)
_search("knn_with_distance", "l2", 25)
_search("knn_include_vector", "cosine", 10, include=("label", "vector"), extra=", label, cast(len(embedding) as integer) as dims, cast(embedding[1] as double) as first", shape=lambda df: df.select("id", "score", "distance", "label", F.size("vector").alias("dims"), F.col("vector")[0].cast("double").alias("first")))
_search("knn_k_exceeds_n", "cosine", 10_000, P.eq("label", 3), "label = 3")
_search("knn_filter_eq", "cosine", 10, P.eq("lang", "en"), "lang = 'en'")
_search("knn_filter_ne", "cosine", 10, P.ne("lang", "en"), "lang is distinct from 'en'")
_search("knn_filter_in", "l2", 10, P.in_("label", [1, 2, 3]), "label in (1, 2, 3)")
_search("knn_filter_nin", "cosine", 10, P.nin("source", ["src0", "src1"]), "not coalesce(source in ('src0', 'src1'), false)")
_search("knn_filter_range", "dot", 10, P.gte("n_chars", 200) & P.lt("n_chars", 4000), "n_chars >= 200 and n_chars < 4000")
_search("knn_filter_10_percent", "cosine", 10, P.eq("label", 0), "label = 0")
_search("knn_filter_nested", "cosine", 10, (P.eq("lang", "de") | P.eq("lang", "fr")) & ~P.gt("n_chars", 1000), "(coalesce(lang = 'de', false) or coalesce(lang = 'fr', false)) and not coalesce(n_chars > 1000, false)")
_search("knn_filter_json", "cosine", 10, P.parse({"lang": {"$in": ["en", "es"]}, "$not": {"label": {"$gte": 5}}}), "lang in ('en', 'es') and not coalesce(label >= 5, false)")
_search("knn_filter_nothing", "cosine", 10, P.any_of(), "false")


def knn_metric_override(spark: SparkSession, d: str) -> DataFrame:
    """A collection's stored norms serve a search under another metric, and the collection's own."""
    corpus = normalised(_corpus(spark, d))
    q = _first_vector(spark, d)
    own = knn(corpus, q, 5, "cosine", inverse="inv_norm", digits=DIGITS).withColumn("metric", F.lit("cosine"))
    return own.unionByName(knn(corpus, q, 5, "l2", inverse="inv_norm", digits=DIGITS).withColumn("metric", F.lit("l2")))


_add("knn_metric_override", knn_metric_override, " union all ".join(f"(select *, '{m}' as metric from ({_knn_sql(m, 5)}))" for m in ("cosine", "l2")))


def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return within_score(_corpus(spark, d), _first_vector(spark, d), 0.2, digits=DIGITS)


_add("knn_threshold", knn_threshold, _knn_sql("cosine", 1_000_000_000, least=0.2).replace(", 1 - score as distance", ""))


def _batch_sql(metric: str, k: int, where: str = "true", same: bool = False) -> str:
    return f"""
with s as (select q.vec_id as query_id, c.vec_id as id, {_score_sql(metric, "c.embedding", "q.embedding")} as score
    from embeddings c, embeddings q where q.vec_id % 50 = 0 and {where} {"and c.vec_id <> q.vec_id" if same else ""}),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
select query_id, id, score, {_distance_sql(metric)} as distance, rank from r where rank <= {k}"""


def _stated_queries(corpus: DataFrame) -> DataFrame:
    return corpus.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def knn_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return knn_batch(corpus, _stated_queries(corpus), 10, digits=DIGITS)


def knn_batch_l2_others(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return knn_batch(corpus, _stated_queries(corpus), 5, "l2", exclude_self=True, digits=DIGITS)


def knn_batch_filtered(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return knn_batch(corpus, _stated_queries(corpus), 10, "dot", where=F.col("label") < 5, digits=DIGITS)


_add("knn_batch_topk", knn_batch_topk, _batch_sql("cosine", 10))
_add("knn_batch_l2_others", knn_batch_l2_others, _batch_sql("l2", 5, same=True))
_add("knn_batch_filtered", knn_batch_filtered, _batch_sql("dot", 10, "c.label < 5"))

# The approximate index.


def _exact(corpus: DataFrame, metric: str, where=None) -> DataFrame:
    return knn_batch(corpus, _stated_queries(corpus), 10, metric, where=where, digits=DIGITS)


def _approximate(spark: SparkSession, d: str, metric: str = "cosine", where=None) -> DataFrame:
    """The stated queries against an index fitted to the corpus and stored by cell."""
    corpus = _corpus(spark, d)
    index = ann.fit(corpus, metric)
    cells = ann.stored(corpus, index, _place(spark, "cells"))
    return ann.ann_knn_batch(cells, ann.calibrated(cells, index), _stated_queries(corpus), 10, where=where, digits=DIGITS)


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    return _approximate(spark, d)


def _recall(metric: str, where=None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Whether the approximate index finds nine of ten of the exact neighbours of the stated queries, over all rows."""
        found = recall(_approximate(spark, d, metric, where), _exact(_corpus(spark, d), metric, where))
        return found.select((F.col("recall") >= 0.9).alias("enough"))

    return run


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the approximate index, over all rows, and whether it reaches 0.9."""
    return recall(ann_topk(spark, d), knn_batch_topk(spark, d)).withColumn("enough", F.col("recall") >= 0.9)


def ann_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Asked for exact results, the search of one cell falls back to all of them: for want of matches, or for what betters them."""
    corpus = _corpus(spark, d)
    index = ann.fit(corpus)
    cells = ann.stored(corpus, index, _place(spark, "cells"))
    return ann.ann_knn(cells, index, _first_vector(spark, d), 100, n_probe=1, where=F.col("label") >= 2, digits=DIGITS, exact=True).select("id", "score")


_add("ann_topk", ann_topk)
_add("ann_recall", ann_recall)
_add("ann_fallback", ann_fallback, _knn_sql("cosine", 100, "label >= 2").replace(", 1 - score as distance", ""))
for _name, _metric, _where in (("cosine", "cosine", None), ("l2", "l2", None), ("dot", "dot", None), ("filtered", "cosine", "label < 5")):
    _add(f"ann_recall_{_name}", _recall(_metric, _where), "select true as enough")


def knn_wide(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 256 components, which are scored by numpy in Arrow batches."""
    four = lambda v: F.concat(v, F.transform(v, lambda x: -x), v, F.reverse(v))
    corpus = _corpus(spark, d).withColumn("vector", four(F.col("vector")))
    query = corpus.where("id = 0").select("vector").first()[0]
    every = [knn(corpus, query, 5, m, digits=DIGITS).withColumn("metric", F.lit(m)) for m in ("cosine", "l2", "dot")]
    return every[0].unionByName(every[1]).unionByName(every[2])


_WIDE = "list_concat(list_concat(embedding, list_transform(embedding, lambda x: -x)), list_concat(embedding, list_reverse(embedding)))"
_add("knn_wide", knn_wide, " union all ".join(f"(select *, '{m}' as metric from ({_knn_sql(m, 5).replace('from embeddings', 'from wide')}))" for m in ("cosine", "l2", "dot")).join((f"with wide as (select vec_id, label, {_WIDE} as embedding from embeddings) select * from (", ")")))

# Vector functions.


def inv_norm(spark: SparkSession, d: str) -> DataFrame:
    return normalised(_corpus(spark, d)).select("id", F.round("inv_norm", DIGITS).alias("inv_norm"))


_add("inv_norm", inv_norm, f"select vec_id as id, round({_inverse('embedding')}, {DIGITS}) as inv_norm from embeddings")


def _pairwise(function):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _corpus(spark, d)
        other = rows.select((F.col("id") + 1).alias("id"), F.col("vector").alias("other"))
        return rows.join(other, "id").select("id", (F.round(function(F.col("vector"), F.col("other")), DIGITS) + F.lit(0.0)).alias("value"))

    return run


for _name, _function, _sql in (("pairwise_dot", V.dot, _dot), ("pairwise_l2", V.squared_l2, _l2)):
    _add(_name, _pairwise(_function), f"select a.vec_id as id, round({_sql('a.embedding', 'b.embedding')}, {DIGITS}) + 0 as value from embeddings a join embeddings b on a.vec_id = b.vec_id + 1")


def finite_check(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with a component that is infinite, or not a number, are told from the others."""
    bad = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 1, F.lit(float("inf")))
    broken = F.transform(F.col("vector").cast("array<double>"), lambda x, i: F.coalesce(F.when(i == 5, bad), x))
    return _corpus(spark, d).select("id", V.valid_vector(broken, 64).alias("valid"))


def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.col("id") % 5 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    return _corpus(spark, d).select("id", V.valid_vector(cut, 64).alias("valid"))


def zero_vector(spark: SparkSession, d: str) -> DataFrame:
    """A zero vector has score 0 under cosine, and loses nothing but its direction."""
    rows = _corpus(spark, d).withColumn("vector", F.when(F.col("id") % 10 == 0, F.transform("vector", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("vector")))
    return within_score(rows, _first_vector(spark, d), -2.0, digits=DIGITS)


_add("finite_check", finite_check, "select vec_id as id, vec_id % 7 > 1 as valid from embeddings")
_add("dimension_check", dimension_check, "select vec_id as id, vec_id % 5 <> 0 as valid from embeddings")
_add("zero_vector", zero_vector, f"with q as (select embedding as q from embeddings where vec_id = 0) select vec_id as id, case when vec_id % 10 = 0 then 0.0::double else {_score_sql('cosine', 'embedding', 'q')} end as score from embeddings, q")

# Filters over dynamic metadata: absent, null and mixed kinds, made from events.

_META = """concat('{"k":', get_json_object(props, '$.k'), ',"value":', cast(value as string),
    case event_id % 3 when 0 then ',"kind":null' when 1 then concat(',"kind":"', event_type, '"') else '' end,
    case event_id % 4 when 0 then concat(',"mix":', user_id % 9) when 1 then concat(',"mix":"', user_id % 9, '"') when 2 then ',"mix":true' else '' end,
    ',"nested":{"user":', user_id, ',"deep":{"type":"', event_type, '"}},"tags":["', event_type, '",', user_id % 5, ',null]}')"""
_EVENTS = """(select event_id, event_type, user_id, value, cast(json_extract_string(props, '$.k') as bigint) as k,
    case when event_id % 3 = 1 then event_type end as kind, event_id % 3 <> 2 as has_kind,
    case when event_id % 4 = 0 then user_id % 9 end as mix_n, case when event_id % 4 = 1 then cast(user_id % 9 as varchar) end as mix_s, case when event_id % 4 = 2 then true end as mix_b from events)"""
FILTERS = {
    "filter_eq": (P.eq("k", 7), "k = 7"),
    "filter_eq_double": (P.eq("k", 7.0), "k = 7"),
    "filter_eq_absent_is_null": (P.eq("kind", None), "kind is null"),
    "filter_eq_bool": (P.eq("mix", True), "coalesce(mix_b, false)"),
    "filter_eq_array": (P.eq("tags", ["view", 2, None]), "event_type = 'view' and user_id % 5 = 2"),
    "filter_eq_map": (P.eq("nested", {"user": 7, "deep": {"type": "click"}}), "event_type = 'click' and user_id = 7"),
    "filter_ne": (P.ne("kind", "click"), "kind is distinct from 'click'"),
    "filter_gt": (P.gt("value", 50.0), "value > 50"),
    "filter_gte": (P.gte("k", 90), "k >= 90"),
    "filter_lt": (P.lt("nested.user", 3), "user_id < 3"),
    "filter_lte": (P.lte("kind", "error"), "coalesce(kind <= 'error', false)"),
    "filter_in": (P.in_("mix", [3, "5", True]), "coalesce(mix_n = 3, false) or coalesce(mix_s = '5', false) or coalesce(mix_b, false)"),
    "filter_in_null": (P.in_("kind", ["view", None]), "kind is null or kind = 'view'"),
    "filter_in_empty": (P.in_("k", []), "false"),
    "filter_nin": (P.nin("mix", [3, "5", True]), "not (coalesce(mix_n = 3, false) or coalesce(mix_s = '5', false) or coalesce(mix_b, false))"),
    "filter_nin_empty": (P.nin("k", []), "true"),
    "filter_exists": (P.exists("kind"), "has_kind"),
    "filter_is_null": (P.is_null("kind"), "kind is null"),
    "filter_starts_with": (P.starts_with("kind", "c"), "coalesce(starts_with(kind, 'c'), false)"),
    "filter_starts_with_empty": (P.starts_with("mix", ""), "mix_s is not null"),
    "filter_contains": (P.contains("tags", 3), "user_id % 5 = 3"),
    "filter_contains_string": (P.contains("tags", "view"), "event_type = 'view'"),
    "filter_contains_not_an_array": (P.contains("kind", "click"), "false"),
    "filter_dotted_path": (P.eq("nested.deep.type", "error"), "event_type = 'error'"),
    "filter_path_into_scalar": (P.is_null("k.x"), "true"),
    "filter_type_mismatch": (P.gt("kind", 5) | P.lte("kind", 5), "false"),
    "filter_mixed_range": (P.gte("mix", 4), "coalesce(mix_n >= 4, false)"),
    "filter_and": (P.gte("k", 20) & P.lt("k", 30) & P.exists("mix"), "k >= 20 and k < 30 and event_id % 4 <> 3"),
    "filter_or": (P.eq("kind", "view") | P.eq("k", 1), "coalesce(kind = 'view', false) or k = 1"),
    "filter_not": (~P.gt("mix", 4), "not coalesce(mix_n > 4, false)"),
    "filter_de_morgan": (~(P.eq("kind", "view") | ~P.lt("k", 50)), "not (coalesce(kind = 'view', false) or not k < 50)"),
    "filter_empty_and": (P.all_of(), "true"),
    "filter_empty_or": (P.any_of(), "false"),
    "filter_json": (P.parse({"k": {"$gte": 10, "$lt": 60}, "$or": [{"kind": "view"}, {"kind": {"$exists": False}}], "tags": {"$contains": 1}}), "k >= 10 and k < 60 and (kind = 'view' or kind is null) and user_id % 5 = 1"),
}


def _filtered(f: P.Filter):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _table(spark, d, "events").select("event_id", F.parse_json(F.expr(_META)).alias("metadata"))
        rows = written_once(rows, _place(spark, "events"))  # as a collection keeps it: parsed when it comes in, and not again
        return rows.where(compile_filter(f, VariantFields(F.col("metadata")))).select(F.col("event_id").alias("id"))

    return run


for _name, (_filter, _sql) in FILTERS.items():
    _add(_name, _filtered(_filter), f"select event_id as id from {_EVENTS} where {_sql}")

_TYPED = {
    "typed_prefix": ("customer", "c_custkey", P.starts_with("c_mktsegment", "AUTO") & P.gt("c_acctbal", 0), "starts_with(c_mktsegment, 'AUTO') and c_acctbal > 0"),
    "typed_nulls": ("documents", "doc_id", P.ne("lang", "en") & ~P.is_null("source"), "lang is distinct from 'en' and source is not null"),
    "typed_range": ("lineitem", "l_orderkey", P.parse({"l_quantity": {"$lte": 2}, "l_returnflag": "R"}), "l_quantity <= 2 and l_returnflag = 'R'"),
}


def _typed(table: str, key: str, f: P.Filter):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _table(spark, d, table)
        return rows.where(compile_filter(f, TypedFields(rows.schema))).select(F.col(key).alias("id"))

    return run


for _name, (_of, _key, _filter, _sql) in _TYPED.items():
    _add(_name, _typed(_of, _key, _filter), f"select {_key} as id from {_of} where {_sql}")

# Writes: events as a change log. The user is the document; an error event deletes it, any other puts it.


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", changes.DELETE).otherwise(changes.PUT).alias("op"), "value")


def _base(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lit(-1).cast("long").alias("seq"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))


_LOG = "log as (select event_id as seq, user_id as id, case when event_type = 'error' then 'delete' else 'put' end as op, value from events)"
_LAST = "last as (select * from log qualify row_number() over (partition by id order by seq desc) = 1)"
_BASE = "base as (select -1::bigint as seq, c_custkey as id, c_acctbal as value from customer where c_custkey % 2 = 0)"


def batch_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return changes.latest(_change_log(spark, d))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return changes.apply_changes(_base(spark, d), _change_log(spark, d))


def batch_report(spark: SparkSession, d: str) -> DataFrame:
    return changes.batch_report(_base(spark, d), _change_log(spark, d))


def delete_missing(spark: SparkSession, d: str) -> DataFrame:
    """Deletions of documents that aren't there: they are counted and change nothing."""
    gone = _change_log(spark, d).where(F.col("op") == changes.DELETE).select("id").distinct()
    return gone.join(_base(spark, d), "id", "left_anti")


def wal_replay_committed(spark: SparkSession, d: str) -> DataFrame:
    """Transactions of about ten events; those without a commit record are dropped."""
    log = _change_log(spark, d).withColumn("txn_id", F.when(F.col("seq") % 4 != 0, F.floor(F.col("seq") / 10)))
    commits = log.where("txn_id is not null and txn_id % 3 <> 0").groupBy("txn_id").agg(F.max("seq").alias("seq")).select("seq", F.lit(None).cast("long").alias("id"), F.lit(changes.COMMIT).alias("op"), F.lit(None).cast("double").alias("value"), "txn_id")
    return changes.replay(changes.committed(log.unionByName(commits))).select("id", "seq", "value")


_add("batch_last_wins", batch_last_wins, f"with {_LOG}, {_LAST} select seq, id, op, value from last")
_add("upsert_merge", upsert_merge, f"with {_LOG}, {_LAST}, {_BASE} select seq, id, value from base where id not in (select id from last) union all select seq, id, value from last where op = 'put'")
_add(
    "batch_report",
    batch_report,
    f"with {_LOG}, {_BASE}, f as (select op, id in (select id from base) as was from log) select count(*) filter (op = 'put' and not was) as inserted, count(*) filter (op = 'put' and was) as updated, count(*) filter (op = 'delete' and was) as deleted, count(*) filter (op = 'delete' and not was) as missing_deletes from f",
)
_add("delete_missing", delete_missing, f"with {_LOG}, {_BASE} select distinct id from log where op = 'delete' and id not in (select id from base)")
_add(
    "wal_replay_committed",
    wal_replay_committed,
    f"with {_LOG}, good as (select * from log where seq % 4 = 0 or (seq // 10) % 3 <> 0), l as (select * from good qualify row_number() over (partition by id order by seq desc) = 1) select id, seq, value from l where op = 'put'",
)

# Maintenance: every thousand events are a segment; an error event is a tombstone.


def _segments(spark: SparkSession, d: str) -> DataFrame:
    log = _change_log(spark, d)
    rows = log.where(F.col("op") == changes.PUT).select(F.floor(F.col("seq") / 1000).alias("segment"), "id", "seq")
    newest = rows.groupBy("id").agg(F.max("seq").alias("seq"))
    return maintenance.marked(rows, newest.unionByName(log.where(F.col("op") == changes.DELETE).select("id", "seq")))


_MARKED = f"""{_LOG}, d as (select id, max(seq) as dead_to from log group by id),
m as (select seq // 1000 as segment, id, seq, seq >= dead_to as live from log join d using (id) where op = 'put'),
ss as (select segment, count(*) as rows, count(*) filter (live) as live, (count(*) - count(*) filter (live)) / count(*) as dead_ratio from m group by segment)"""


def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.segment_stats(_segments(spark, d))


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.collection_stats(_segments(spark, d))


def compact_report(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.compaction_report(_segments(spark, d), 0.99)


def live_ids(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where("live").select("id").distinct().orderBy("id")


def verify_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Damage made on purpose: every put counts as live."""
    return maintenance.duplicate_ids(_segments(spark, d).withColumn("live", F.lit(True)))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events")
    return maintenance.percentile(rows, "value", 0.5).select(F.lit("p50").alias("name"), "value").unionByName(maintenance.percentile(rows, "value", 0.95).select(F.lit("p95").alias("name"), "value"))


_add("segment_stats", segment_stats, f"with {_MARKED} select * from ss")
_add("collection_stats", collection_stats, f"with {_MARKED} select count(*) as segments, cast(sum(rows) as bigint) as total_rows, cast(sum(live) as bigint) as live, (sum(rows) - sum(live)) / sum(rows) as dead_ratio from ss")
_add("compact_report", compact_report, f"with {_MARKED} select count(*) as rewritten, cast(case when coalesce(sum(live), 0) > 0 then 1 else 0 end as bigint) as created, cast(coalesce(sum(rows - live), 0) as bigint) as reclaimed from ss where dead_ratio >= 0.99")
_add("live_ids", live_ids, f"with {_MARKED} select distinct id from m where live")
_add("verify_duplicate_ids", verify_duplicate_ids, f"with {_LOG} select id, count(*) as copies from log where op = 'put' group by id having count(*) > 1")
_add("latency_percentiles", latency_percentiles, "select 'p50' as name, quantile_disc(value, 0.5) as value from events union all select 'p95', quantile_disc(value, 0.95) from events")

# The stored engine, end to end. Each query makes a database of its own in the shared folder.


def _filled(spark: SparkSession, d: str, name: str, **options) -> tuple[Database, Collection]:
    """A database with all embeddings, label, lang and n_chars being their metadata."""
    db = Database(spark, _place(spark, name))
    own = db.create_collection("vectors", 64, "cosine", id_kind="u64", **options)
    own.upsert_frame(_described(spark, d).select("id", "vector", F.to_variant_object(F.struct("label", "lang", "n_chars")).alias("metadata")))
    return db, own


def _rows(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    return spark.createDataFrame(rows, shape)


def _fields(own: Collection) -> DataFrame:
    return own.frame().select("id", F.try_variant_get("metadata", "$.label", "long").alias("label"), F.try_variant_get("metadata", "$.lang", "string").alias("lang"))


def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings through a stored collection: bulk upsert, a second version of a third of them, deletion, compaction."""
    db, own = _filled(spark, d, "round-trip")
    again = _described(spark, d).where("id % 3 = 0").select("id", "vector", F.to_variant_object(F.struct((F.col("label") + 10).alias("label"), "lang", "n_chars")).alias("metadata"))
    own.upsert_frame(again)
    own.write_batch([("delete", i) for i in range(0, 100, 5)])
    own.compact(0.3)
    found = _fields(own)
    db.close()
    return found


def store_reads(spark: SparkSession, d: str) -> DataFrame:
    """get, require, contains, ids and count, of documents on disk, buffered, replaced, deleted and absent."""
    db, own = _filled(spark, d, "reads")
    own.upsert(Document(3, [1.0] * 64, {"label": 77}))
    own.delete(4)
    rows = []
    for i in (0, 3, 4, 5, 1 << 40):
        doc = own.get(i)
        there = i in own
        try:
            required = own.require(i).metadata["label"]
        except DocumentNotFound:
            required = None
        rows.append((i, there, doc and doc.metadata["label"], required, doc and round(doc.vector[0], DIGITS), own.count(), own.ids().count()))
    db.close()
    return _rows(spark, rows, "id long, there boolean, label long, required long, first double, documents long, ids long")


def store_inserts(spark: SparkSession, d: str) -> DataFrame:
    """insert refuses what is there; upsert and delete tell what was; a batch is all or nothing."""
    db, own = _filled(spark, d, "inserts")
    told = []
    for i in (1, 10_000_000):
        try:
            own.insert(Document(i, [0.5] * 64))
            told.append((f"insert {i}", "inserted"))
        except DuplicateId:
            told.append((f"insert {i}", "duplicate"))
    told += [(f"upsert {i}", own.upsert(Document(i, [0.25] * 64))) for i in (2, 10_000_001)]
    told += [(f"delete {i}", "was there" if own.delete(i) else "missing") for i in (2, 2, 10_000_002)]
    before = own.count()
    try:
        own.write_batch([("delete", 5), ("upsert", Document(6, [1.0]))])
    except BatchAborted as e:
        told.append(("batch", f"aborted at {e.failed_at} of {e.total_ops}, {own.count() - before} rows changed"))
    report = own.write_batch([("upsert", Document(7, [1.0] * 64)), ("upsert", Document(10_000_003, [1.0] * 64)), ("delete", 8), ("delete", 10_000_004)])
    told.append(("report", f"{report.inserted} {report.updated} {report.deleted} {report.missing_deletes}"))
    db.close()
    return _rows(spark, told, "step string, outcome string")


def store_search(spark: SparkSession, d: str) -> DataFrame:
    """Collection.search with a filter over stored metadata."""
    db, own = _filled(spark, d, "search")
    found = own.search(_first_vector(spark, d), 20, {"lang": "en", "label": {"$lt": 7}})
    db.close()
    return _rows(spark, [(h.id, round(h.score, DIGITS), h.document.metadata["label"]) for h in found.hits], "id long, score double, label long")


def store_search_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a filtered search reads and considers; a search that would read more than it may is refused."""
    db, own = _filled(spark, d, "stats")
    query = _first_vector(spark, d)
    stats = own.search(query, 5, {"label": 3}).stats
    try:
        own.search(query, 5, max_scanned=10)
        refused = False
    except Cancelled:
        refused = True
    db.close()
    return _rows(spark, [(stats.index, stats.exact, stats.considered, stats.scanned, stats.skipped, refused)], "index string, exact boolean, considered long, scanned long, skipped long, refused boolean")


def store_ann(spark: SparkSession, d: str) -> DataFrame:
    """A stored index survives reopening, takes in rows that come later, reads few rows, and finds nine of ten neighbours."""
    db, own = _filled(spark, d, "ann", index="ann")
    number = own.build_index().number
    query = own.get(0).vector
    own.upsert(Document(20_000_000, query, {"label": 1}))
    db.close()
    with Database(spark, db.files.root) as db:
        own = db.collection("vectors")
        fast, exact = own.search(query, 10), own.search(query, 10, exact=True)
        new = {h.id for h in fast.hits[:2]} == {0, 20_000_000}
        near = len({h.id for h in fast.hits} & {h.id for h in exact.hits})
        rows = [(own.index().number == number, not fast.stats.exact and exact.stats.exact, new, near >= 9, fast.stats.scanned <= exact.stats.scanned, own.stats()["indexed"])]
    return _rows(spark, rows, "same_index boolean, approximate boolean, new_row boolean, near boolean, fewer_read boolean, indexed long")


def store_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every level of verification finds a sound database clean, and a lost segment missing."""
    db, own = _filled(spark, d, "verify")
    rows = [(level, (r := db.verify(level)).is_clean, r.segments_checked, r.collections["vectors"]["live"]) for level in ("quick", "checksums", "full")]
    db.files.delete("c_vectors/seg-1")
    rows.append(("lost", (r := db.verify("quick")).is_clean, r.segments_checked, None))
    db.close()
    return _rows(spark, rows, "level string, clean boolean, segments long, live long")


def store_reopen(spark: SparkSession, d: str) -> DataFrame:
    """Changes that were logged and never flushed are there after reopening; the owner of the lock ended without closing."""
    db, own = _filled(spark, d, "reopen")
    own.write_batch([("delete", i) for i in range(50)] + [("upsert", Document(60, [1.0] * 64, {"label": 99, "lang": "xx"}))])
    db._release()
    with Database(spark, db.files.root) as db:
        return written_once(_fields(db.collection("vectors")), _place(spark, "reopened"))


def written_once(df: DataFrame, path: str) -> DataFrame:
    """df as a table, for when what it reads is closed."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class _Crash(BaseException):
    pass


def _crashing(files: Files, at: int):
    """Lets the process end before the at-th change of a file; tells how many changes were begun."""
    begun = 0

    def failing(method):
        def run(*a, **b):
            nonlocal begun
            begun += 1
            if begun == at:
                raise _Crash
            return method(*a, **b)

        return run

    files.create, files.delete = failing(files.create), failing(files.delete)
    return lambda: begun


def store_crash_points(spark: SparkSession, d: str) -> DataFrame:
    """An upsert, a flush and a compaction that end at any change of a file leave the state from before or from after."""
    steps = {"upsert": lambda own: own.upsert(Document(1, [2.0, 0.0])), "flush": lambda own: own.flush(), "compact": lambda own: own.compact(0.0)}
    rows = []
    for name, act in steps.items():
        sound, at, ended = 0, 0, False
        while not ended:
            at += 1
            db = Database(spark, _place(spark, "crash"))
            own = db.create_collection("c", 2, id_kind="u64")
            own.upsert_many([Document(i, [1.0, float(i)]) for i in range(3)])
            if name == "compact":
                own.flush()
                own.delete(2)
                own.flush()
            before = {0: 1.0, 1: 1.0} if name == "compact" else {0: 1.0, 1: 1.0, 2: 1.0}
            allowed = [before, before | {1: 2.0}] if name == "upsert" else [before]
            begun = _crashing(db.files, at)
            try:
                act(own)
                ended = begun() < at
            except _Crash:
                pass
            db._open = False  # the process is gone: the lock stays, and nothing is flushed
            Files(spark, db.files.root).delete("LOCK")
            with Database(spark, db.files.root) as again:
                found = {r.id: r.x for r in again.collection("c").frame().select("id", F.col("vector")[0].alias("x")).collect()}
                sound += found in allowed and again.verify("full").is_clean
        rows.append((name, sound == at))
    return _rows(spark, rows, "step string, sound boolean")


def database_stats(spark: SparkSession, d: str) -> DataFrame:
    """Database.stats of three collections: what is live, stored, and in segments."""
    db = Database(spark, _place(spark, "database"))
    for part in range(3):
        own = db.create_collection(f"part{part}", 64, id_kind="u64")
        own.upsert_frame(_corpus(spark, d).where(F.col("id") % 3 == part).select("id", "vector"))
        if part:
            own.write_batch([("delete", i) for i in range(60)])
            own.flush()
    stats = db.stats()
    rows = [(n, c["live"], c["total_rows"], c["segments"]) for n, c in stats["collections"].items()]
    db.close()
    return _rows(spark, [*rows, ("*", stats["live"], stats["total_rows"], stats["segments"])], "collection string, live long, total_rows long, segments long")


_FIELDS = "cast(label as bigint) as label"
_HERE = "embeddings left join documents on doc_id = vec_id"
_add("store_round_trip", store_round_trip, f"select vec_id as id, cast(case when vec_id % 3 = 0 then label + 10 else label end as bigint) as label, lang from {_HERE} where not (vec_id < 100 and vec_id % 5 = 0)")
_add(
    "store_reads",
    store_reads,
    f"""with n as (select count(*) - 1 as documents from embeddings), asked as (select unnest([0, 3, 4, 5, 1099511627776]) as id)
select asked.id, vec_id is not null and asked.id <> 4 as there, case when asked.id = 3 then 77 when asked.id <> 4 then label end as label, case when asked.id = 3 then 77 when asked.id <> 4 then label end as required,
    case when asked.id = 3 then 1.0::double when asked.id <> 4 then round(cast(embedding[1] as double), {DIGITS}) end as first, documents, documents as ids from asked left join embeddings on vec_id = asked.id, n""",
)
_add(
    "store_inserts",
    store_inserts,
    "select * from (values ('insert 1', 'duplicate'), ('insert 10000000', 'inserted'), ('upsert 2', 'updated'), ('upsert 10000001', 'inserted'), ('delete 2', 'was there'), ('delete 2', 'missing'), ('delete 10000002', 'missing'), ('batch', 'aborted at 1 of 2, 0 rows changed'), ('report', '1 1 1 1')) t(step, outcome)",
)
_add("store_search", store_search, f"select id, score, {_FIELDS} from ({_knn_sql('cosine', 20, 'lang = ' + chr(39) + 'en' + chr(39) + ' and label < 7', extra=', label')})")
_add("store_search_stats", store_search_stats, "select 'flat' as index, true as exact, count(*) filter (label = 3) as considered, count(*) as scanned, count(*) filter (label <> 3) as skipped, true as refused from embeddings")
_add("store_ann", store_ann, "select true as same_index, true as approximate, true as new_row, true as near, true as fewer_read, count(*) + 1 as indexed from embeddings")
_add("store_verify", store_verify, "select level, level <> 'lost' as clean, 1::bigint as segments, case when level <> 'lost' then n end as live from (values ('quick'), ('checksums'), ('full'), ('lost')) t(level), (select count(*) as n from embeddings)")
_add("store_reopen", store_reopen, f"select vec_id as id, case when vec_id = 60 then 99 else cast(label as bigint) end as label, case when vec_id = 60 then 'xx' else lang end as lang from {_HERE} where vec_id >= 50")
_add("store_crash_points", store_crash_points, "select * from (values ('upsert', true), ('flush', true), ('compact', true)) t(step, sound)")
_add(
    "database_stats",
    database_stats,
    """with p as (select 'part' || (vec_id % 3) as collection, count(*) as total_rows, count(*) filter (vec_id % 3 = 0 or vec_id >= 60) as live, 1::bigint as segments from embeddings group by 1)
select collection, live, total_rows, segments from p union all select '*', cast(sum(live) as bigint), cast(sum(total_rows) as bigint), 3::bigint from p""",
)
