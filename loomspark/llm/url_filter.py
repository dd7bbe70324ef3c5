"""URL filters with empirical-Bayes host reputation (operator 9).

Explicit rules come first, the longest fitting one. Otherwise the labelled pages of a host decide (a page's label is the
row of ``labels`` with its id; bad means quality 0 or toxic 1). Rates are shrunk along the hierarchy: a suffix towards
all pages, a registered domain towards its suffix, a host towards its domain, each by a beta prior whose weight comes
from the spread of the rates within their parents, less what chance alone would spread them. A host is blocked if the
lower bound of its posterior, which holds its parents' uncertainty as well, passes ``BAD_LIMIT``; at the limit it is allowed. Hosts without labels inherit. Pages are
reduced to one row per host before anything is joined. A user or port in a host doesn't count for its domain.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged as that host; a very long url is
read in whole; a label row with nulls only, or for no page, doesn't count; several label rows of a page count once, bad if
any is; repeated pages are judged alike; rules of equal length can't both fit; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._store import if_small, written
from loomspark.llm.priors import PRIOR_WEIGHT, prior_weight

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BAD_LIMIT, Z = 0.5, 1.645
# Public suffixes of two labels; every other suffix is a host's last label.
SUFFIXES = ("ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.pl", "com.sg", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule = verdict = None
    for what, name in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = name.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule = (rule.when(fits, name) if rule is not None else F.when(fits, name))
        verdict = (verdict.when(fits, what) if verdict is not None else F.when(fits, what))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def host_reputation(hosts: DataFrame) -> DataFrame:
    """From a written table of (host, n, bad), each host once: host and the lower bound of its rate of bad pages."""
    labels = F.split(F.regexp_replace("host", "^.*@|:[0-9]*$", ""), r"\.")
    ending = F.when(F.concat_ws(".", F.slice(labels, -2, 2)).isin(*SUFFIXES), 2).otherwise(1)
    name = lambda n: F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), n), F.least(F.size(labels), n)))
    hosts = hosts.where(F.size(labels) > 0).select("host", "n", "bad", name(ending + 1).alias("domain"), name(ending).alias("suffix"))

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        """What prior_weight needs of the groups of each parent; groups without labels tell nothing."""
        own = rows.groupBy(*by) if by else rows
        return own.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.when(F.col("n") > 0, 1)).alias("groups"), F.sum(F.col("n") * F.col("n")).alias("sizes"), F.coalesce(F.sum(F.expr("if(n > 0, bad * bad / n, 0)")), F.lit(0.0)).alias("squares"))

    domains = written(summed(hosts, "domain", "suffix"), "url-domains")
    suffixes = written(summed(domains, "suffix"), "url-suffixes")
    every = summed(suffixes)

    def weight(parents: DataFrame) -> float:
        own = parents.where("n > 0").agg(F.count("*").alias("parents"), F.sum("groups").alias("groups"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("squares").alias("squares"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("above"), F.sum(F.col("sizes") / F.col("n")).alias("sizes")).first()  # one row
        return prior_weight(own["groups"], own["parents"], own["n"], own["bad"], own["squares"], own["above"], own["sizes"]) if own["n"] else 1.0

    total = every.first()

    def posterior(rows: DataFrame, key: str, w: float, *keep: str) -> DataFrame:
        """Mean and variance of each row's rate, whose prior is above, with variance above_spread."""
        n, share = F.col("n") + F.lit(w), F.lit(w) / (F.col("n") + F.lit(w))
        rows = rows.withColumn("rate", (F.col("bad") + F.lit(w) * F.col("above")) / n)
        return rows.select(key, *keep, "rate", (F.col("rate") * (1 - F.col("rate")) / (n + 1) + share * share * F.col("above_spread")).alias("spread"))

    prior = lambda rows: rows.withColumnsRenamed({"rate": "above", "spread": "above_spread"})
    top = suffixes.withColumns({"above": F.lit(total["bad"] / total["n"] if total["n"] else 0.0), "above_spread": F.lit(0.0)})
    by_suffix = posterior(top, "suffix", weight(every))
    by_domain = posterior(domains.join(prior(by_suffix), "suffix"), "domain", weight(suffixes))
    by_host = posterior(hosts.join(prior(by_domain), "domain"), "host", weight(domains))
    return by_host.select("host", (F.col("rate") - Z * F.sqrt("spread")).alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = BAD_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.expr("cast(coalesce(quality = 0, false) or coalesce(toxic = 1, false) as long)")).alias("bad"))
    hosts = seen.select("page_id", "host").join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = host_reputation(written(hosts, "url-hosts")).where(F.col("bad_bound") > limit).select(F.col("host").alias("blocked"))
    judged = seen.join(if_small(written(blocked, "url-blocked")), F.col("host") == F.col("blocked"), "left")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked").isNull(), "allow").otherwise("block")).alias("verdict"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _weight(level: str, parent: str, key: str) -> str:
    """The weight of a level's prior, from the groups of level within parent."""
    low, high = PRIOR_WEIGHT
    return f"""(select case when k <= p or n <= k or b - w <= 1e-12 then {high} else greatest({low}, least({high}, n0 * w / (b - w))) end from (
        select k, p, n, (q - above) / nullif(k - p, 0) as b, (bad - q) / nullif(n - k, 0) as w, (n - sizes) / nullif(k - p, 0) as n0 from (
            select sum(own.k) as k, count(*) as p, sum(own.n) as n, sum(own.bad) as bad, sum(own.q) as q, sum(own.bad * own.bad / own.n) as above, sum(own.nn / own.n) as sizes
            from (select {key} as parent, count(*) as k, sum(n) as n, sum(bad) as bad, sum(bad * bad / n) as q, sum(n * n) as nn from {level} where n > 0 group by 1) own)))"""


def _fits(name: str) -> str:
    at, _, rest = name.partition("/")
    return f"(host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '/{rest}')"


_ORDERED = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
SQL = f"""
with seen as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
lab as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where quality is not null or toxic is not null group by 1),
hosts as (select host, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') as l, count(bad) as n, coalesce(sum(bad), 0) as bad from seen left join lab using (page_id) group by host),
ended as (select *, case when array_to_string(l[-2:], '.') in ({", ".join(f"'{x}'" for x in SUFFIXES)}) then 2 else 1 end as e from hosts),
h as (select host, array_to_string(l[-least(len(l), e + 1):], '.') as domain, array_to_string(l[-least(len(l), e):], '.') as suffix, n, bad from ended),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
t as (select coalesce(sum(bad) / nullif(sum(n), 0), 0) as rate from s),
ws as (select {_weight("s", "t", "1")} as s, {_weight("d", "s", "suffix")} as d, {_weight("h", "d", "domain")} as h),
sr as (select suffix, r, r * (1 - r) / (n + ws.s + 1) as v from (select suffix, n, (bad + ws.s * t.rate) / (n + ws.s) as r from s, t, ws), ws),
dr as (select domain, r, r * (1 - r) / (n + ws.d + 1) + (ws.d / (n + ws.d)) ** 2 * v as v from (select domain, n, (bad + ws.d * sr.r) / (n + ws.d) as r, sr.v as v from d join sr using (suffix), ws), ws),
hr as (select host, r, r * (1 - r) / (n + ws.h + 1) + (ws.h / (n + ws.h)) ** 2 * v as v from (select host, n, (bad + ws.h * dr.r) / (n + ws.h) as r, dr.v as v from h join dr using (domain), ws), ws),
blocked as (select host from hr where r - {Z} * sqrt(v) > {BAD_LIMIT})
select page_id, host, path, case {" ".join(f"when {_fits(n)} then '{n}'" for _, n in _ORDERED)} end as rule,
    case {" ".join(f"when {_fits(n)} then '{v}'" for v, n in _ORDERED)} when host in (select host from blocked) then 'block' else 'allow' end as verdict
from seen
"""
