import re

from loomspark.llm._store import written
from loomspark.llm.url_filter import RULES, host_reputation, judge_urls, op9_url_reputation


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [(n, v) for v, n in RULES if (host == (at := n.partition("/")[0]) or host.endswith("." + at)) and path.startswith("/" + n.partition("/")[2])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_awkward_urls(spark, awkward):
    urls = {(r.page_id, r.url) for r in spark.read.parquet(f"{awkward}/pages.parquet").collect()}
    found = op9_url_reputation(spark, awkward).collect()
    assert len(found) == 12
    seen = {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in found}
    assert seen == {(i, *(hp := parts(u)), *rule_of(*hp)) for i, u in urls}


def test_reputation_shrinks_and_blocks(spark):
    pages = [(i, f"http://{h}/x") for i, h in enumerate(["spam.bad.org"] * 40 + ["fine.good.org"] * 40 + ["once.other.org"] + ["new.bad.org"])]
    labels = [(i, 0, 1) for i in range(40)] + [(i, 1, 0) for i in range(40, 80)] + [(80, 0, 1)]
    found = {r.host: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert found["spam.bad.org"] == "block" and found["fine.good.org"] == "allow" and found["once.other.org"] == "allow"
    hosts = spark.createDataFrame([("a.x.org", 100, 100), ("b.x.org", 0, 0), ("c.y.org", 100, 0)], "host string, n long, bad long")
    bound = {r.host: r.bad_bound for r in host_reputation(hosts).collect()}
    assert bound["a.x.org"] > bound["b.x.org"] > bound["c.y.org"]


def test_empty(spark, empty):
    assert op9_url_reputation(spark, empty).count() == 0


def test_suffixes_of_two_labels_ports_and_long_urls(spark):
    hosts = [("a.co.uk", 200, 200), ("b.co.uk", 200, 0), ("x.b.co.uk:8080", 0, 0), ("u@y.a.co.uk", 0, 0), ("a.b.c.org", 50, 25), ("d.b.c.org", 50, 20), ("", 5, 1), ("localhost", 3, 0)]
    found = {r.host: r.bad_bound for r in host_reputation(written(spark.createDataFrame(hosts, "host string, n long, bad long"), "hosts")).collect()}
    assert len(found) == len(hosts)
    assert found["u@y.a.co.uk"] > found["x.b.co.uk:8080"] and found["a.co.uk"] > 0.9 > found["b.co.uk"]
    pages = [(1, "http://h.org/" + "x" * 200_000 + "?q"), (2, "http://" + "sub." * 20_000 + "example.com/en/z")]
    told = {r.page_id: r for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert len(told[1].path) == 200_001 and (told[2].rule, told[2].verdict) == ("example.com/en/", "block")


def test_hosts_of_one_page_do_not_switch_the_shrinkage_off(spark):
    """A thousand hosts with one labelled page each tell nothing of the spread: one bad page condemns none of them."""
    pages = [(i, f"http://h{i}.org/x") for i in range(1000)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(1000)]
    told = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert told.where("verdict = 'block'").count() == 0
