"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the vertex; no component is ever gathered in one task. Each round ends in a
written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._store import Tables


def _hang(links: DataFrame, least_of: DataFrame) -> DataFrame:
    return links.join(least_of, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return _hang(both.where(F.col("v") > F.col("u")), least).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    return _hang(down, least).unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """From links (u, v) of longs: a table (u, v) with each linked vertex u but the least, and v the least of its component."""
    links = tables.written(_small_star(_large_star(links.where("u <> v"))), "components")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links
        before, last = now, links
        links = tables.written(_small_star(_large_star(links)), "components")
        tables.drop(last)
