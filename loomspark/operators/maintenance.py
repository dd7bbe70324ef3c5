"""Statistics, verification and compaction plans over rows of segments (segment, id, seq) and tombstones (id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """rows with a column live: no tombstone of the id is later than the row."""
    last = dead.groupBy("id").agg(F.max("seq").alias("dead_to"))
    return rows.join(last, "id", "left").withColumn("live", F.col("dead_to").isNull() | (F.col("seq") >= F.col("dead_to"))).drop("dead_to")


def live_rows(rows: DataFrame, dead: DataFrame) -> DataFrame:
    return marked(rows, dead).where("live").drop("live")


def segment_stats(rows: DataFrame) -> DataFrame:
    """segment, rows, live, dead_ratio from rows marked live."""
    found = rows.groupBy("segment").agg(F.count("*").alias("rows"), F.sum(F.col("live").cast("long")).alias("live"))
    return found.withColumn("dead_ratio", (F.col("rows") - F.col("live")) / F.col("rows"))


def collection_stats(rows: DataFrame) -> DataFrame:
    """One row: segments, total_rows, live, dead_ratio (0 when empty)."""
    found = segment_stats(rows).agg(F.count("*").alias("segments"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("live"), F.lit(0)).alias("live"))
    return found.withColumn("dead_ratio", F.when(F.col("total_rows") > 0, (F.col("total_rows") - F.col("live")) / F.col("total_rows")).otherwise(0.0))


def compaction_plan(rows: DataFrame, min_dead_ratio: float = 0.3) -> DataFrame:
    """The segments to rewrite: those whose dead rows make up at least this share."""
    return segment_stats(rows).where(F.col("dead_ratio") >= min_dead_ratio)


def compaction_report(rows: DataFrame, min_dead_ratio: float = 0.3) -> DataFrame:
    """One row: segments rewritten, whether a segment is made of them, rows reclaimed."""
    plan = compaction_plan(rows, min_dead_ratio)
    found = plan.agg(F.count("*").alias("rewritten"), F.coalesce(F.sum("live"), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.col("rows") - F.col("live")), F.lit(0)).alias("reclaimed"))
    return found.select("rewritten", F.when(F.col("kept") > 0, 1).otherwise(0).cast("long").alias("created"), "reclaimed")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ids that more than one live row has."""
    return rows.where("live").groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")


def percentile(values: DataFrame, column: str, q: float) -> DataFrame:
    """The nearest-rank percentile."""
    return values.agg(F.expr(f"percentile_disc({q}) within group (order by {column})").alias("value"))
