"""Latest-per-key marts over staged snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import month


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in a total order. Spark prunes rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: The newest text stamp wins; then fetched, manual, anchored; then the address.
SNAPSHOT_ORDER = ("captured_at", "precedence", "source_url")


def snapshot_order() -> list[Column]:
    return [F.desc("captured_at"), F.asc("precedence"), F.asc("source_url")]


def stage_snapshots(raw: DataFrame) -> DataFrame:
    """Tag, precedence and month of raw snapshots; ``captured_at`` stays text."""
    return raw.withColumns({
        "tag": F.when(F.col("origin") == "anchor", F.lit("Documented")).otherwise(F.lit("Measured")),
        "precedence": F.when(F.col("origin") == "fetch", 0).when(F.col("origin") == "manual", 1).otherwise(2),
        "month": month(F.col("captured_at")),
    })


def stage_reviews(raw: DataFrame) -> DataFrame:
    return latest_by(raw, ["source", "external_id"], [F.desc("captured_at"), F.desc("content_hash")])


def rating_trend(stg: DataFrame) -> DataFrame:
    rated = stg.where(F.col("rating").isNotNull())
    return latest_by(rated, ["channel", "segment", "source", "profile", "month"], snapshot_order()).select("channel", "segment", "source", "profile", "month", "rating", "tag")


def channel_gap(stg: DataFrame) -> DataFrame:
    rated = stg.where(F.col("rating").isNotNull())
    return latest_by(rated, ["segment", "channel", "source", "profile"], snapshot_order()).select("segment", "channel", "source", "profile", "rating", "captured_at", "tag")


def peer_ratings(stg: DataFrame, channel: str) -> DataFrame:
    rated = stg.where((F.col("channel") == channel) & F.col("rating").isNotNull())
    return latest_by(rated, ["segment", "source", "profile"], snapshot_order()).select("segment", "source", "profile", "rating", "captured_at", "tag")


def platform_stats(stg: DataFrame, measures: list[str]) -> DataFrame:
    """Latest value of every measure on its own: one scan, unpivoted, then latest per key."""
    long = stg.unpivot(["segment", "source", "profile", *SNAPSHOT_ORDER, "tag"], [F.col(m).cast("decimal(12,3)").alias(m) for m in measures], "stat", "value")
    return latest_by(long.where("value IS NOT NULL"), ["segment", "source", "profile", "stat"], snapshot_order()).select("segment", "source", "profile", "stat", "value", "captured_at", "tag")
