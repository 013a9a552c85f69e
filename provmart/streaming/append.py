"""The idempotent append on a stream: every micro-batch passes the same guard.

Which of two rows with one key wins must not depend on how files are split or on a batch that is
tried again, so rows are told apart by an order of their own: that of all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commits import Store
from ..operators.load import append


def own_order(df: DataFrame) -> Column:
    """The columns of a row as one value to order by; types without an order go as text."""
    return F.struct(*[F.to_json(c) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in df.columns])


def append_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, hashed: str | None = None) -> StreamingQuery:
    """Append what is new of every micro-batch; a batch that is tried again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        append(df.withColumn("_ordinal", own_order(df)), path, keys, "_ordinal", hashed)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_marts(stream: DataFrame, store: str, checkpoint: str, name: str, raw: str, keys: list[str], mart_keys: list[str], order: list[Column], hashed: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Raw table and latest-by mart of a stream, each micro-batch in one commit.

    A batch that is tried again after its commit is known by its number and writes nothing; one that is
    lost before leaves no trace.  The mart reads and writes only the buckets that the batch touches.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        with Store(df.sparkSession, store).batch(name, epoch) as b:
            rows = df.withColumn("_ordinal", own_order(df))
            b.append(raw, rows, keys, "_ordinal", hashed)
            b.keep_latest(f"{raw}_latest", df, mart_keys, order, buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by tumbling window and key; late rows are dropped after the watermark."""
    t = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return t.groupBy(F.window("_ts", width), key).count().select(F.col("window.start").alias("start"), key, "count")
