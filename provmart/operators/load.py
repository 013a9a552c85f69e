"""Idempotent append: fingerprints, first of a batch wins, conflicts refuse the whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import work


class Refused(Exception):
    """Input that breaks a declared rule; one line says which."""


def first_wins(batch: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows with one key, the first by an explicit ordinal."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def blank_key(batch: DataFrame, keys: list[str]) -> None:
    """Refuse a batch in which a key column is null or blank: one aggregate for all of them."""
    blank = lambda k: F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    found = batch.agg(*[F.count_if(blank(k)).alias(k) for k in keys]).first()
    for k in keys:
        if found[k]:
            raise Refused(f"{k}: a key must not be empty")


def conflicts(batch: DataFrame, keys: list[str], hashed: str, raw: DataFrame | None = None) -> DataFrame:
    """Keys that have two fingerprints, in the batch or together with what is stored."""
    rows = batch.select(*keys, hashed)
    if raw is not None:
        stored = raw.join(batch.select(*keys).distinct(), keys, "left_semi")
        rows = rows.union(stored.select(*keys, hashed))
    out = rows.groupBy(*keys).agg(F.count_distinct(hashed).alias("versions"))
    return out.where("versions > 1")


def new_rows(batch: DataFrame, keys: list[str], ordinal: str, raw: DataFrame | None = None) -> DataFrame:
    out = first_wins(batch, keys, ordinal)
    return out if raw is None else out.join(raw.select(*keys), keys, "left_anti")


def append(batch: DataFrame, path: str, keys: list[str], ordinal: str, hashed: str | None = None) -> int:
    """Append what is new to one plain table; with ``hashed``, refuse the batch if a key changes its fingerprint.

    The batch is written aside once, and so is what is new of it.  Several tables that belong
    together are appended by ``commits.Store``.
    """
    spark = batch.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    raw = spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None
    rows = work.stored(batch, "batch")
    new = None
    try:
        blank_key(rows, keys)
        if hashed and (bad := conflicts(rows, keys, hashed, raw).first()):
            raise Refused(f"{', '.join(f'{k}={bad[k]}' for k in keys)}: a second fingerprint under one key")
        new = work.stored(new_rows(rows, keys, ordinal, raw).drop(ordinal), "new")
        if n := new.count():
            new.write.mode("append").parquet(path)
        return n
    finally:
        work.forget(rows, *([new] if new is not None else []))


def check_schema(found: DataFrame, declared: str) -> None:
    """Refuse a table whose columns differ from their declaration, naming the first difference."""
    want = found.sparkSession.createDataFrame([], declared).schema
    for i, (a, b) in enumerate(zip(found.schema.fields, want.fields, strict=False)):
        if (a.name, a.dataType) != (b.name, b.dataType):
            raise Refused(f"column {i}: {a.name} {a.dataType.simpleString()}, declared {b.name} {b.dataType.simpleString()}")
    if len(found.schema) != len(want):
        raise Refused(f"{len(found.schema)} columns, declared {len(want)}")
