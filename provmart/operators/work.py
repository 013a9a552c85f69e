"""Work tables: intermediate results in the folder that all executors share."""

from __future__ import annotations

import itertools
import re
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="work-")


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs in one process, as in tests, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own()
    return found.rstrip("/")


_COUNTER = itertools.count()


def unique(spark: SparkSession) -> str:
    """A name that no other application and no other call has; nothing is drawn at random."""
    return f"{spark.sparkContext.applicationId}-{next(_COUNTER)}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/work/{name}-{unique(spark)}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, so that lineage ends there and every later pass reads the same rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete work tables that no later step reads; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "work_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: A table that is counted or bounded below this is sent to all executors.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """A work table with a broadcast hint if its counted rows fit ``bound``, else as it is (shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= bound else df
