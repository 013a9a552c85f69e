"""Ranks over a whole table or within groups without one task per group.

Rows are dealt by ranges of (group, order) and sorted inside each range; a small table of
how many rows of a group every range holds gives the rank at which a range begins.  A group
that holds most of the table is spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Rows of a range, which one task sorts.
RANGE_ROWS = 50_000


def ranked(df: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``idx`` (rank from 0 in its group) and ``n`` (rows of its group); returns a work table's rows.

    Nulls are keys like others and come where ``order`` puts them; a null group is a group.
    Rows that tie in all of ``order`` get neighbouring ranks in an order that is fixed once
    written.  Columns named idx, n, _at and _part of ``df`` are not kept.
    """
    base = df if hasattr(df, "work_path") else work.stored(df.drop("idx", "n", "_at", "_part"), "rows")
    parts = max(1, -(-base.count() // range_rows))
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    cut = base.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    cut = work.stored(cut, "ranges")
    if base is not df:
        work.forget(base)
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    runs = cut.groupBy(part, *[F.col(c).alias(names[c]) for c in group]).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = list(names.values())
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", *own, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(*own)).alias("n"))
    runs = work.stored(runs, "runs")
    on = F.shiftright(cut["_at"], 33).cast("int") == runs["_part"]
    for c in group:
        on &= cut[c].eqNullSafe(runs[names[c]])
    out = cut.join(work.sized(runs, 64), on)
    return out.select(*[c for c in cut.columns if c != "_at"], (F.col("_at") + F.col("_shift")).alias("idx"), "n")
