"""Lognormal fit, deciles, systematic sample and fee split."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import work
from .load import Refused
from .ranks import ranked

DECILES = [k / 10 for k in range(1, 10)]


def z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def lognormal_fit(df: DataFrame, amount: str) -> DataFrame:
    """mu and sigma (population) of the logs, n, mean: one partial aggregate."""
    x = F.when(F.col(amount) > 0, F.col(amount))
    return df.agg(F.round(F.avg(F.ln(x)), 6).alias("mu"), F.round(F.stddev_pop(F.ln(x)), 6).alias("sigma"), F.count(x).alias("n"), F.round(F.avg(x), 6).alias("emp_mean"))


#: Accuracy of the sketch: ranks are known to one part in so many.
ACCURACY = 10_000
#: Rows of a range of bracketed values, which one task sorts.
SORTED = 50_000


def finite(c: Column) -> Column:
    """A number that is one: null, NaN and infinities are none."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def order_statistics(df: DataFrame, column: str, ranks: list[int], n: int | None = None, sketch: list[tuple[float, float]] | None = None) -> dict[int, float]:
    """The values at some places (from 0) of the numbers of a column in order: two scans at any size.

    A quantile sketch gives a bracket around every place.  One exact pass then counts what lies below each
    bracket and writes the rows inside all of them, a few parts in ten thousand; their ranks, over
    ranges, name the values.  A bracket that missed its place is widened to the whole column.
    """
    x = df.select(finite(F.col(column)).alias("x")).where("x IS NOT NULL")
    if n is None or sketch is None:
        n, sketch = _sketched(x, ranks, n)
    asked = [r for r in ranks if 0 <= r < n]
    if not asked:
        return {}
    spans = sorted({sketch[ranks.index(r)] for r in asked})
    out: dict[int, float] = {}
    while len(out) < len(asked):
        seen = Observation()
        inside = F.array_compact(F.array(*[F.when((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi)), F.lit(k)) for k, (lo, hi) in enumerate(spans)]))
        below = [F.count_if(F.col("x") < F.lit(lo)).alias(f"b{k}") for k, (lo, _) in enumerate(spans)]
        kept = x.observe(seen, *below).select("x", F.explode(inside).alias("span")).groupBy("span", "x").agg(F.count("*").alias("k"))
        kept = work.stored(kept, "brackets")
        # places of equal values are the first and the one after the last, from counts summed over ranges
        placed = _running(kept)
        wanted = [(r, span, r - seen.get[f"b{span}"]) for span in range(len(spans)) for r in asked if r not in out and r >= seen.get[f"b{span}"]]
        if wanted:
            here = [(F.col("span") == span) & (F.col("before") <= at) & (F.col("before") + F.col("k") > at) for _, span, at in wanted]
            rows = placed.where(reduce(lambda a, b: a | b, here)).collect()  # a row or none for each
            out |= {r: v.x for r, span, at in wanted for v in rows if v.span == span and v.before <= at < v.before + v.k}
        work.forget(kept)
        spans = [(float("-inf"), float("inf"))]
    return out


def _sketched(x: DataFrame, ranks: list[int], n: int | None) -> tuple[int, list[tuple[float, float]]]:
    n = x.count() if n is None else n
    if not n:
        return 0, []
    ends = [max(0.0, min(1.0, r / n + side * 3 / ACCURACY)) for r in ranks for side in (-1, 1)]
    found = x.agg(F.percentile_approx("x", ends, ACCURACY).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    return n, [(found.lo if ends[2 * i] == 0 else found.q[2 * i], found.hi if ends[2 * i + 1] == 1 else found.q[2 * i + 1]) for i in range(len(ranks))]


def _running(values: DataFrame) -> DataFrame:
    """(span, x, k, before): how many rows of the span come before each value, from sums over ranges of values."""
    parts = max(1, -(-values.count() // SORTED))
    cut = work.stored(values.repartitionByRange(parts, "span", "x").select("*", F.spark_partition_id().alias("part")), "spans")
    sums = cut.groupBy("span", "part").agg(F.sum("k").alias("n"))
    sums = sums.select("span", "part", F.coalesce(F.sum("n").over(Window.partitionBy("span").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("span", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("own", F.coalesce(F.sum("k").over(own), F.lit(0))).join(sums, ["span", "part"]).select("span", "x", "k", (F.col("base") + F.col("own")).alias("before"))


def fit_deciles(df: DataFrame, amount: str) -> DataFrame:
    """Empirical deciles (exact, interpolated) against exp(mu + sigma z): the fit and a sketch in one scan, one exact pass."""
    spark = df.sparkSession
    x = df.select(finite(F.col(amount)).alias("x")).where("x > 0")
    # the interpolated place of a decile lies between two ranks; both are within a bracket around it
    near = [max(0.0, min(1.0, p + side * 3 / ACCURACY)) for p in DECILES for side in (-1, 1)]
    fit = x.agg(F.avg(F.ln("x")).alias("mu"), F.stddev_pop(F.ln("x")).alias("sigma"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", near, ACCURACY).alias("q")).first()
    if not fit.n:
        return spark.createDataFrame([], "pct int, emp double, fit double")
    places = {p: (fit.n - 1) * p for p in DECILES}
    spans = {p: (fit.lo if fit.n < ACCURACY else fit.q[2 * i], fit.hi if fit.n < ACCURACY else fit.q[2 * i + 1]) for i, p in enumerate(DECILES)}
    asked = [(r, spans[p]) for p, h in places.items() for r in (int(h), min(fit.n - 1, int(h) + 1))]
    at = order_statistics(x, "x", [r for r, _ in asked], fit.n, [s for _, s in asked])
    rows = []
    for p, h in places.items():
        low, high = at[int(h)], at[min(fit.n - 1, int(h) + 1)]
        rows.append((round(p * 100), low + (high - low) * (h - int(h)), fit.mu, fit.sigma, z(p)))
    out = spark.createDataFrame(rows, "pct int, emp double, mu double, sigma double, z double")
    return out.select("pct", F.round("emp", 4).alias("emp"), F.round(F.exp(F.col("mu") + F.col("sigma") * F.col("z")), 4).alias("fit"))


def systematic_sample(df: DataFrame, valid: Column, order: str, n: int) -> DataFrame:
    """Every stride-th valid row in order, n at most; stride = max(1, valid // n).

    The order may be of any type; null keys come first.  Ranks come from ranges of rows, so no task numbers more than one range.
    """
    if n < 1:
        raise Refused(f"a sample of {n} rows")
    rows = ranked(df.where(valid), [F.col(order).asc_nulls_first()])
    stride = F.greatest(F.lit(1), F.expr(f"n DIV {n}"))
    return rows.where((F.col("idx") % stride == 0) & (F.expr("idx") / stride < n)).select(*df.columns)


def fee_split(df: DataFrame, family: str, tariff: str, extra: str) -> DataFrame:
    """extra / (tariff + extra) by family and overall, in one pass."""
    total = df.groupingSets([[F.col(family)], []], F.col(family)).agg(F.sum(extra).alias("e"), F.sum(tariff).alias("t"), F.grouping(family).alias("g"))
    return total.select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col(family)).alias("family"), F.round(F.col("e"), 2).alias("extra"), F.round(F.col("t"), 2).alias("tariff"), F.round(F.col("e") / (F.col("t") + F.col("e")), 6).alias("share"))
