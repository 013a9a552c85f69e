"""Closed-form cost model: parameters, formulas as SQL text, scenarios, curves, crossovers, simulator.

Formulas chain at full precision and are rounded once, when they are output.  All tables
here have a constant size.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators.fit import z

# Name, default, unit, sourcing, low, high.
SCALE = [
    ("arr_eur", 8e8, "€ / year", "sourced", 8e8, 1.6e9),
    ("members", 1e6, "members", "sourced", 1e6, 2e6),
    ("fraud_pool_eur", 4e6, "€ / year", "sourced", 4e6, 8e6),
    ("refunded_eur", 3.5e8, "€ / year", "sourced", 3.5e8, 7e8),
]
KNOBS = [
    ("flag_rate", 0.05, "share of claims", "unsourced", 0.0, 0.2),
    ("fp_share", 0.5, "share of flagged", "unsourced", 0.1, 0.9),
    ("contacts", 3.0, "contacts per stuck claim", "unsourced", 1.0, 8.0),
    ("cost_per_contact", 8.0, "€", "unsourced", 2.0, 30.0),
    ("churn_prob", 0.05, "probability", "unsourced", 0.0, 0.3),
    ("k", 8.0, "diminishing-returns constant", "unsourced", 2.0, 20.0),
    ("days_per_round", 7.0, "days per document round trip", "unsourced", 1.0, 21.0),
    ("timer_days", 14.0, "days a hold may run before the clock", "unsourced", 1.0, 60.0),
]
# Where the sourced parameters are from; the others have no source.
CITED = {
    **dict.fromkeys(("arr_eur", "members", "fraud_pool_eur", "refunded_eur"), "published figures of the insurer"),
    **dict.fromkeys(("mu", "sigma", "emp_p50", "emp_mean"), "fit of the open amounts"),
    "extra_billing_share": "fee table of the public insurer",
}
FIT = {"mu": 3.809814, "sigma": 2.187981, "n": 5000, "emp_p50": 49.76, "emp_mean": 847.590174}
FEE_SHARE = (0.172708, 0.010292, 0.493113)

# Name, formula, unit; each may use those before it.
FORMULAS = [
    ("customer_value", "arr_eur / members", "eur"),
    ("mean_claim", "exp(mu + sigma * sigma / 2)", "eur"),
    ("median_cell", "emp_p50", "eur"),
    ("claims", "refunded_eur / mean_claim", "count"),
    ("claims_at_mean_cell", "refunded_eur / emp_mean", "count"),
    ("flagged", "claims * flag_rate", "count"),
    ("false_pos", "flagged * fp_share", "count"),
    ("fraud_saved", "fraud_pool_eur * (1 - exp(-k * flag_rate))", "eur"),
    ("friction_cost", "false_pos * (contacts * cost_per_contact + churn_prob * customer_value)", "eur"),
    ("net", "fraud_saved - friction_cost", "eur"),
    ("loop_days", "contacts * days_per_round", "days"),
    ("friction_per_day", "(contacts * cost_per_contact + churn_prob * customer_value) / loop_days", "eur"),
    ("timer_amount_eur", "fp_share * friction_per_day * least(timer_days, loop_days) / (1 - fp_share)", "eur"),
]
UNIT = {n: u for n, _, u in FORMULAS}
SCENARIOS = {"baseline": {}, "contacts_once": {"contacts": "1.0D"}, "churn_halved": {"churn_prob": "churn_prob / 2"}, "both": {"contacts": "1.0D", "churn_prob": "churn_prob / 2"}}
#: Simulator scenario: (cost scenario, contacts once, timer on).
SIMULATED = {"no_fix": ("baseline", False, False), "ask_once": ("contacts_once", True, False), "hold_timer": ("churn_halved", False, True), "both_fixes": ("both", True, True)}
GRID, GRID_STEP, RANKS, SLA_DAYS = 41, 0.005, 1000, 60


def parameters(fit: dict[str, float] = FIT, fee: tuple[float, float, float] = FEE_SHARE) -> list[tuple]:
    """17 rows; mu and sigma range over two standard errors."""
    se_mu, se_sigma = fit["sigma"] / sqrt(fit["n"]), fit["sigma"] / sqrt(2 * fit["n"])
    around = lambda x, se: (round(x - 2 * se, 6), round(x + 2 * se, 6))
    fitted = [
        ("mu", round(fit["mu"], 6), "log-euros", "sourced", *around(fit["mu"], se_mu)),
        ("sigma", round(fit["sigma"], 6), "log-euros", "sourced", *around(fit["sigma"], se_sigma)),
        *[(n, round(fit[n], 2), "€", "sourced", round(fit[n], 2), round(fit[n], 2)) for n in ("emp_p50", "emp_mean")],
        ("extra_billing_share", round(fee[0], 6), "share of fees billed", "sourced", round(fee[1], 6), round(fee[2], 6)),
    ]
    rows = SCALE + fitted + KNOBS
    for row in rows:
        check_parameter(row, CITED.get(row[0], ""))
    return rows


def check_parameter(row: tuple, citation: str) -> None:
    """One of two sourcings, a citation if and only if it is sourced, and a default inside its range."""
    name, default, _, sourcing, low, high = row
    if sourcing not in ("sourced", "unsourced"):
        raise ValueError(f"{name}: sourcing {sourcing!r} is neither sourced nor unsourced")
    if (sourcing == "sourced") != bool(citation):
        raise ValueError(f"{name}: {sourcing}, with{'' if citation else 'out'} a citation")
    if not low <= default <= high:
        raise ValueError(f"{name}: default {default} outside {low} to {high}")


def from_artifacts(fit: dict[str, float], split: dict[str, tuple[int, int, float]]) -> list[tuple]:
    """The parameters of a fit artifact and a fee-split artifact as ``files.read_fit`` and ``read_fee_split`` give them."""
    shares = [share for family, (_, _, share) in split.items() if family != "overall"]
    return parameters(fit, (split["overall"][2], min(shares), max(shares)))


def cost_params(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or parameters(), "name string, default_value double, unit string, sourcing string, low double, high double").withColumn("tag", F.when(F.col("sourcing") == "sourced", "Documented").otherwise("Modeled"))


def _base(spark: SparkSession, scenarios: dict[str, dict[str, str]] = SCENARIOS, rows: list[tuple] | None = None) -> DataFrame:
    """One row per scenario with its parameter values."""
    values = {r[0]: r[1] for r in rows or parameters()}
    df = spark.createDataFrame([(s,) for s in scenarios], "scenario string").select("scenario", *[F.lit(float(v)).alias(n) for n, v in values.items()])
    changed = {n for o in scenarios.values() for n in o}
    for n in sorted(changed):
        case = " ".join(f"WHEN '{s}' THEN {o[n]}" for s, o in scenarios.items() if n in o)
        df = df.withColumn(n, F.expr(f"CASE scenario {case} ELSE {n} END"))
    return df


def evaluated(df: DataFrame) -> DataFrame:
    """All formulas, each over the columns and formulas before it, at full precision."""
    for name, text, _ in FORMULAS:
        df = df.withColumn(name, F.expr(text))
    return df


def cost_outputs(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """13 outputs and 2 crossovers for every scenario: 60 rows."""
    points = evaluated(_base(spark, rows=rows)).select("scenario", *[rounded(u, F.col(n)).alias(n) for n, _, u in FORMULAS])
    long = points.unpivot(["scenario"], [n for n, _, _ in FORMULAS], "name", "value")
    cross = crossovers(spark, rows).unpivot(["scenario"], ["crossover_flag_rate", "marginal_crossover_flag_rate"], "name", "value")
    units = spark.createDataFrame([*[(n, u) for n, _, u in FORMULAS], ("crossover_flag_rate", "rate"), ("marginal_crossover_flag_rate", "rate")], "name string, unit string")
    return long.union(cross).join(F.broadcast(units), "name").select("scenario", "name", "value", "unit")


def cost_curves(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """41 grid points of every scenario; net and its parts rounded on output."""
    grid = spark.range(GRID).select(F.round(F.col("id") * GRID_STEP, 6).alias("grid_rate"))
    points = _base(spark, rows=rows).crossJoin(F.broadcast(grid))  # four by forty-one
    default = F.col("flag_rate")
    points = points.withColumn("is_default", F.abs(F.col("grid_rate") - default) < 1e-9).withColumn("flag_rate", F.col("grid_rate"))
    return evaluated(points).select("scenario", "flag_rate", *[rounded("eur", F.col(n)).alias(n) for n in ("fraud_saved", "friction_cost", "net")], "is_default")


def crossovers(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """First rate with a net below zero, and first whose net is below the rate before it; of rounded nets."""
    w = Window.partitionBy("scenario").orderBy("flag_rate")
    curves = cost_curves(spark, rows).withColumn("before", F.lag("net").over(w))
    return curves.groupBy("scenario").agg(F.min(F.when(F.col("net") < 0, F.col("flag_rate"))).alias("crossover_flag_rate"), F.min(F.when(F.col("net") < F.col("before"), F.col("flag_rate"))).alias("marginal_crossover_flag_rate"))


def synthetic_claims(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """1,000 amounts at the middle quantiles of the fitted distribution."""
    fit = {r[0]: r[1] for r in rows or parameters()}
    ranks = [(k, (k - 0.5) / RANKS, z((k - 0.5) / RANKS)) for k in range(1, RANKS + 1)]
    zs = spark.createDataFrame(ranks, "claim_rank int, quantile double, z double")
    return zs.select("claim_rank", F.round("quantile", 6).alias("quantile"), F.round(F.exp(F.lit(fit["mu"]) + F.lit(fit["sigma"]) * F.col("z")), 2).alias("amount_eur"))


def _loop_and_timer(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Per simulated scenario: whole loop and timer days, and the baseline's threshold in cents."""
    point = {r.scenario: r for r in evaluated(_base(spark, rows=rows)).select("scenario", F.round("loop_days", 2).alias("loop"), "timer_days", F.round("timer_amount_eur", 2).alias("t")).collect()}
    held = [(s, c, int(round(point["contacts_once" if once else "baseline"].loop)), int(round(point["baseline"].timer_days)), timer, point["baseline"].t) for s, (c, once, timer) in SIMULATED.items()]
    return spark.createDataFrame(held, "scenario string, curves_scenario string, loop_days int, timer_days int, timer_on boolean, threshold double")


def held(claims: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(claims, scenario, ..., hold_days, outcome): every claim under each of four scenarios, which are sent to it."""
    rows = claims.crossJoin(F.broadcast(scenarios))  # four rows for each claim
    loop = ~F.col("timer_on") | (F.col("loop_days") <= F.col("timer_days"))
    under = F.col("amount_eur") < F.col("threshold")
    hold = F.when(loop, F.col("loop_days")).when(under, F.col("timer_days")).otherwise(F.col("loop_days"))
    outcome = F.when(loop, "loop_released").when(under, "timer_released").otherwise("timer_escalated")
    return rows.withColumns({"hold_days": hold, "outcome": outcome})


def guardrail_sim(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Every synthetic claim under every scenario: how long it is held and how the hold ends. 4,000 rows."""
    return held(synthetic_claims(spark, rows), _loop_and_timer(spark, rows)).select("scenario", "curves_scenario", "claim_rank", "quantile", "amount_eur", "loop_days", "hold_days", "outcome")


def holds_of(claims: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """What the scenarios do to real claims (amount_eur), of any number: one pass, four partial sums a task."""
    return hold_summary(held(claims.select("amount_eur"), _loop_and_timer(claims.sparkSession, rows)))


def _timers(spark: SparkSession, rows: list[tuple] | None) -> DataFrame:
    """(day, is_default, timer_amount_eur) of timers of 1 to 60 days."""
    days = spark.range(1, SLA_DAYS + 1).select(F.col("id").cast("int").alias("day"))
    at = _base(spark, {"baseline": {}}, rows).crossJoin(days).withColumn("is_default", F.col("day") == F.col("timer_days")).withColumn("timer_days", F.col("day").cast("double"))
    return evaluated(at).select("day", "is_default", F.round("timer_amount_eur", 2).alias("timer_amount_eur"))


def sla_of(claims: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """The share of real claims strictly under the threshold of each timer: claims are counted by how many thresholds they reach, once."""
    spark = claims.sparkSession
    timers = _timers(spark, rows).orderBy("day").collect()  # sixty rows
    steps = F.array(*[F.lit(t.timer_amount_eur) for t in timers])
    reached = F.size(F.filter(steps, lambda t: t <= F.col("amount_eur")))
    counted = claims.where("amount_eur IS NOT NULL").groupBy(reached.alias("reached")).agg(F.count("*").alias("k"))
    # a threshold that is reached by none of the first ``n`` is above the claim, as thresholds never fall
    places = spark.createDataFrame([(t.day, t.is_default, t.timer_amount_eur, sum(o.timer_amount_eur <= t.timer_amount_eur for o in timers) - sum(o.timer_amount_eur == t.timer_amount_eur for o in timers)) for t in timers], "timer_days int, is_default boolean, timer_amount_eur double, below int")
    under = F.sum(F.when(F.col("reached") <= F.col("below"), F.col("k")).otherwise(0))
    out = places.crossJoin(counted).groupBy("timer_days", "timer_amount_eur", "is_default").agg((under / F.sum("k")).alias("s"))  # sixty by sixty-one
    return out.select("timer_days", "timer_amount_eur", F.round("s", 6).alias("share_under"), "is_default")


def sla_threshold(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The threshold re-evaluated for timers of 1 to 60 days, and the share of synthetic claims strictly under it."""
    at = _timers(spark, rows)
    share = at.crossJoin(F.broadcast(synthetic_claims(spark, rows))).groupBy("day", "is_default", "timer_amount_eur").agg(F.round(F.avg(F.when(F.col("amount_eur") < F.col("timer_amount_eur"), 1.0).otherwise(0.0)), 6).alias("share_under"))
    return share.select(F.col("day").alias("timer_days"), "timer_amount_eur", "share_under", "is_default")


def hold_summary(sim: DataFrame) -> DataFrame:
    released: Column = F.avg(F.when(F.col("outcome") == "timer_released", 1.0).otherwise(0.0))
    return sim.groupBy("scenario").agg(F.round(F.avg("hold_days"), 2).alias("mean_hold_days"), F.round(released, 6).alias("released_share"), F.sum(F.when(F.col("outcome") == "timer_released", 1).otherwise(0)).alias("released"), F.count("*").alias("claims"))
