"""The other serving panels and rules as queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import ast
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import latest as L
from ..sources import artifacts
from . import cost_model as M
from . import registry as R
from . import serve

# Panels whose figure is not there yet, and what they say instead.
PENDING = {"b1_1": "no public figure yet", "b2_1": "the drill is in the export", "b4_4": "no pilot has run"}
# Text shown for a theme.
PARAPHRASES = {
    "billing": ("Billing", "A charge  or license\nis not understood", "curated"),
    "delay": ("Delay", "An answer takes\n  too long", "curated"),
    "refund": ("Refund", "Money comes back late", "curated"),
}
#: The corpus of a run, by its run id.
CORPORA = {"run-1": "counted"}
FACTS = {"clock reads": 0, "network imports": 0, "unseeded random draws": 0}


def pending(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        serve.check_panel(serve.Panel(name, "hero", name, [serve.Point(name, None, "Pending", PENDING[name])]))
        return spark.createDataFrame([(name, "Pending", PENDING[name])], "panel string, tag string, absent string")

    return query


def gated(df: DataFrame) -> DataFrame:
    """The rows of a mart if its one run id is of a known corpus; an unknown or second one is refused, none gives no rows."""
    serve.corpus_gate(df, CORPORA)
    return df.drop("run_id")


def _runs(spark, sf) -> DataFrame:
    return R.dated(spark, sf).withColumn("run_id", F.lit("run-1"))


def theme_share_run(spark, sf):
    return K.theme_share(_runs(spark, sf), ["month", "segment"], run_id="run_id")


def panel_segment(spark, sf):
    share = gated(K.theme_share(_runs(spark, sf), ["segment"], run_id="run_id"))
    return share.where(F.col("label").isin("delay", K.UNCLASSIFIED)).select("segment", "label", "share", "reviews")


def panel_stats(spark, sf):
    return R.platform_stats(spark, sf).where("segment = '1-URGENT' AND source = 'orders' AND profile = '0'").select("stat", "value", "tag")


def panel_peers(spark, sf):
    return R.peer_ratings(spark, sf).select("segment", "source", "profile", "rating", "tag")


def panel_quality(spark, sf):
    """Held-out quality, only if anything was predicted or is in the key."""
    rows = R.heldout_quality(spark, sf)
    graded = rows.agg(F.coalesce(F.sum(F.col("predicted") + F.col("actual")), F.lit(0)).alias("n"))
    return rows.join(F.broadcast(graded.where("n > 0").select(F.lit(1).alias("one"))), F.lit(1) == F.col("one")).drop("one")


def panel_formulas(spark, sf):
    """The baseline's outputs in the order of their formulas."""
    order = spark.createDataFrame([(i, n, f) for i, (n, f, _) in enumerate(M.FORMULAS, 1)], "place int, name string, expression string")
    return M.cost_outputs(spark).where("scenario = 'baseline'").join(F.broadcast(order), "name").select("place", "name", "expression", "value", "unit")


def panel_curve(spark, sf):
    """The baseline's curve with the rates at which it crosses; exactly one point is the default."""
    curve = M.cost_curves(spark).where("scenario = 'baseline'")
    if curve.where("is_default").count() != 1:
        raise serve.Refused("the curve needs one default point")
    return curve.join(F.broadcast(M.crossovers(spark)), "scenario").select("flag_rate", "fraud_saved", "friction_cost", "is_default", "crossover_flag_rate", "marginal_crossover_flag_rate")


def panel_sourced(spark, sf):
    return M.cost_params(spark).where("sourcing = 'sourced'").select("name", "default_value", "unit", "low", "high", "tag")


def panel_unsourced(spark, sf):
    return M.cost_params(spark).where("sourcing = 'unsourced'").select("name", "default_value", "unit", "low", "high", "tag")


def panel_net(spark, sf):
    return M.cost_curves(spark).groupBy("flag_rate").pivot("scenario", list(M.SCENARIOS)).agg(F.first("net"))


def panel_sla(spark, sf):
    return M.sla_threshold(spark).where("is_default").select("timer_days", "timer_amount_eur", "share_under")


def determinism_facts(spark, sf):
    """Counted in the library's own code: calls that read a clock or draw without a seed, and imports of network modules."""
    clock, network = {"now", "today", "utcnow", "time", "current_timestamp", "current_date"}, {"socket", "requests", "http", "urllib3"}
    found = dict.fromkeys(FACTS, 0)
    top = Path(__file__).resolve().parent.parent
    for file in sorted(p for d in ("functions", "operators", "sources", "plans", "streaming") for p in (top / d).glob("*.py")):
        for node in ast.walk(ast.parse(file.read_text(encoding="utf-8"))):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                found["clock reads"] += node.func.attr in clock and not node.args
                found["unseeded random draws"] += node.func.attr in ("rand", "randn", "uuid4", "random") and not node.args
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            found["network imports"] += sum(n.split(".")[0] in network for n in names)
    return spark.createDataFrame(sorted(found.items()), "fact string, value long")


def panel_row_counts(spark, sf):
    """Rows by stage in the order of the stages, gated by the run they are of."""
    counts = R.stage_counts(spark, sf).withColumn("run_id", F.lit("run-1"))
    order = spark.createDataFrame([("raw", 1), ("staged", 2), ("classified", 3)], "stage string, place int")
    return gated(counts).join(F.broadcast(order), "stage").select("place", "stage", F.col("n").alias("value"))


def question_paraphrases(spark, sf):
    rows = [(k, *v) for k, v in PARAPHRASES.items()]
    df = spark.createDataFrame(rows, "theme string, theme_title string, paraphrase string, source string")
    return df.withColumn("paraphrase", F.trim(F.regexp_replace("paraphrase", r"\s+", " ")))


def classified_sorted(spark, sf):
    return R.classified(spark, sf).orderBy("doc_id", "theme")


def segment_of_platform(spark, sf):
    docs = R.table(spark, sf, "documents").select("doc_id", "source")
    known = docs.select(F.col("source").alias("platform")).distinct().withColumn("segment", F.concat(F.lit("s"), F.char_length("platform").cast("string")))
    return artifacts.with_segment(docs, known).select("doc_id", "source", "segment")


def first_of_capture(spark, sf):
    e = R.table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return L.latest_by(e, ["user_id", "day"], [F.asc("event_id")])


def snapshot_fingerprint(spark, sf):
    """Eight fields, numbers in their canonical spelling."""
    o = R.snapshots(spark, sf)
    fields = [F.col(c) for c in ("segment", "channel", "source", "profile")] + [T.canonical(F.col(c).cast("decimal(18,2)")) for c in R.MEASURES]
    return o.select("snapshot_id", T.fingerprint(*fields).alias("content_hash"))


def page_attribution(spark, sf):
    p = R.table(spark, sf, "pages")
    return p.select("page_id", T.fingerprint(F.regexp_extract("url", r"^https?://([^/]+)", 1), F.col("url")).alias("attribution_hash"))


def merged_series(spark, sf):
    o = R.table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", "o_orderkey")
    last = lambda df: df.groupBy("o_custkey", "month").agg(F.max("o_orderkey").alias("newest"))
    return artifacts.merged_series(last(o.where("o_orderkey % 2 = 0")), last(o.where("o_orderkey % 3 = 0")), ["o_custkey", "month"])


_SPELLED = "CASE p_partkey % 7 WHEN 0 THEN cast(p_size AS {s}) WHEN 1 THEN concat(p_size % 6, '.5') WHEN 2 THEN concat('0.', p_size) WHEN 3 THEN concat(p_size % 5, '.1234') WHEN 4 THEN concat('-', p_size) WHEN 5 THEN concat(p_size, ',5') ELSE concat(p_size % 5, '.0') END"


def validate_measures(spark, sf):
    p = R.table(spark, sf, "part").select("p_partkey", F.expr(_SPELLED.format(s="string")).alias("spelled"))
    return p.select("p_partkey", *[T.measure(n, F.col("spelled")).cast("double").alias(n) for n in T.MEASURES])


def validate_shapes(spark, sf):
    p = R.table(spark, sf, "part").select("p_partkey", F.expr(_SPELLED.format(s="string")).alias("spelled"))
    c = F.col("spelled")
    day = F.concat(F.lit("2026-0"), (F.col("p_partkey") % 10).cast("string"), F.lit("-"), F.lpad((F.col("p_partkey") % 33).cast("string"), 2, "0"))
    slashed = F.concat(F.substring(day, 9, 2), F.lit("/"), F.substring(day, 6, 2), F.lit("/"), F.substring(day, 1, 4))
    return p.select("p_partkey", T.half_step(c).cast("double").alias("half"), T.count_value(c).alias("count"), T.euro_total(c).alias("euros"), T.page_rating(c).cast("double").alias("page"), T.real_day(day).alias("day"), T.slashed_day(slashed).alias("slashed"))


def display_forms(spark, sf):
    x = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity").distinct()
    q = F.col("l_quantity")
    return x.select("l_orderkey", "l_linenumber", T.displayed("pct", F.col("l_discount")).alias("pct"), T.displayed("stars", q).alias("stars"), T.displayed("count", q).alias("count"), T.rounded_up(q).alias("bound"))


_ALL = (theme_share_run, panel_segment, panel_stats, panel_peers, panel_quality, panel_formulas, panel_curve, panel_sourced, panel_unsourced, panel_net, panel_sla, determinism_facts, panel_row_counts, question_paraphrases, classified_sorted, segment_of_platform, first_of_capture, snapshot_fingerprint, page_attribution, merged_series, validate_measures, validate_shapes, display_forms)
QUERIES = {f.__name__: f for f in _ALL} | {f"panel_{n}": pending(n) for n in PENDING}

_SQL = R.SQL
_DAY = "'2026-0' || (p_partkey % 10) || '-' || lpad(CAST(p_partkey % 33 AS VARCHAR), 2, '0')"
_REAL = f"CASE WHEN try_strptime({_DAY}, '%Y-%m-%d') IS NOT NULL THEN {_DAY} END"
_CANON = ", ".join(f"coalesce(regexp_replace(CAST(CAST({m} AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', ''), '')" for m in R.MEASURES)
_MEASURE = lambda name, whole, scale, most: f"CASE WHEN regexp_full_match(s, '[0-9]{{1,{whole}}}([.][0-9]{{1,{scale}}})?') AND CAST(s AS DOUBLE) <= {most} THEN CAST(s AS DOUBLE) END AS {name}"
_PARTS = f"(SELECT p_partkey, {_SPELLED.format(s='VARCHAR')} AS s FROM part)"
_RULES = [(allow, rule) for _, rules in R.html_pages.parse_robots(R.ROBOTS) for allow, rule in rules]


def _glob(rule: str) -> str:
    parts = (rule[:-1] if rule.endswith("$") else rule).split("*")
    return "^" + ".*".join("".join(c if c.isalnum() or c in "/=-_" else f"[{c}]" for c in p) for p in parts) + ("$" if rule.endswith("$") else "")


SQL = {
    "theme_share_run": f"SELECT *, 'run-1' AS run_id FROM ({_SQL['theme_share_by_month']})",
    "panel_segment": f"SELECT segment, label, share, reviews FROM ({_SQL['theme_share_by_segment']}) WHERE label IN ('delay', 'unclassified')",
    "panel_stats": f"SELECT stat, value, tag FROM ({_SQL['platform_stats']}) WHERE segment = '1-URGENT' AND source = 'orders' AND profile = '0'",
    "panel_peers": f"SELECT segment, source, profile, rating, tag FROM ({_SQL['peer_ratings']})",
    "panel_quality": f"SELECT * FROM ({_SQL['heldout_quality']}) WHERE (SELECT sum(predicted + actual) FROM ({_SQL['heldout_quality']})) > 0",
    "panel_formulas": "SELECT place, o.name, expression, value, unit FROM (" + _SQL["cost_outputs"] + ") o JOIN (VALUES " + ", ".join(f"({i}, '{n}', '{f}')" for i, (n, f, _) in enumerate(M.FORMULAS, 1)) + ") v(place, name, expression) ON v.name = o.name WHERE scenario = 'baseline'",
    "panel_curve": f"SELECT flag_rate, fraud_saved, friction_cost, is_default, crossover_flag_rate, marginal_crossover_flag_rate FROM ({_SQL['cost_curves']}) JOIN ({_SQL['cost_crossovers']}) USING (scenario) WHERE scenario = 'baseline'",
    "panel_sourced": f"SELECT name, default_value, unit, low, high, tag FROM ({_SQL['cost_params']}) WHERE sourcing = 'sourced'",
    "panel_unsourced": f"SELECT name, default_value, unit, low, high, tag FROM ({_SQL['cost_params']}) WHERE sourcing = 'unsourced'",
    "panel_net": "SELECT flag_rate, " + ", ".join(f"max(CASE WHEN scenario = '{x}' THEN net END) AS {x}" for x in M.SCENARIOS) + f" FROM ({_SQL['cost_curves']}) GROUP BY flag_rate",
    "panel_sla": f"SELECT timer_days, timer_amount_eur, share_under FROM ({_SQL['sla_threshold']}) WHERE is_default",
    "determinism_facts": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in FACTS.items()) + ") v(fact, value)",
    "panel_row_counts": f"SELECT CASE stage WHEN 'raw' THEN 1 WHEN 'staged' THEN 2 ELSE 3 END AS place, stage, n AS value FROM ({_SQL['stage_counts']})",
    "question_paraphrases": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{' '.join(b.split())}', '{c}')" for k, (a, b, c) in PARAPHRASES.items()) + ") v(theme, theme_title, paraphrase, source)",
    "classified_sorted": _SQL["classify_rules"] + " ORDER BY doc_id, theme",
    "segment_of_platform": "SELECT doc_id, source, 's' || length(source) AS segment FROM documents",
    "first_of_capture": "SELECT event_id, user_id, day FROM (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
    "snapshot_fingerprint": f"SELECT snapshot_id, sha256(concat_ws(chr(31), segment, channel, source, profile, {_CANON})) AS content_hash FROM ({R._SNAP})",
    "page_attribution": "SELECT page_id, sha256(concat_ws(chr(31), regexp_extract(url, '^https?://([^/]+)', 1), url)) AS attribution_hash FROM pages",
    "merged_series": "WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey FROM orders), a AS (SELECT o_custkey, month, max(o_orderkey) AS newest FROM o WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey, month, max(o_orderkey) AS newest FROM o WHERE o_orderkey % 3 = 0 GROUP BY ALL) SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (o_custkey, month)",
    "validate_measures": "SELECT p_partkey, " + ", ".join(_MEASURE(n, p - q, q, most) for n, (p, q, most) in T.MEASURES.items()) + f" FROM {_PARTS}",
    "validate_shapes": f"SELECT p_partkey, CASE WHEN regexp_full_match(s, '[1-4]([.]5)?|5') THEN CAST(s AS DOUBLE) END AS half, CASE WHEN regexp_full_match(s, '[0-9]{{1,10}}') THEN CAST(s AS INT) END AS count, CASE WHEN regexp_full_match(s, '[0-9]{{1,13}}') THEN CAST(s AS BIGINT) END AS euros, CASE WHEN regexp_full_match(s, '[0-9]{{1,2}}([.][0-9]{{1,32}})?') AND CAST(s AS DOUBLE) <= 5 THEN CAST(round_even(CAST(s AS DECIMAL(18, 6)), 3) AS DOUBLE) END AS page, {_REAL} AS day, {_REAL} AS slashed FROM {_PARTS}",
    "display_forms": "SELECT DISTINCT l_orderkey, l_linenumber, format('{:.1f}%', l_discount * 100) AS pct, format('{:.1f}★', CAST(l_quantity AS DOUBLE)) AS stars, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS count, CASE WHEN l_quantity > 0 THEN ceil(l_quantity / pow(10, floor(log10(l_quantity)))) * pow(10, floor(log10(l_quantity))) END AS bound FROM lineitem",
    "robots_allows": "SELECT page_id, coalesce((SELECT allow FROM (VALUES " + ", ".join(f"({len(p)}, {str(a).lower()}, '{_glob(p)}')" for a, p in _RULES) + ") v(n, allow, rule) WHERE regexp_matches(path, rule) ORDER BY n DESC, allow DESC LIMIT 1), true) AS allowed FROM (SELECT page_id, CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS path FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p FROM pages))",
} | {f"panel_{n}": f"SELECT '{n}' AS panel, 'Pending' AS tag, '{t}' AS absent" for n, t in PENDING.items()}
