"""Queries over the driver's tables, and the same in SQL. See SURVEY for what each stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import fit as fitting
from ..operators import latest as L
from ..operators import load
from ..sources import files, html_pages
from . import cost_model as M

#: Rules for the synthetic prose: label -> literal patterns at word starts of folded text.
RULES = {
    "billing": ["license", "token"],
    "delay": ["nicht", "para"],
    "contact": ["pour", "with"],
    "coverage": ["ciones", "elle"],
    "refund": ["released", "mit", "sch"],
    "positive": ["for"],
}
LABELS = [*RULES, K.UNCLASSIFIED]
#: Declared pages of the sources.
SOURCES = [("feed", ["https://a.example/1", "https://a.example/2"]), ("listing", ["https://b.example/x"]), ("microdata", ["https://c.example/1", "https://c.example/2", "https://c.example/3"])]
ROBOTS = "User-agent: *\nDisallow: /*?\nAllow: /en/*page=2\nDisallow: /de/\nAllow: /de/1\nDisallow: /*.html$\n"
MEASURES = {"rating": ("o_totalprice", 7), "review_count": ("o_custkey", 5), "one_star_share": ("o_totalprice * 2", 3), "response_rate": ("o_custkey / 10", 4)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as staged snapshots: status is the channel, priority the segment."""
    o = table(spark, sf, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    origin = F.when(F.col("o_orderstatus") == "F", "anchor").when(F.col("o_orderstatus") == "O", "fetch").otherwise("manual")
    measures = {m: F.round(F.when(F.col("o_orderkey") % k != 0, F.expr(e)).cast("double"), 2) for m, (e, k) in MEASURES.items()}
    raw = o.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("channel"), F.lit("orders").alias("source"), (F.col("o_custkey") % 10).cast("string").alias("profile"), origin.alias("origin"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("captured_at"), key.alias("source_url"), *[c.alias(m) for m, c in measures.items()])
    return L.stage_snapshots(raw)


_SNAP = "SELECT o_orderkey AS snapshot_id, o_orderpriority AS segment, o_orderstatus AS channel, 'orders' AS source, CAST(o_custkey % 10 AS VARCHAR) AS profile, strftime(o_orderdate, '%Y-%m-%d') AS captured_at, strftime(o_orderdate, '%Y-%m') AS month, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS source_url, CASE o_orderstatus WHEN 'F' THEN 'Documented' ELSE 'Measured' END AS tag, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 2 ELSE 1 END AS precedence, " + ", ".join(f"round(CASE WHEN o_orderkey % {k} <> 0 THEN CAST({e} AS DOUBLE) END, 2) AS {m}" for m, (e, k) in MEASURES.items()) + " FROM orders"


def _latest_sql(keys: str, cols: str, where: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY captured_at DESC, precedence, source_url) AS rn FROM ({_SNAP}) WHERE {where}) WHERE rn = 1"


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return K.classify(table(spark, sf, "documents").select("doc_id", "text"), RULES)


_FOLD = "replace(strip_accents(lower(text)), 'ß', 'ss')"
_HITS = ", ".join(f"({' OR '.join(f'''regexp_matches(f, '{chr(92)}b{p}')''' for p in ps)}) AS {label}" for label, ps in RULES.items())
_THEMES = [label for label in RULES if label != K.POSITIVE]
_CLASSIFIED = f"""(WITH h AS (SELECT doc_id, {_HITS} FROM (SELECT doc_id, {_FOLD} AS f FROM documents))
{" UNION ALL ".join(f"SELECT doc_id, '{t}' AS theme FROM h WHERE {t}" for t in _THEMES)}
UNION ALL SELECT doc_id, CASE WHEN positive THEN 'positive' ELSE 'unclassified' END FROM h WHERE NOT ({" OR ".join(_THEMES)}))"""


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Classified documents with language and the month of the order of the same number."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("segment"), "source")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    found = K.classified_once(table(spark, sf, "documents").select("doc_id", "text"), RULES)
    return found.join(d, "doc_id").join(o, "doc_id")


_DATED = f"(SELECT c.doc_id, c.theme, d.lang AS segment, d.source, strftime(o.o_orderdate, '%Y-%m') AS month FROM {_CLASSIFIED} c JOIN documents d USING (doc_id) JOIN orders o ON o.o_orderkey = c.doc_id)"


def _share_sql(groups: str) -> str:
    on = " AND ".join(f"r.{g.strip()} = t.{g.strip()}" for g in groups.split(","))
    cols = ", ".join(f"r.{g.strip()}" for g in groups.split(","))
    return f"WITH c AS (SELECT * FROM {_DATED}), t AS (SELECT {groups}, count(DISTINCT doc_id) AS reviews FROM c GROUP BY ALL), r AS (SELECT {groups}, theme AS label, count(*) AS label_rows FROM c GROUP BY ALL) SELECT {cols}, label, round(CAST(label_rows AS DOUBLE) / reviews, 6) AS share, label_rows, reviews FROM r JOIN t ON {on}"


# --- latest-by ---------------------------------------------------------------


def latest_capture(spark, sf):
    e = table(spark, sf, "events").withColumn("content_hash", T.fingerprint(F.col("props")))
    return L.latest_by(e, ["event_type", "user_id"], [F.desc("ts"), F.desc("content_hash")]).select("event_type", "user_id", "event_id", "content_hash")


def content_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("content_hash"))


def _batches(spark, sf):
    """Events as two loads; the second repeats half of the first, and each repeats rows inside."""
    e = table(spark, sf, "events").select("event_type", "user_id", F.expr("event_id DIV 3").alias("external_id"), F.col("event_id").alias("ordinal"))
    return e.where("ordinal % 2 = 0"), e


def idempotent_append(spark, sf):
    keys = ["event_type", "user_id", "external_id"]
    first, second = _batches(spark, sf)
    stored = load.new_rows(first, keys, "ordinal")
    return stored.union(load.new_rows(second, keys, "ordinal", stored)).select(*keys, F.col("ordinal").alias("first_ordinal"))


def fingerprint_conflicts(spark, sf):
    o = table(spark, sf, "orders").withColumn("content_hash", T.fingerprint(F.col("o_orderstatus"), F.col("o_orderpriority")))
    return load.conflicts(o.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "content_hash"), ["o_custkey", "month"], "content_hash")


def declared_pages(spark, sf):
    return files.declared_pages(spark.createDataFrame(SOURCES, "source string, pages array<string>"))


def snapshot_staging(spark, sf):
    return snapshots(spark, sf).select("snapshot_id", "segment", "channel", "captured_at", "month", "tag", "precedence", *MEASURES)


def rating_trend(spark, sf):
    return L.rating_trend(snapshots(spark, sf))


def channel_gap(spark, sf):
    return L.channel_gap(snapshots(spark, sf))


def peer_ratings(spark, sf):
    return L.peer_ratings(snapshots(spark, sf), "O")


def platform_stats(spark, sf):
    return L.platform_stats(snapshots(spark, sf), list(MEASURES)).withColumn("value", F.col("value").cast("double"))


# --- classifier ----------------------------------------------------------------


def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("f")).select("doc_id", F.md5("f").alias("folded_md5"), F.char_length("f").cast("long").alias("folded_chars"))


def classify_rules(spark, sf):
    return classified(spark, sf)


def unresolved_ids(spark, sf):
    return K.unresolved(classified(spark, sf))


def merge_decisions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("v1").alias("prompt_version"), F.lit("m").alias("model"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'delay' ELSE 'refund' END").alias("theme"))
    return K.decided(docs, RULES, cache, "v1", "m")


def theme_share_by_month(spark, sf):
    return K.theme_share(dated(spark, sf), ["month", "segment"])


def theme_share_by_segment(spark, sf):
    return K.theme_share(dated(spark, sf), ["segment"])


def review_drill(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return classified(spark, sf).join(d, "doc_id").select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("review_id"), "source", F.col("lang").alias("segment"), "theme")


def fold_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.review_fold(F.col("doc_id").cast("string")).alias("fold"))


def label_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return d.orderBy("h").limit(50)


def _gold(spark, sf):
    x = table(spark, sf, "labels")
    fold = T.review_fold(F.col("doc_id").cast("string"))
    gold = x.select("doc_id", fold.alias("fold"), F.when(F.col("toxic") == 1, "refund").when(F.col("quality") == 1, "contact").otherwise(K.UNCLASSIFIED).alias("theme"))
    return gold, classified(spark, sf).withColumn("fold", T.review_fold(F.col("doc_id").cast("string")))


def _graded(spark, sf, held: bool):
    gold, found = _gold(spark, sf)
    keep = (F.col("fold") == 4) if held else (F.col("fold") != 4)
    return K.grades(found.where(keep), gold.where(keep), LABELS, ["doc_id"])


def tuning_precision(spark, sf):
    return _graded(spark, sf, False).select("label", "predicted", "correct", "precision")


def heldout_quality(spark, sf):
    return _graded(spark, sf, True)


def stage_counts(spark, sf):
    parts = {"raw": table(spark, sf, "events"), "staged": latest_capture(spark, sf), "classified": classified(spark, sf)}
    out = None
    for stage, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = one if out is None else out.union(one)
    return out


def reviews_per_month(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("reviews"))


# --- fit -----------------------------------------------------------------------


def lognormal_fit(spark, sf):
    return fitting.lognormal_fit(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice")


def fit_deciles(spark, sf):
    return fitting.fit_deciles(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice")


def systematic_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return fitting.systematic_sample(e, F.col("event_type") != "error", "event_id", 200)


def fee_split(spark, sf):
    x = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_tax")).alias("extra"))
    return fitting.fee_split(x, "l_returnflag", "l_extendedprice", "extra").withColumn("extra", F.round("extra", 0)).withColumn("tariff", F.round("tariff", 0))


# --- model ---------------------------------------------------------------------


def cost_params(spark, sf):
    return M.cost_params(spark)


def cost_outputs(spark, sf):
    return M.cost_outputs(spark)


def cost_curves(spark, sf):
    return M.cost_curves(spark)


def cost_crossovers(spark, sf):
    return M.crossovers(spark)


def synthetic_claims(spark, sf):
    return M.synthetic_claims(spark)


def guardrail_sim(spark, sf):
    return M.guardrail_sim(spark)


def sla_threshold(spark, sf):
    return M.sla_threshold(spark)


def hold_summary(spark, sf):
    return M.hold_summary(M.guardrail_sim(spark))


# --- readers -------------------------------------------------------------------


def validate_amounts(spark, sf):
    """Prices as text, some misspelled, through the amount rule."""
    p = table(spark, sf, "part").select("p_partkey", F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('-', p_size) WHEN 1 THEN concat(p_size, ',5') WHEN 2 THEN concat(p_size, '.25') WHEN 3 THEN concat(p_size, 'e3') ELSE cast(p_size AS string) END").alias("spelled"))
    return p.select("p_partkey", T.amount(F.col("spelled")).alias("amount"))


def json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", F.col("p.k").alias("k"))


def page_parse(spark, sf):
    return html_pages.page_titles(table(spark, sf, "pages"))


def robots_allows(spark, sf):
    return html_pages.allowed_pages(table(spark, sf, "pages").select("page_id", "url"), ROBOTS, "provmart")


# --- serving -------------------------------------------------------------------


def panel_trend(spark, sf):
    return rating_trend(spark, sf).where("channel = 'O' AND segment = '1-URGENT'").select("source", "profile", "month", "rating").orderBy("month", "profile")


def panel_gap(spark, sf):
    return channel_gap(spark, sf).where("profile = '0'").select("segment", "channel", "rating").orderBy("segment", "channel")


def panel_themes(spark, sf):
    return theme_share_by_month(spark, sf).where("label <> 'positive' AND segment = 'en'").select("month", "label", "share")


def panel_unclassified(spark, sf):
    return theme_share_by_segment(spark, sf).agg(F.sum(F.when(F.col("label") == K.UNCLASSIFIED, F.col("label_rows"))).alias("unclassified_rows"))


def panel_holds(spark, sf):
    return hold_summary(spark, sf)


def question_themes(spark, sf):
    return classified(spark, sf).groupBy("theme").agg(F.count("*").alias("theme_rows")).orderBy(F.desc("theme_rows"), "theme")


def reviews_latest_window(spark, sf):
    """The previous event of every user: the lag shape of the crossover rule."""
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


_ALL = (latest_capture, content_fingerprint, idempotent_append, fingerprint_conflicts, declared_pages, snapshot_staging, rating_trend, channel_gap, peer_ratings, platform_stats, fold_text, classify_rules, unresolved_ids, merge_decisions, theme_share_by_month, theme_share_by_segment, review_drill, fold_split, label_sample, tuning_precision, heldout_quality, stage_counts, reviews_per_month, lognormal_fit, fit_deciles, systematic_sample, fee_split, cost_params, cost_outputs, cost_curves, cost_crossovers, synthetic_claims, guardrail_sim, sla_threshold, hold_summary, validate_amounts, json_props, page_parse, robots_allows, panel_trend, panel_gap, panel_themes, panel_unclassified, panel_holds, question_themes, reviews_latest_window)
QUERIES = {f.__name__: f for f in _ALL}


# --- SQL -----------------------------------------------------------------------

_LATEST_EVENT = "(SELECT event_type, user_id, event_id, sha256(props) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, sha256(props) DESC) AS rn FROM events) WHERE rn = 1)"
_HEXSUM = "CAST(list_sum(list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256(CAST(doc_id AS VARCHAR)), i, 1)) - 1)) % 5 AS INT)"
_OPEN = f"(SELECT doc_id FROM {_CLASSIFIED} GROUP BY doc_id HAVING min(theme) = 'unclassified' AND max(theme) = 'unclassified')"


def _grade_sql(cond: str, cols: str) -> str:
    labels = ", ".join(f"('{x}')" for x in LABELS)
    return f"""WITH p AS (SELECT doc_id, theme FROM {_CLASSIFIED} WHERE {_HEXSUM} {cond}),
g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'refund' WHEN quality = 1 THEN 'contact' ELSE 'unclassified' END AS theme FROM labels WHERE {_HEXSUM} {cond}),
b AS (SELECT DISTINCT doc_id FROM p SEMI JOIN g USING (doc_id)),
pp AS (SELECT DISTINCT doc_id, theme FROM p SEMI JOIN b USING (doc_id)), gg AS (SELECT DISTINCT doc_id, theme FROM g SEMI JOIN b USING (doc_id)),
n AS (SELECT label, (SELECT count(*) FROM pp WHERE theme = label) AS predicted, (SELECT count(*) FROM gg WHERE theme = label) AS actual, (SELECT count(*) FROM pp JOIN gg USING (doc_id, theme) WHERE theme = label) AS correct FROM (VALUES {labels}) v(label))
SELECT {cols} FROM (SELECT *, CASE WHEN predicted > 0 THEN round(CAST(correct AS DOUBLE) / predicted, 6) END AS precision, CASE WHEN actual > 0 THEN round(CAST(correct AS DOUBLE) / actual, 6) END AS recall FROM n)"""


def _model_sql(rows: str, extra: str = "") -> str:
    """All formulas over rows that hold scenario and parameters, each as a nested select."""
    sql = rows
    for name, formula, _ in M.FORMULAS:
        sql = f"SELECT *, {formula} AS {name} FROM ({sql})"
    return sql


_PARAM = {r[0]: r[1] for r in M.parameters()}
_BASE = "SELECT scenario, " + ", ".join(
    f"CASE WHEN scenario IN ('contacts_once', 'both') THEN 1.0::DOUBLE ELSE {v!r}::DOUBLE END AS {n}" if n == "contacts" else f"CASE WHEN scenario IN ('churn_halved', 'both') THEN {v / 2!r}::DOUBLE ELSE {v!r}::DOUBLE END AS {n}" if n == "churn_prob" else f"{v!r}::DOUBLE AS {n}" for n, v in _PARAM.items()
) + " FROM (VALUES ('baseline'), ('contacts_once'), ('churn_halved'), ('both')) s(scenario)"
_ROUND = {"eur": "round({}, 2)", "count": "round_even({}, 0)", "days": "round({}, 2)"}
_CURVES = "(SELECT scenario, flag_rate, round(fraud_saved, 2) AS fraud_saved, round(friction_cost, 2) AS friction_cost, round(net, 2) AS net, is_default FROM (" + _model_sql(f"SELECT * REPLACE (round(i * 0.005, 6)::DOUBLE AS flag_rate), abs(round(i * 0.005, 6) - flag_rate) < 1e-9 AS is_default FROM ({_BASE}), range(41) r(i)") + "))"
_CROSS = f"(SELECT scenario, min(CASE WHEN net < 0 THEN flag_rate END) AS crossover_flag_rate, min(CASE WHEN net < before THEN flag_rate END) AS marginal_crossover_flag_rate FROM (SELECT *, lag(net) OVER (PARTITION BY scenario ORDER BY flag_rate) AS before FROM {_CURVES}) GROUP BY scenario)"
_POINTS = f"({_model_sql(_BASE)})"
_CLAIMS = "(SELECT claim_rank, round((claim_rank - 0.5) / 1000, 6)::DOUBLE AS quantile, round(exp(3.809814 + 2.187981 * z), 2) AS amount_eur FROM (VALUES " + ", ".join(f"({k}, {fitting.z((k - 0.5) / 1000)!r}::DOUBLE)" for k in range(1, 1001)) + ") v(claim_rank, z))"
_SIM = f"""(WITH t AS (SELECT round(timer_amount_eur, 2) AS threshold, CAST(timer_days AS INT) AS timer, CAST(round(loop_days, 2) AS INT) AS loop FROM {_POINTS} WHERE scenario = 'baseline'),
o AS (SELECT CAST(round(loop_days, 2) AS INT) AS once FROM {_POINTS} WHERE scenario = 'contacts_once'),
s AS (SELECT scenario, curves_scenario, timer_on, CASE WHEN once_on THEN once ELSE loop END AS loop_days, timer, threshold FROM (VALUES ('no_fix', 'baseline', false, false), ('ask_once', 'contacts_once', true, false), ('hold_timer', 'churn_halved', false, true), ('both_fixes', 'both', true, true)) v(scenario, curves_scenario, once_on, timer_on), t, o)
SELECT scenario, curves_scenario, claim_rank, quantile, amount_eur, loop_days, CASE WHEN timer_on AND loop_days > timer AND amount_eur < threshold THEN timer ELSE loop_days END AS hold_days, CASE WHEN NOT timer_on OR loop_days <= timer THEN 'loop_released' WHEN amount_eur < threshold THEN 'timer_released' ELSE 'timer_escalated' END AS outcome FROM {_CLAIMS}, s)"""
_HOLDS = f"SELECT scenario, round(avg(hold_days), 2) AS mean_hold_days, round(avg(CASE WHEN outcome = 'timer_released' THEN 1.0 ELSE 0.0 END), 6) AS released_share, CAST(sum(CASE WHEN outcome = 'timer_released' THEN 1 ELSE 0 END) AS BIGINT) AS released, count(*) AS claims FROM {_SIM} GROUP BY scenario"

SQL = {
    "latest_capture": f"SELECT * FROM {_LATEST_EVENT}",
    "content_fingerprint": "SELECT doc_id, sha256(concat_ws(chr(31), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS content_hash FROM documents",
    "idempotent_append": "WITH e AS (SELECT event_type, user_id, event_id // 3 AS external_id, event_id AS ordinal FROM events), a AS (SELECT event_type, user_id, external_id, min(ordinal) AS m FROM e WHERE ordinal % 2 = 0 GROUP BY ALL), b AS (SELECT event_type, user_id, external_id, min(ordinal) AS m FROM e GROUP BY ALL) SELECT event_type, user_id, external_id, coalesce(a.m, b.m) AS first_ordinal FROM b LEFT JOIN a USING (event_type, user_id, external_id)",
    "fingerprint_conflicts": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderstatus || chr(31) || o_orderpriority) AS versions FROM orders GROUP BY ALL HAVING versions > 1",
    "declared_pages": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {i}, '{u}')" for s, us in SOURCES for i, u in enumerate(us, 1)) + ") v(source, page, source_url)",
    "snapshot_staging": f"SELECT snapshot_id, segment, channel, captured_at, month, tag, precedence, {', '.join(MEASURES)} FROM ({_SNAP})",
    "rating_trend": _latest_sql("channel, segment, source, profile, month", "channel, segment, source, profile, month, rating, tag", "rating IS NOT NULL"),
    "channel_gap": _latest_sql("segment, channel, source, profile", "segment, channel, source, profile, rating, captured_at, tag", "rating IS NOT NULL"),
    "peer_ratings": _latest_sql("segment, source, profile", "segment, source, profile, rating, captured_at, tag", "rating IS NOT NULL AND channel = 'O'"),
    "platform_stats": "SELECT segment, source, profile, stat, CAST(value AS DOUBLE) AS value, captured_at, tag FROM (SELECT *, row_number() OVER (PARTITION BY segment, source, profile, stat ORDER BY captured_at DESC, precedence, source_url) AS rn FROM (" + " UNION ALL ".join(f"SELECT segment, source, profile, '{m}' AS stat, CAST({m} AS DECIMAL(12,3)) AS value, captured_at, precedence, source_url, tag FROM ({_SNAP}) WHERE {m} IS NOT NULL" for m in MEASURES) + ")) WHERE rn = 1",
    "fold_text": f"SELECT doc_id, md5(f) AS folded_md5, length(f) AS folded_chars FROM (SELECT doc_id, {_FOLD} AS f FROM documents)",
    "classify_rules": f"SELECT * FROM {_CLASSIFIED}",
    "unresolved_ids": f"SELECT * FROM {_OPEN}",
    "merge_decisions": f"WITH c AS (SELECT * FROM {_CLASSIFIED}), o AS (SELECT * FROM {_OPEN}) SELECT * FROM c ANTI JOIN o USING (doc_id) UNION SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'unclassified' WHEN doc_id % 3 = 0 THEN 'delay' ELSE 'refund' END FROM o",
    "theme_share_by_month": _share_sql("month, segment"),
    "theme_share_by_segment": _share_sql("segment"),
    "review_drill": f"SELECT d.source || ':' || CAST(doc_id AS VARCHAR) AS review_id, d.source, d.lang AS segment, theme FROM {_CLASSIFIED} c JOIN documents d USING (doc_id)",
    "fold_split": f"SELECT doc_id, {_HEXSUM} AS fold FROM documents",
    "label_sample": "SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h LIMIT 50",
    "tuning_precision": _grade_sql("<> 4", "label, predicted, correct, precision"),
    "heldout_quality": _grade_sql("= 4", "*"),
    "stage_counts": f"SELECT 'raw' AS stage, count(*) AS n FROM events UNION ALL SELECT 'staged', count(*) FROM {_LATEST_EVENT} UNION ALL SELECT 'classified', count(*) FROM {_CLASSIFIED}",
    "reviews_per_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS reviews FROM orders GROUP BY ALL",
    "lognormal_fit": "SELECT round(avg(ln(l_extendedprice)), 6) AS mu, round(stddev_pop(ln(l_extendedprice)), 6) AS sigma, count(*) AS n, round(avg(l_extendedprice), 6) AS emp_mean FROM lineitem WHERE l_extendedprice > 0",
    "fit_deciles": "WITH f AS (SELECT avg(ln(l_extendedprice)) AS mu, stddev_pop(ln(l_extendedprice)) AS sigma FROM lineitem WHERE l_extendedprice > 0) " + " UNION ALL ".join(f"SELECT {round(p * 100)} AS pct, round((SELECT quantile_cont(l_extendedprice, {p}) FROM lineitem WHERE l_extendedprice > 0), 4) AS emp, round(exp(mu + sigma * {fitting.z(p)!r}::DOUBLE), 4) AS fit FROM f" for p in fitting.DECILES),
    "systematic_sample": "WITH v AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS k FROM events WHERE event_type <> 'error') SELECT event_id, event_type, value FROM v WHERE rn % greatest(1, k // 200) = 0 AND rn // greatest(1, k // 200) < 200",
    "fee_split": "SELECT coalesce(l_returnflag, 'overall') AS family, round(sum(l_extendedprice * l_tax), 0) AS extra, round(sum(l_extendedprice), 0) AS tariff, round(sum(l_extendedprice * l_tax) / (sum(l_extendedprice) + sum(l_extendedprice * l_tax)), 6) AS share FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())",
    "cost_params": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {d!r}::DOUBLE, '{u}', '{s}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, '{'Documented' if s == 'sourced' else 'Modeled'}')" for n, d, u, s, lo, hi in M.parameters()) + ") v(name, default_value, unit, sourcing, low, high, tag)",
    "cost_outputs": f"WITH p AS (SELECT * FROM {_POINTS}), c AS (SELECT * FROM {_CROSS}) " + " UNION ALL ".join([f"SELECT scenario, '{n}' AS name, {_ROUND[u].format(n)} AS value, '{u}' AS unit FROM p" for n, _, u in M.FORMULAS] + [f"SELECT scenario, '{n}', {n}, 'rate' FROM c" for n in ("crossover_flag_rate", "marginal_crossover_flag_rate")]),
    "cost_curves": f"SELECT * FROM {_CURVES}",
    "cost_crossovers": f"SELECT * FROM {_CROSS}",
    "synthetic_claims": f"SELECT * FROM {_CLAIMS}",
    "guardrail_sim": f"SELECT * FROM {_SIM}",
    "sla_threshold": "WITH a AS (SELECT day, is_default, round(timer_amount_eur, 2) AS t FROM (" + _model_sql(f"SELECT * REPLACE (d::DOUBLE AS timer_days), CAST(d AS INT) AS day, d = timer_days AS is_default FROM ({_BASE}), range(1, 61) r(d) WHERE scenario = 'baseline'") + f")) SELECT day AS timer_days, t AS timer_amount_eur, round(avg(CASE WHEN amount_eur < t THEN 1.0 ELSE 0.0 END), 6) AS share_under, is_default FROM a, {_CLAIMS} GROUP BY ALL",
    "hold_summary": _HOLDS,
    "validate_amounts": "SELECT p_partkey, CASE WHEN regexp_full_match(s, '-?[0-9]+([.,][0-9]+)?') AND CAST(replace(s, ',', '.') AS DOUBLE) > 0 THEN CAST(replace(s, ',', '.') AS DOUBLE) END AS amount FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '-' || p_size WHEN 1 THEN p_size || ',5' WHEN 2 THEN p_size || '.25' WHEN 3 THEN p_size || 'e3' ELSE CAST(p_size AS VARCHAR) END AS s FROM part)",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "page_parse": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages",
    "panel_trend": "SELECT source, profile, month, rating FROM (" + _latest_sql("channel, segment, source, profile, month", "channel, segment, source, profile, month, rating, tag", "rating IS NOT NULL") + ") WHERE channel = 'O' AND segment = '1-URGENT'",
    "panel_gap": "SELECT segment, channel, rating FROM (" + _latest_sql("segment, channel, source, profile", "segment, channel, source, profile, rating", "rating IS NOT NULL") + ") WHERE profile = '0'",
    "panel_themes": f"SELECT month, label, share FROM ({_share_sql('month, segment')}) WHERE label <> 'positive' AND segment = 'en'",
    "panel_unclassified": f"SELECT CAST(sum(CASE WHEN label = 'unclassified' THEN label_rows END) AS BIGINT) AS unclassified_rows FROM ({_share_sql('segment')})",
    "panel_holds": _HOLDS,
    "question_themes": f"SELECT theme, count(*) AS theme_rows FROM {_CLASSIFIED} GROUP BY theme ORDER BY theme_rows DESC, theme",
    "reviews_latest_window": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS change FROM events",
}
