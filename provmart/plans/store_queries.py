"""Queries over stores, strict readers and parsers: data that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import fit as fitting
from ..operators import work
from ..operators.commits import Store
from ..operators.load import Refused
from ..sources import files, html_pages, records
from . import cost_model as M
from . import registry as R
from . import serve


def strict_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as CSV, texts with quotes and line ends included, and read back by the strict reader."""
    path = work.new_path(spark, "csv")
    docs = R.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)

    def shape(rows: DataFrame) -> tuple[DataFrame, list[records.Rule]]:
        return rows.withColumn("id", F.col("doc_id").try_cast("bigint")), [("doc_id is no number", F.col("doc_id").try_cast("bigint").isNull(), ("doc_id",))]

    rows = records.read(spark, path, ("doc_id", "lang", "source", "text"), shape)
    return rows.select(F.col("id").alias("doc_id"), "lang", "source", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("chars"))


def batch_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Events as three batches of two tables; the third changes a stored fingerprint, is refused, and leaves no trace."""
    store = Store(spark, work.new_path(spark, "store"))
    keys = ["event_type", "user_id", "external_id"]
    first, second = (b.withColumn("first_ordinal", F.col("ordinal")) for b in R._batches(spark, sf))
    for rows in (first, second):
        with store.batch() as b:
            b.append("raw_events", rows, keys, "ordinal")
            b.append("raw_types", rows.groupBy("event_type").agg(F.min("ordinal").alias("ordinal")).withColumn("seen", F.lit("x")), ["event_type"], "ordinal", "seen")
    try:
        with store.batch() as b:
            b.append("raw_events", first.withColumn("user_id", -F.col("user_id") - 1), keys, "ordinal")
            b.append("raw_types", first.groupBy("event_type").agg(F.min("ordinal").alias("ordinal")).withColumn("seen", F.lit("y")), ["event_type"], "ordinal", "seen")
    except Refused:
        pass
    return store.read("raw_events").join(store.read("raw_types"), "event_type").select(*keys, "first_ordinal", "seen")


def latest_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every type and user, kept up to date by three batches, the second of which comes twice."""
    store = Store(spark, work.new_path(spark, "store"))
    e = R.table(spark, sf, "events").select("event_type", "user_id", "event_id", "ts", T.fingerprint(F.col("props")).alias("content_hash"))
    for epoch, k in enumerate((2, 0, 0, 1)):
        with store.batch("events", epoch) as b:
            b.keep_latest("latest", e.where(F.col("event_id") % 3 == k), ["event_type", "user_id"], [F.desc("ts"), F.desc("content_hash"), F.desc("event_id")], 16)
    return store.read("latest").select("event_type", "user_id", "event_id", "content_hash")


def amounts_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Line prices as amount files, half of them gzip, each under the other kind's name; told apart by their first bytes."""
    path = work.new_path(spark, "amounts")
    rows = R.table(spark, sf, "lineitem").select(F.format_string("%.2f", "l_extendedprice").alias("PRS_REM_MNT"), (F.col("l_linenumber") % 3).cast("string").alias("PRS_REM_TYP"), "l_orderkey")
    for k, packed in enumerate(("none", "gzip")):
        rows.where(F.col("l_orderkey") % 2 == k).drop("l_orderkey").write.options(header=True, sep=";", compression=packed).csv(f"{path}/{packed}")
        where, system = files._hadoop(spark, f"{path}/{packed}")
        for f in system.listStatus(where):  # as many files as tasks wrote
            name = f.getPath().getName()
            if name.startswith("part-"):
                system.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(where, name.removesuffix(".gz") if packed == "gzip" else name + ".gz"))
    found = files.read_amounts(spark, path)
    return found.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.min("amount").alias("least"), F.max("amount").alias("most"))


ROBOTS = (
    "User-agent: *\nDisallow: /*?\nAllow: /en/*page=2\nDisallow: /de/\n",
    "User-agent: *\nDisallow: /en/\nUser-agent: other\nSitemap: https://x.example/map\nUser-agent: *\nDisallow: /fr/1\n\nUser-agent: provmart\nDisallow: /es/\nAllow: /es/2\n",
    "# nothing is closed\nUser-agent: *\nDisallow:\n",
)


def robots_by_host(spark: SparkSession, sf: str) -> DataFrame:
    """Every page under the robots text of its host; hosts have one of three texts by the length of their name, those of four others none."""
    pages = R.table(spark, sf, "pages").select("page_id", "url")
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).distinct().where("length(host) % 4 < 3")
    text = F.element_at(F.array(*[F.lit(t) for t in ROBOTS]), (F.length("host") % 4 + 1).cast("int"))
    return html_pages.allowed_by_host(pages, html_pages.robots_rules(hosts.select("host", text.alias("text")), "provmart/1.0"))


def parsed_captures(spark: SparkSession, sf: str) -> DataFrame:
    """A captured page for every order, of one of three parsers, joined laterally to its rows; some are outside their shape."""
    o = R.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_custkey") % 9 + 2).alias("half"), F.col("o_custkey").alias("n"))
    star = F.when(F.col("half") % 2 == 0, (F.col("half") / 2).cast("int").cast("string")).otherwise(F.format_string("%.1f", F.col("half") / 2))
    listing = F.format_string('<title>t</title><script type="application/ld+json">{"@graph":[{"aggregateRating":{"ratingValue":%s,"ratingCount":%s}}]}</script>', star, F.when(F.col("n") % 7 == 0, "true").otherwise(F.col("n").cast("string")))
    micro = F.format_string('<div itemscope itemtype="https://schema.org/Review"><b itemprop=author itemscope><i itemprop=reviewBody>no</i></b><p itemprop=reviewBody>order %s</p><i itemprop=datePublished>%s</i><u itemprop=reviewRating itemscope itemtype="x/Rating"><meta itemprop=ratingValue content="%s"></u></div>', F.col("o_orderkey"), F.concat_ws("/", F.substring("day", 9, 2), F.substring("day", 6, 2), F.substring("day", 1, 4)), star)
    feed = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("label")).alias("id"), F.struct(F.lit("t").alias("label")).alias("title"), F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label")).alias("content"), F.struct(star.alias("label")).alias("im:rating"), F.struct(F.concat(F.col("day"), F.lit("T23:59:59-07:00")).alias("label")).alias("updated"))).alias("entry")).alias("feed")))
    kind = F.element_at(F.array(*[F.lit(p) for p in ("jsonld", "microdata", "feed")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    pages = o.select("o_orderkey", kind.alias("parser"), F.when(F.col("o_orderkey") % 3 == 0, listing).when(F.col("o_orderkey") % 3 == 1, micro).otherwise(feed).alias("body"))
    rows = html_pages.parsed(pages)
    return rows.select("o_orderkey", "parser", "kind", "review_date", F.col("review_rating").cast("double").alias("review_rating"), F.col("rating").cast("double").alias("rating"), "review_count", F.col("body").alias("review_body"))


def _by_length(ids: list, texts: list[str]) -> list[list[str] | None]:
    return [["delay"] if len(t) % 3 == 0 else ["refund", "no label"] if len(t) % 3 == 1 else None for t in texts]


def decision_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What a decider said of the documents that no rule decides, after two runs; the second finds all of them in the cache."""
    store = Store(spark, work.new_path(spark, "store"))
    docs = R.table(spark, sf, "documents").select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, prompt_version string, model string, theme string")
    for _ in range(2):
        with store.batch() as b:
            cache = b.read("decisions")
            answers = K.answered(docs, R.RULES, none if cache is None else cache, "v1", "m", _by_length, R.LABELS)
            b.append("decisions", answers.withColumn("ordinal", F.col("theme")), ["doc_id", "prompt_version", "model", "theme"], "ordinal")
    return store.read("decisions")


def sample_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every k-th customer in the order of a text key, a seventh of which is null and comes first."""
    c = R.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.reverse("c_name")).alias("key"))
    return fitting.systematic_sample(c, F.lit(True), "key", 100).where("key IS NOT NULL").select("c_custkey", "key")


def _fitted(spark: SparkSession, sf: str) -> list[tuple]:
    """The model's parameters with the fit and the fee split of the line items instead of the declared ones."""
    x = R.table(spark, sf, "lineitem").select("l_extendedprice", "l_returnflag", "l_tax")
    fit = fitting.lognormal_fit(x, "l_extendedprice").first().asDict()
    middle = {d.pct: d.emp for d in fitting.fit_deciles(x, "l_extendedprice").collect()}[50]  # nine rows
    split = {r.family: r.share for r in fitting.fee_split(x.withColumn("extra", F.col("l_extendedprice") * F.col("l_tax")), "l_returnflag", "l_extendedprice", "extra").collect()}
    shares = [v for k, v in split.items() if k != "overall"]
    return M.parameters(fit | {"emp_p50": middle}, (split["overall"], min(shares), max(shares)))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("amount_eur"))


def fitted_params(spark: SparkSession, sf: str) -> DataFrame:
    """The 17 parameters, nine of them from the line items."""
    return M.cost_params(spark, _fitted(spark, sf)).select("name", "default_value", "sourcing", "low", "high", "tag")


def fitted_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """All outputs and crossovers of the four scenarios under these parameters; sums of money to the euro."""
    out = M.cost_outputs(spark, _fitted(spark, sf))
    return out.select("scenario", "name", F.round("value", 2).alias("value"))


def fitted_holds(spark: SparkSession, sf: str) -> DataFrame:
    """How long every line item, taken as a claim in thousands, is held under each scenario."""
    return M.holds_of(_claims(spark, sf), _fitted(spark, sf))


def fitted_sla(spark: SparkSession, sf: str) -> DataFrame:
    """The share of line items under the threshold of every timer."""
    return M.sla_of(_claims(spark, sf), _fitted(spark, sf))


def corpus_gates(spark: SparkSession, sf: str) -> DataFrame:
    """What the gate says of the orders of every month, whose status is the run they are of."""
    rows = R.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("run_id"))
    return serve.gate_states(rows, {"F": "counted", "O": "fixture"}, ["month"])


_ALL = (strict_rows, batch_commit, latest_kept, amounts_by_content, robots_by_host, parsed_captures, decision_cache, sample_by_text, fitted_params, fitted_outputs, fitted_holds, fitted_sla, corpus_gates)
QUERIES = {f.__name__: f for f in _ALL}

_PATH = r"regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '^([^/]|$)', '/\1'), '[?]$', '')"
_FIT = """(SELECT round(avg(ln(l_extendedprice)), 6) AS mu, round(stddev_pop(ln(l_extendedprice)), 6) AS sigma, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 2) AS emp_p50, round(avg(l_extendedprice), 2) AS emp_mean FROM lineitem WHERE l_extendedprice > 0)"""
_FEES = "(SELECT max(CASE WHEN g = 1 THEN s END) AS share, min(CASE WHEN g = 0 THEN s END) AS low, max(CASE WHEN g = 0 THEN s END) AS high FROM (SELECT grouping(l_returnflag) AS g, round(sum(l_extendedprice * l_tax) / (sum(l_extendedprice) + sum(l_extendedprice * l_tax)), 6) AS s FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())))"
_OWN = {"mu": "mu", "sigma": "sigma", "emp_p50": "emp_p50", "emp_mean": "emp_mean", "extra_billing_share": "share"}
_BASE = "SELECT scenario, " + ", ".join(
    f"CASE WHEN scenario IN ('contacts_once', 'both') THEN 1.0::DOUBLE ELSE {v!r}::DOUBLE END AS {n}" if n == "contacts" else f"CASE WHEN scenario IN ('churn_halved', 'both') THEN {v / 2!r}::DOUBLE ELSE {v!r}::DOUBLE END AS {n}" if n == "churn_prob" else f"{_OWN[n]}::DOUBLE AS {n}" if n in _OWN else f"{v!r}::DOUBLE AS {n}" for n, v in R._PARAM.items()
) + f" FROM (VALUES ('baseline'), ('contacts_once'), ('churn_halved'), ('both')) s(scenario), {_FIT}, {_FEES}"
_POINTS = f"({R._model_sql(_BASE)})"
_NETS = "(SELECT scenario, flag_rate, round(net, 2) AS net FROM (" + R._model_sql(f"SELECT * REPLACE (round(i * 0.005, 6)::DOUBLE AS flag_rate) FROM ({_BASE}), range(41) r(i)") + "))"
_CROSS = f"(SELECT scenario, min(CASE WHEN net < 0 THEN flag_rate END) AS crossover_flag_rate, min(CASE WHEN net < before THEN flag_rate END) AS marginal_crossover_flag_rate FROM (SELECT *, lag(net) OVER (PARTITION BY scenario ORDER BY flag_rate) AS before FROM {_NETS}) GROUP BY scenario)"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

SQL = {
    "strict_rows": "SELECT doc_id, lang, source, sha256(text) AS text_sha256, length(text) AS chars FROM documents",
    "batch_commit": "SELECT event_type, user_id, external_id, first_ordinal, 'x' AS seen FROM (" + R.SQL["idempotent_append"] + ")",
    "latest_kept": R.SQL["latest_capture"],
    "amounts_by_content": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE l_linenumber % 3 < 2 AND l_extendedprice > 0",
    "robots_by_host": f"""SELECT page_id, CASE length(host) % 4
      WHEN 0 THEN CASE WHEN regexp_matches(path, '^/en/.*page=2') THEN true ELSE NOT (regexp_matches(path, '^/.*[?]') OR path LIKE '/de/%') END
      WHEN 1 THEN NOT (path LIKE '/en/%' OR path LIKE '/fr/1%') AND (path LIKE '/es/2%' OR NOT path LIKE '/es/%')
      ELSE true END AS allowed
    FROM (SELECT page_id, {_PATH} AS path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)""",
    "parsed_captures": f"""SELECT o_orderkey, ['jsonld', 'microdata', 'feed'][o_orderkey % 3 + 1] AS parser,
      CASE WHEN o_orderkey % 3 > 0 THEN 'review' WHEN o_custkey % 7 = 0 THEN 'refused' ELSE 'snapshot' END AS kind,
      CASE WHEN o_orderkey % 3 > 0 THEN {_DAY} END AS review_date, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 9 + 2) / 2 END AS review_rating,
      CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 7 > 0 THEN (o_custkey % 9 + 2) / 2 END AS rating, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 7 > 0 THEN CAST(o_custkey AS INT) END AS review_count,
      CASE WHEN o_orderkey % 3 > 0 THEN 'order ' || o_orderkey END AS review_body FROM orders""",
    "decision_cache": f"SELECT doc_id, 'v1' AS prompt_version, 'm' AS model, ['delay', 'refund', 'unclassified'][length(text) % 3 + 1] AS theme FROM {R._CLASSIFIED} JOIN documents USING (doc_id) WHERE theme = 'unclassified'",
    "sample_by_text": "SELECT c_custkey, key FROM (SELECT *, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS rn, greatest(1, count(*) OVER () // 100) AS stride FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN reverse(c_name) END AS key FROM customer)) WHERE rn % stride = 0 AND rn // stride < 100 AND key IS NOT NULL",
    "fitted_params": f"""WITH f AS (SELECT *, sigma / sqrt(n) AS a, sigma / sqrt(2 * n) AS b FROM {_FIT}), x AS (SELECT * FROM {_FEES})
      SELECT 'mu' AS name, mu AS default_value, 'sourced' AS sourcing, round(mu - 2 * a, 6) AS low, round(mu + 2 * a, 6) AS high, 'Documented' AS tag FROM f
      UNION ALL SELECT 'sigma', sigma, 'sourced', round(sigma - 2 * b, 6), round(sigma + 2 * b, 6), 'Documented' FROM f
      UNION ALL SELECT 'emp_p50', emp_p50, 'sourced', emp_p50, emp_p50, 'Documented' FROM f UNION ALL SELECT 'emp_mean', emp_mean, 'sourced', emp_mean, emp_mean, 'Documented' FROM f
      UNION ALL SELECT 'extra_billing_share', share, 'sourced', low, high, 'Documented' FROM x UNION ALL SELECT * FROM (VALUES """
    + ", ".join(f"('{n}', {d!r}::DOUBLE, '{s}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, '{'Documented' if s == 'sourced' else 'Modeled'}')" for n, d, _, s, lo, hi in M.parameters() if n not in _OWN)
    + ") v",
    "fitted_outputs": f"WITH p AS (SELECT * FROM {_POINTS}), c AS (SELECT * FROM {_CROSS}) " + " UNION ALL ".join([f"SELECT scenario, '{n}' AS name, round({R._ROUND[u].format(n)}, 2) AS value FROM p" for n, _, u in M.FORMULAS] + [f"SELECT scenario, '{n}', round({n}, 2) FROM c" for n in ("crossover_flag_rate", "marginal_crossover_flag_rate")]),
    "fitted_holds": f"""WITH t AS (SELECT round(timer_amount_eur, 2) AS threshold, CAST(timer_days AS INT) AS timer, CAST(round(loop_days, 2) AS INT) AS loop FROM {_POINTS} WHERE scenario = 'baseline'),
      o AS (SELECT CAST(round(loop_days, 2) AS INT) AS once FROM {_POINTS} WHERE scenario = 'contacts_once'),
      s AS (SELECT scenario, timer_on, CASE WHEN once_on THEN once ELSE loop END AS loop_days, timer, threshold FROM (VALUES ('no_fix', false, false), ('ask_once', true, false), ('hold_timer', false, true), ('both_fixes', true, true)) v(scenario, once_on, timer_on), t, o),
      h AS (SELECT scenario, timer_on AND loop_days > timer AND l_extendedprice / 1000 < threshold AS released, loop_days, timer FROM lineitem, s)
      SELECT scenario, round(avg(CASE WHEN released THEN timer ELSE loop_days END), 2) AS mean_hold_days, round(avg(CASE WHEN released THEN 1.0 ELSE 0.0 END), 6) AS released_share, count(*) FILTER (released) AS released, count(*) AS claims FROM h GROUP BY scenario""",
    "fitted_sla": "WITH a AS (SELECT day, is_default, round(timer_amount_eur, 2) AS t FROM (" + R._model_sql(f"SELECT * REPLACE (d::DOUBLE AS timer_days), CAST(d AS INT) AS day, d = timer_days AS is_default FROM ({_BASE}), range(1, 61) r(d) WHERE scenario = 'baseline'") + ")) SELECT day AS timer_days, t AS timer_amount_eur, round(avg(CASE WHEN l_extendedprice / 1000 < t THEN 1.0 ELSE 0.0 END), 6) AS share_under, is_default FROM a, lineitem GROUP BY ALL",
    "corpus_gates": "SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'refused' WHEN min(o_orderstatus) = 'F' THEN 'counted' WHEN min(o_orderstatus) = 'O' THEN 'fixture' ELSE 'refused' END AS state, count(DISTINCT o_orderstatus) AS runs FROM orders GROUP BY month",
}
