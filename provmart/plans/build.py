"""Rebuild: project files to raw tables, staging and marts in a store of Parquet tables.

A project folder holds ``sources.json`` (source, platform, segment, channel, profile,
parser, fetchable, pages), ``reviews.csv``, ``rules.yaml`` and, where they exist,
``anchors.csv``, ``manual.csv``, ``fetched.csv``, ``decisions.csv``, ``labels.csv``, the
artifacts ``fit.csv`` and ``fees.csv`` with ``families.json``, and
``captures/<source>/<capture>/page-<n>.<ext>``.  Raw tables only grow; the others are replaced.  Every
stage is one commit: a refusal or a lost job leaves the store as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import latest as L
from ..operators import load, work
from ..operators.commits import Batch, Store
from ..sources import artifacts, files, html_pages
from . import cost_model as M
from . import panels as panels_of
from . import serve

LABELS = ("billing", "delay", "contact", "coverage", "refund", K.POSITIVE, K.UNCLASSIFIED)
SOURCE = "source string, platform string, segment string, channel string, profile string, parser string, fetchable boolean, pages array<string>"
PROMPT, MODEL = "v1", "none"
STAGES = ("load", "clean", "classify")
RAW = ("raw_reviews", "raw_platform_snapshots", "raw_source_pages")
SNAPSHOT = ("source", "profile", "origin", "source_url", "captured_at")


def sources(spark: SparkSession, project: str) -> DataFrame:
    given = json.loads(Path(project, "sources.json").read_text(encoding="utf-8"))
    names = [c.split()[0] for c in SOURCE.split(", ")]
    for s in given:
        if set(s) != set(names):
            raise load.Refused(f"sources.json: {sorted(s)}, declared {names}")
    return spark.createDataFrame([tuple(s[n] for n in names) for s in given], SOURCE)


def captured(spark: SparkSession, root: str, declared: DataFrame) -> DataFrame:
    """The rows of all pages under ``root``: pages meet the parser of their source in a lateral join; a refused page refuses all."""
    pages = files.read_captures(spark, root)
    known = declared.where("parser IS NOT NULL").select("source", "platform", "parser", "segment", "channel", "profile", "pages")
    rows = pages.join(work.sized(known, 4000), "source", "left")
    files.refuse_where(rows, F.col("parser").isNull() | ~F.array_contains("pages", F.col("source_url")), "not a declared page of a parsed source", "source", "source_url")
    out = work.stored(html_pages.parsed(rows.drop("pages")), "parsed")
    files.refuse_where(out, F.col("kind") == "refused", "a page outside its shape", "source", "capture", "page", "error")
    return out


def review_rows(rows: DataFrame) -> DataFrame:
    """Reviews of captured pages as the review files have them."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    found = rows.where("kind = 'review'").select("source", "external_id", "source_url", "captured_at", "review_date", F.col("review_rating").alias("rating"), text("title"), text("body"), "segment", F.struct("captured_at", "capture", "page", "external_id", "body").alias("ordinal"))
    return found.withColumn("content_hash", T.fingerprint(T.canonical(F.col("rating")), *[F.col(c) for c in ("review_date", "title", "body")]))


def snapshot_rows(rows: DataFrame) -> DataFrame:
    """One snapshot of each capture of a source: that of its first page that carries one."""
    found = rows.where("kind = 'snapshot'").withColumn("origin", F.lit("fetch"))
    return L.latest_by(found, ["source", "capture"], [F.asc("page")])


def _snapshots(b: Batch, rows: DataFrame, run_id: str) -> None:
    """Append snapshots; the hash holds what the key does not: the figures, the attribution and where they are from."""
    for name, kind in (("rating", "decimal(4,3)"), ("review_count", "int"), ("one_star_share", "decimal(4,3)"), ("response_rate", "decimal(4,3)"), ("response_delay_days", "decimal(5,1)"), ("seeded_from", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    hashed = T.fingerprint(*[T.canonical(F.col(m)) for m in files.MEASURES], *[F.col(c) for c in ("segment", "channel", "seeded_from")])
    rows = rows.select("segment", "channel", *SNAPSHOT, *files.MEASURES, F.coalesce("seeded_from", F.lit("")).alias("seeded_from"), hashed.alias("content_hash"), F.lit(run_id).alias("run_id"))
    b.append("raw_platform_snapshots", rows.withColumn("ordinal", F.struct("content_hash")), list(SNAPSHOT), "ordinal", "content_hash")


def _load(spark: SparkSession, project: str, store: Store, run_id: str) -> None:
    declared = sources(spark, project)
    run = F.lit(run_id).alias("run_id")
    with store.batch() as b:
        review = ["source", *files.REVIEWS[1:], "content_hash", "segment"]
        key = ["source", "external_id", "content_hash"]
        reviews = artifacts.with_segment(files.read_reviews(spark, f"{project}/reviews.csv"), declared)
        b.append("raw_reviews", reviews.select(*review, run, "ordinal"), key, "ordinal")
        known = declared.select("source", "segment", "channel", "profile", F.element_at("pages", 1).alias("first_page"))
        if files.present(spark, f"{project}/anchors.csv"):
            segments, channels = ([r[0] for r in declared.select(c).distinct().collect()] for c in ("segment", "channel"))
            _snapshots(b, files.read_anchors(spark, f"{project}/anchors.csv", segments, channels, published=True), run_id)
        for name, read in (("manual", files.read_manual), ("fetched", files.read_fetched)):
            path = f"{project}/{name}.csv"
            if files.present(spark, path):
                rows = read(spark, path, declared)
                address = F.coalesce("source_url", "first_page") if "source_url" in rows.columns else F.col("first_page")
                _snapshots(b, rows.join(work.sized(known, 1000), "source").withColumn("source_url", address), run_id)
        if files.present(spark, f"{project}/captures"):
            rows = captured(spark, f"{project}/captures", declared)
            b.append("raw_reviews", review_rows(rows).select(*review, run, "ordinal"), key, "ordinal")
            _snapshots(b, snapshot_rows(rows), run_id)
        pages = files.declared_pages(declared).join(known.drop("first_page"), "source")
        pages = pages.withColumn("content_hash", T.fingerprint(*[F.col(c) for c in ("profile", "segment", "channel")])).withColumn("run_id", F.lit(run_id))
        b.append("raw_source_pages", pages.withColumn("ordinal", F.col("page")), ["source", "source_url"], "ordinal", "content_hash")


def _clean(spark: SparkSession, store: Store) -> None:
    with store.batch() as b:
        b.replace("stg_reviews", L.stage_reviews(store.read("raw_reviews")))
        raw = b.read("raw_platform_snapshots")
        if raw is None:
            return
        b.replace("stg_platform_snapshots", L.stage_snapshots(raw))
        staged = b.read("stg_platform_snapshots")
        marts = {"rating_trend": L.rating_trend(staged), "channel_gap": L.channel_gap(staged), "platform_stats": L.platform_stats(staged, list(files.MEASURES)), "peer_ratings": L.peer_ratings(staged, files.CHANNELS[0])}
        for name, df in marts.items():
            b.replace(name, df)


def quality(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Held-out precision and recall of every label; no row if nothing was predicted or is in the key."""
    held = T.review_fold(F.col("review_id")) == 4
    rows = K.grades(found.where(held), gold.where(held), list(LABELS), ["review_id"])
    rows = work.stored(rows, "quality")
    known = rows.agg(F.coalesce(F.sum(F.col("predicted") + F.col("actual")), F.lit(0)).alias("n")).first().n
    return rows if known else rows.where("false")


def _classify(spark: SparkSession, project: str, store: Store, decider: K.Asked | None) -> None:
    rules = files.read_rules(Path(project, "rules.yaml").read_text(encoding="utf-8"), LABELS)
    reviews = store.read("stg_reviews").withColumn("review_id", F.concat("source", F.lit(":"), "external_id"))
    cache, key = f"{project}/decisions.csv", f"{project}/labels.csv"
    none = spark.createDataFrame([], "review_id string, prompt_version string, model string, theme string")
    texts = reviews.select("review_id", T.joined_text(F.col("title"), F.col("body")).alias("text"))
    with store.batch() as b:
        known = files.read_decisions(spark, cache, LABELS) if files.present(spark, cache) else none
        kept = b.read("decisions")
        known = known if kept is None else known.unionByName(kept)
        if decider is not None:
            answers = K.answered(texts, rules, known, PROMPT, MODEL, decider, LABELS, "review_id")
            b.append("decisions", answers.withColumn("ordinal", F.col("theme")), ["review_id", "prompt_version", "model", "theme"], "ordinal")
            known = known.unionByName(b.read("decisions"))
        themes = K.decided_once(texts, rules, known, PROMPT, MODEL, key="review_id")
        rows = themes.join(reviews.select("review_id", "source", "external_id", "segment", "rating", "review_date", "run_id"), "review_id")
        b.replace("stg_classified_reviews", rows.withColumn("month", T.month(F.col("review_date"))))
        rows = b.read("stg_classified_reviews")
        for name, groups in (("theme_share_by_month", ["month", "segment"]), ("theme_share_by_segment", ["segment"])):
            b.replace(name, K.theme_share(rows, groups, "review_id", "run_id"))
        b.replace("review_drill", rows.select("review_id", "theme", "rating", "review_date", "segment", "source"))
        if files.present(spark, key):
            gold = files.read_answer_key(spark, key, LABELS).select("review_id", F.col("label").alias("theme"))
            b.replace("classifier_quality", quality(rows, gold))
        model = model_rows(spark, project)
        for name, table in (("cost_model_params", M.cost_params), ("cost_model_outputs", M.cost_outputs), ("cost_curves", M.cost_curves), ("guardrail_sim", M.guardrail_sim), ("sla_threshold", M.sla_threshold)):
            b.replace(name, table(spark, model))
        stages = [("raw", "raw_reviews"), ("staged", "stg_reviews"), ("classified", "stg_classified_reviews")]
        listed = {n: sum(rows for _, rows in store.folders(e)) for n, e in b.state["tables"].items()}
        runs = [r.run_id for r in reviews.select("run_id").distinct().limit(2).collect()]
        b.replace("pipeline_row_counts", spark.createDataFrame([(stage, listed[name], runs[0] if len(runs) == 1 else None) for stage, name in stages], "stage string, n long, run_id string"))


def model_rows(spark: SparkSession, project: str) -> list[tuple] | None:
    """The model's parameters from the artifacts ``fit.csv`` and ``fees.csv`` (families in ``families.json``), if the project has them."""
    if not all(files.present(spark, f"{project}/{name}") for name in ("fit.csv", "fees.csv", "families.json")):
        return None
    families = tuple(json.loads(Path(project, "families.json").read_text(encoding="utf-8")))
    return M.from_artifacts(files.read_fit(spark, f"{project}/fit.csv"), files.read_fee_split(spark, f"{project}/fees.csv", families))


def rebuild(spark: SparkSession, project: str, store: str, run_id: str, stage: str = "classify", decider: K.Asked | None = None) -> dict[str, int]:
    """Run the stages up to ``stage``; gives the rows of every table of the store."""
    if stage not in STAGES:
        raise load.Refused(f"stage {stage!r}, one of {', '.join(STAGES)}")
    at = Store(spark, store)
    steps: tuple[Callable[[], None], ...] = (lambda: _load(spark, project, at, run_id), lambda: _clean(spark, at), lambda: _classify(spark, project, at, decider))
    for name, step in zip(STAGES, steps, strict=True):
        step()
        if name == stage:
            break
    return counts(spark, store)


def counts(spark: SparkSession, store: str) -> dict[str, int]:
    return Store(spark, store).counts()


def idempotency_check(spark: SparkSession, project: str, store: str) -> dict[str, int]:
    """Build twice under two run ids; a table whose rows differ is refused."""
    first, second = (rebuild(spark, project, store, run) for run in ("check-1", "check-2"))
    if bad := [n for n in first.keys() | second.keys() if first.get(n) != second.get(n)]:
        raise load.Refused(f"rows differ after the second build: {sorted(bad)}")
    return second


def _points(rows: list, label: Callable[[object], str], value: str, tag: str = "Measured") -> list[serve.Point]:
    """A point for each row; a null is a stated absence."""
    return [serve.Point(label(r), float(r[value]), tag) if r[value] is not None else serve.Point(label(r), None, tag, "none") for r in rows]


def report(spark: SparkSession, store: str, run_ids: dict[str, str]) -> str:
    """The HTML report of a store: every panel that reads its marts; those over texts say what corpus they are from."""
    at = Store(spark, store)
    tables = at.counts()
    read = lambda name, columns, order, where="true": serve.served(at.read(name).where(where).select(*columns).orderBy(*order), set(columns))
    share = at.read("theme_share_by_segment")
    state = serve.corpus_gate(share, run_ids)
    panels = []

    def add(panel: str, kind: str, title: str, points: list[serve.Point], gated: bool = False, none: str = "no data", links: tuple[str, ...] = ()) -> None:
        note = state if gated else ""
        panels.append(serve.Panel(panel, kind, title, points or [serve.Point(title, None, "Pending", state if gated else none)], note=note, links=list(links)))

    pages = tuple(r.source_url for r in read("raw_source_pages", ["source_url"], ["source_url"]))
    if "rating_trend" in tables:
        add("B1.2", "line", "Rating by month", [serve.Point(f"{r.segment} {r.source} {r.month}", float(r.rating), r.tag) for r in read("rating_trend", ["segment", "source", "profile", "month", "rating", "tag"], ["segment", "source", "profile", "month"], f"channel = '{files.CHANNELS[0]}'")], links=pages)
        add("B1.3", "bar", "Rating by channel", [serve.Point(f"{r.segment} {r.channel} {r.source}", float(r.rating), r.tag) for r in read("channel_gap", ["segment", "channel", "source", "profile", "rating", "tag"], ["segment", "channel", "source", "profile"])])
        add("B1.4", "stats", "Figures of each source", [serve.Point(f"{r.source} {r.stat}", float(r.value), r.tag) for r in read("platform_stats", ["segment", "source", "profile", "stat", "value", "tag"], ["source", "profile", "stat"])])
        add("B2.3", "bar", "Peers", [serve.Point(f"{r.segment} {r.source} {r.profile}", float(r.rating), r.tag) for r in read("peer_ratings", ["segment", "source", "profile", "rating", "tag"], ["segment", "source", "profile"])])
    month = read("theme_share_by_month", ["month", "segment", "label", "share"], ["month", "segment", "label"], f"label <> '{K.POSITIVE}'")
    add("B2.2", "line", f"Themes by month ({state})", _points(month, lambda r: f"{r.month} {r.segment} {r.label}", "share"), True)
    if "classifier_quality" in tables:
        rows = read("classifier_quality", ["label", "predicted", "actual", "precision", "recall"], ["label"])
        add("B2.4", "table", f"Quality of the classifier ({state})", [p for side in ("precision", "recall") for p in _points(rows, lambda r, side=side: f"{r.label} {side}", side)], True)
    themes = read("theme_share_by_segment", ["segment", "label", "share"], ["segment", "label"])
    add("B2.5", "bar", f"Themes by segment ({state})", _points(themes, lambda r: f"{r.segment} {r.label}", "share"), True)
    outputs = read("cost_model_outputs", ["name", "value"], ["name"], "scenario = 'baseline'")
    place = {name: i for i, (name, _, _) in enumerate(M.FORMULAS)}
    add("B3.1", "formulas", "Cost model, baseline", _points(sorted(outputs, key=lambda r: place.get(r["name"], len(place))), lambda r: r["name"], "value", "Modeled"))
    curve = read("cost_curves", ["scenario", "flag_rate", "net", "is_default"], ["scenario", "flag_rate"])
    baseline = [r for r in curve if r.scenario == "baseline"]
    if sum(r.is_default for r in baseline) != 1:
        raise load.Refused("the curve needs one default point")
    markers = [r.value for r in outputs if r["name"].endswith("crossover_flag_rate") and r.value is not None]
    add("B3.2", "curve", "Net by share flagged, baseline", _points(baseline, lambda r: f"{r.flag_rate:g}", "net", "Modeled"))
    panels[-1].markers, panels[-1].grid = markers, [r.flag_rate for r in baseline]
    for panel, sourcing, title in (("B3.3", "sourced", "Parameters with a source"), ("B3.4", "unsourced", "Parameters without one")):
        rows = read("cost_model_params", ["name", "default_value", "unit", "tag"], ["name"], f"sourcing = '{sourcing}'")
        add(panel, "parameters", title, [serve.Point(f"{r['name']} ({r.unit})", r.default_value, r.tag) for r in rows])
    add("B4.1", "curve", "Net of the four scenarios", _points(curve, lambda r: f"{r.scenario} {r.flag_rate:g}", "net", "Modeled"))
    timer = read("sla_threshold", ["timer_days", "timer_amount_eur", "share_under"], ["timer_days"], "is_default")
    if len(timer) != 1:
        raise load.Refused("one timer is the default")
    add("B4.2", "stats", f"Timer of {timer[0].timer_days} days", [serve.Point(c, float(timer[0][c]), "Modeled") for c in ("timer_amount_eur", "share_under")])
    holds = serve.served(M.hold_summary(at.read("guardrail_sim")).select("scenario", "mean_hold_days", "released_share").orderBy("scenario"), {"scenario", "mean_hold_days", "released_share"})
    add("B4.3", "bar", "Holds by scenario", [p for side in ("mean_hold_days", "released_share") for p in _points(holds, lambda r, side=side: f"{r.scenario} {side}", side, "Modeled")])
    for panel, title in (("B1.1", "Claims behind the reviews"), ("B2.1", "Reviews behind a theme"), ("B4.4", "Effect of a fix")):
        add(panel, "hero", title, [], none="not measured yet")
    facts = panels_of.determinism_facts(spark, "").orderBy("fact").collect()  # three facts
    add("B5.1", "stats", "What the code does not do", _points(facts, lambda r: r.fact, "value"))
    add("B5.2", "table", f"Rows of each stage ({state})", _points(read("pipeline_row_counts", ["stage", "n"], ["stage"]), lambda r: r.stage, "n"), True)
    panels.sort(key=lambda p: p.id)
    return serve.render(panels)
