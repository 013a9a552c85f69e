"""Rule classifier, decisions of a model behind a cache, shares and grades."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold, folded, found_literals, meant
from . import work

UNCLASSIFIED, POSITIVE = "unclassified", "positive"


def labelled(docs: DataFrame, rules: dict[str, list[str]], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, _labels): all themes with a pattern at a word start; else positive; else unclassified.

    A text is folded once and gone through once; what is found is a column of its own, so that nothing after it
    evaluates either again.
    """
    # a rule pattern is a literal; the forms that quoting of expressions uses never were part of one
    clean = {label: [q for p in ps if (q := folded(p.replace("\\E", "")))] for label, ps in rules.items()}
    known = [p for ps in clean.values() for p in ps]
    if not known:
        return docs.select(*keys, F.array(F.lit(UNCLASSIFIED)).alias("_labels"))
    inside = meant(known)
    seen = docs.select(*keys, F.coalesce(found_literals(fold(F.col(text)), known), F.array().cast("array<string>")).alias("_found"))
    hit = lambda ps: F.arrays_overlap("_found", F.array(*[F.lit(long) for long, short in inside.items() if set(short) & set(ps)]))
    themes = F.array_compact(F.array(*[F.when(hit(ps), F.lit(label)) for label, ps in clean.items() if label != POSITIVE and ps] or [F.lit(None).cast("string")]))
    positive = hit(clean[POSITIVE]) if clean.get(POSITIVE) else F.lit(False)
    named = seen.select(*keys, themes.alias("_themes"), positive.alias("_positive"))
    labels = F.when(F.size("_themes") > 0, F.col("_themes")).when(F.col("_positive"), F.array(F.lit(POSITIVE))).otherwise(F.array(F.lit(UNCLASSIFIED)))
    return named.select(*keys, labels.alias("_labels"))


def _one_a_label(rows: DataFrame, keys: tuple[str, ...], labels: Column) -> DataFrame:
    """(keys, theme, is_first): one row per label; the first of a text is marked, so that texts can be counted with their rows.

    A text always has a label.  The outer form says so: the plain one adds a filter that evaluates all rules again.
    """
    return rows.select(*keys, F.posexplode_outer(labels).alias("_at", "theme")).select(*keys, "theme", (F.col("_at") == 0).alias("is_first"))


def classify(docs: DataFrame, rules: dict[str, list[str]], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, theme), one row per label; column expressions only."""
    return classified_once(docs, rules, text, keys).drop("is_first")


def classified_once(docs: DataFrame, rules: dict[str, list[str]], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, theme, is_first), see ``theme_share``."""
    return _one_a_label(labelled(docs, rules, text, keys), keys, F.col("_labels"))


def decided(docs: DataFrame, rules: dict[str, list[str]], cache: DataFrame, prompt_version: str, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, theme) by rules and cached decisions."""
    return decided_once(docs, rules, cache, prompt_version, model, text, key).drop("is_first")


def decided_once(docs: DataFrame, rules: dict[str, list[str]], cache: DataFrame, prompt_version: str, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, theme, is_first) by rules, and by cached decisions where no rule matches: texts are classified once and joined once."""
    known = cache.where((F.col("prompt_version") == prompt_version) & (F.col("model") == model)).groupBy(key).agg(F.sort_array(F.collect_set("theme")).alias("_known"))
    open_ = F.col("_labels") == F.array(F.lit(UNCLASSIFIED))
    themes = F.when(open_, F.coalesce("_known", "_labels")).otherwise(F.col("_labels"))
    return _one_a_label(labelled(docs, rules, text, (key,)).join(known, key, "left"), (key,), themes)


def unresolved(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids whose only label is unclassified."""
    return classified.groupBy(key).agg(F.min("theme").alias("lo"), F.max("theme").alias("hi")).where(f"lo = '{UNCLASSIFIED}' AND hi = '{UNCLASSIFIED}'").select(key)


#: (ids, texts) to one list of labels for each, or None where the model has no answer.
Asked = Callable[[list, list[str]], list[list[str] | None]]


def answered(docs: DataFrame, rules: dict[str, list[str]], cache: DataFrame, prompt_version: str, model: str, decider: Asked, labels: Sequence[str], key: str = "doc_id", text: str = "text", batch: int = 64) -> DataFrame:
    """(key, prompt_version, model, theme) of the texts that no rule and no cached decision decides, from the decider.

    The decider runs where the rows are, ``batch`` texts at a time, and is given each open text once.  Labels
    outside the closed set go; no answer or none left is ``unclassified``.  A work table, so that a
    lost reader does not ask again.
    """
    known = cache.where((F.col("prompt_version") == prompt_version) & (F.col("model") == model)).select(key).distinct()
    # a filter on the labels themselves would be moved below them, with the fold and the rules written out for every theme
    seen = labelled(docs.select(key, text), rules, text, (key,)).select(key, F.explode_outer(F.array("_labels")).alias("_labels"))
    open_ = seen.where(F.col("_labels") == F.array(F.lit(UNCLASSIFIED))).select(key)
    asked = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(open_.join(known, key, "left_anti"), key, "left_semi")
    kind, closed = docs.schema[key].dataType.simpleString(), set(labels)

    def ask(batches: Iterator) -> Iterator:
        for rows in batches:
            ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for lo in range(0, len(ids), batch):
                answers = decider(ids[lo : lo + batch], texts[lo : lo + batch])
                pairs = [(i, t) for i, a in zip(ids[lo : lo + batch], answers, strict=True) for t in sorted(set(a or ()) & closed) or [UNCLASSIFIED]]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], rows.schema.field(0).type), pa.array([t for _, t in pairs], pa.string())], [key, "theme"])

    found = asked.select(key, "text").mapInArrow(ask, f"`{key}` {kind}, theme string")
    return work.stored(found.select(key, F.lit(prompt_version).alias("prompt_version"), F.lit(model).alias("model"), "theme"), "answers")


def merge_decisions(classified: DataFrame, cache: DataFrame, prompt_version: str, model: str, key: str = "doc_id", decider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Unresolved ids take cached labels for (prompt version, model), then the decider's, else stay unclassified.

    The decider gets only ids that are unresolved and not cached, and returns (key, theme).
    """
    open_ = unresolved(classified, key)
    known = cache.where((F.col("prompt_version") == prompt_version) & (F.col("model") == model)).select(key, F.col("theme").alias("_theme"))
    if decider is not None:
        asked = open_.join(known, key, "left_anti")
        known = known.union(decider(asked).select(key, F.col("theme").alias("_theme")))
    kept = classified.join(open_, key, "left_anti").select(key, "theme")
    decided = open_.join(known, key, "left").select(key, F.coalesce("_theme", F.lit(UNCLASSIFIED)).alias("theme"))
    return kept.union(decided).distinct()


def theme_share(classified: DataFrame, groups: list[str], key: str = "doc_id", run_id: str | None = None) -> DataFrame:
    """Per cell and label: rows of the label over distinct ids of the cell. Shares may add up to more than one.

    With ``run_id`` a cell's label carries the least run id of its rows.  Rows that mark the first
    label of their text (``is_first``) are counted in the same aggregate; others take a distinct count and a join.
    """
    run = [F.min(run_id).alias("run_id")] if run_id else []
    if "is_first" in classified.columns:
        cells = classified.groupBy(*groups, F.col("theme").alias("label")).agg(F.count("*").alias("label_rows"), F.count_if("is_first").alias("_texts"), *run)
        rows = cells.withColumn("reviews", F.sum("_texts").over(Window.partitionBy(*groups)))
        share = F.round(F.col("label_rows").cast("double") / F.col("reviews"), 6).alias("share")
        return rows.select(*groups, "label", share, "label_rows", "reviews", *(["run_id"] if run_id else []))
    total = classified.groupBy(*groups).agg(F.count_distinct(key).alias("reviews"))
    rows = classified.groupBy(*groups, F.col("theme").alias("label")).agg(F.count("*").alias("label_rows"), *run)
    share = F.round(F.col("label_rows").cast("double") / F.col("reviews"), 6).alias("share")
    return rows.join(total, groups).select(*groups, "label", share, "label_rows", "reviews", *(["run_id"] if run_id else []))


def grades(predicted: DataFrame, actual: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """Precision and recall by label, over ids both sides know; null where a denominator is zero."""
    spark = predicted.sparkSession
    predicted = predicted.select(*keys, "theme")
    both = predicted.select(*keys).distinct().join(actual.select(*keys).distinct(), keys, "left_semi")
    p = predicted.join(both, keys, "left_semi").select(*keys, "theme").distinct().withColumn("p", F.lit(1))
    a = actual.join(both, keys, "left_semi").select(*keys, "theme").distinct().withColumn("a", F.lit(1))
    count = p.join(a, [*keys, "theme"], "full").groupBy("theme").agg(F.sum(F.coalesce("p", F.lit(0))).alias("predicted"), F.sum(F.coalesce("a", F.lit(0))).alias("actual"), F.sum(F.coalesce(F.col("p") * F.col("a"), F.lit(0))).alias("correct"))
    closed = spark.createDataFrame([(x,) for x in labels], "label string")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = F.broadcast(closed).join(count, F.col("label") == F.col("theme"), "left").select("label", n("predicted").alias("predicted"), n("actual").alias("actual"), n("correct").alias("correct"))
    ratio = lambda d: F.when(F.col(d) > 0, F.round(F.col("correct").cast("double") / F.col(d), 6))
    return out.withColumn("precision", ratio("predicted")).withColumn("recall", ratio("actual"))


def decided_share(predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(decided, texts, share): how many texts have a label that is not ``unclassified``; null without texts."""
    total = predicted.agg(F.count_distinct(F.when(F.col("theme") != UNCLASSIFIED, F.col(key))).alias("decided"), F.count_distinct(key).alias("texts"))
    return total.withColumn("share", F.when(F.col("texts") > 0, F.round(F.col("decided").cast("double") / F.col("texts"), 6)))
