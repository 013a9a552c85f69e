"""Strict readers. Text is read as text, checked by column expressions, refused by rule."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import work
from ..operators.latest import latest_by
from ..operators.load import Refused
from . import amounts, records

# Headers of the declared inputs.
REVIEWS = ("source", "external_id", "source_url", "captured_at", "review_date", "rating", "title", "body")
ANCHORS = ("platform", "profile", "segment", "channel", "rating", "review_count", "one_star_share", "response_rate", "response_delay_days", "captured_at", "source_url", "seeded_from")
MANUAL = ("source", "captured_at", "rating", "review_count", "one_star_share", "response_rate", "response_delay_days", "read_from")
FETCHED = MANUAL[:-1]
MEASURES = ("rating", "review_count", "one_star_share", "response_rate", "response_delay_days")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = ",", exact: bool = True) -> DataFrame:
    """CSV files whose headers equal the declared columns (or hold them); every cell is text. See ``records.read``."""
    return records.read(spark, path, columns, sep=sep, exact=exact).drop("ordinal")


def refuse_where(df: DataFrame, bad, rule: str, *show: str) -> None:
    """Raise with the first row that breaks a rule."""
    if row := df.where(bad).select(*show).limit(1).first():
        raise Refused(f"{rule}: {', '.join(f'{k}={row[k]!r}' for k in show)}")


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _measured(df: DataFrame) -> tuple[DataFrame, list[records.Rule]]:
    """The five measures as numbers, with a rule for each: given, but no number of its range."""
    rules = []
    for name in MEASURES:
        given = F.nullif(F.trim(name), F.lit(""))
        value = T.count_value(given) if name == "review_count" else T.measure(name, given)
        df = df.withColumn(f"_{name}", F.col(name)).withColumn(name, value)
        rules.append((f"{name} is not a measure", F.nullif(F.trim(f"_{name}"), F.lit("")).isNotNull() & F.col(name).isNull(), (f"_{name}",)))
    return df, rules


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_{m}" for m in MEASURES])


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews with their content hash and ``ordinal``, their place in the files."""

    def shape(rows: DataFrame) -> tuple[DataFrame, list[records.Rule]]:
        rows = rows.withColumn("content_hash", T.fingerprint(*[F.col(c) for c in ("rating", "review_date", "title", "body")]))
        rows = rows.withColumn("_rating", F.col("rating")).withColumn("rating", T.half_step(F.col("rating")))
        rules = [(f"{k} is empty", blank(k), ("source", "external_id")) for k in ("source", "external_id")]
        rules += [("rating is not a half step", F.col("rating").isNull(), ("external_id", "_rating")), ("review_date is no day", T.real_day(F.col("review_date")).isNull(), ("external_id", "review_date"))]
        return rows, rules

    return records.read(spark, path, REVIEWS, shape).drop("_rating")


# Channels of a snapshot; only the first is compared among peers.
CHANNELS = ("unsolicited", "solicited")


def read_anchors(spark: SparkSession, path: str, segments: Sequence[str] | None = None, channels: Sequence[str] | None = None, published: bool = False) -> DataFrame:
    """Reference points: slugs, attributions of closed sets where they are given, a real day or instant and where each figure is from.

    ``published``: addresses have to be https and times days, as in a seed that is shown to readers.
    """

    def shape(rows: DataFrame) -> tuple[DataFrame, list[records.Rule]]:
        slug = lambda c: ~F.coalesce(F.col(c).rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z"), F.lit(False))
        rules = [(f"{c} is not a slug", slug(c), (c,)) for c in ("platform", "profile")]
        rules += [(f"{c} is not one of {', '.join(known)}", ~F.coalesce(F.col(c).isin(*known), F.lit(False)), (c,)) for c, known in (("segment", segments), ("channel", channels)) if known is not None]
        at = T.real_day(F.col("captured_at")) if published else F.coalesce(T.real_day(F.col("captured_at")), T.real_instant(F.col("captured_at")))
        rules += [("seeded_from is empty", blank("seeded_from"), ("platform",)), ("captured_at is no day", at.isNull(), ("captured_at",))]
        if published:
            rules.append(("source_url is not an https address", ~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), ("source_url",)))
        rows, more = _measured(rows)
        return rows, [*rules, *more]

    return _plain(records.read(spark, path, ANCHORS, shape)).withColumnRenamed("platform", "source").withColumn("origin", F.lit("anchor"))


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def present(spark: SparkSession, path: str) -> bool:
    where, system = _hadoop(spark, path)
    return system.exists(where)


def _of_sources(spark: SparkSession, path: str, columns: tuple[str, ...], allowed: DataFrame, why: str, instant: Callable[[Column], Column]) -> DataFrame:
    """Snapshots of some of the declared sources; ``allowed``: source, and what to add from its declaration."""
    side = work.sized(allowed.withColumn("_known", F.lit(True)), 1000)

    def shape(rows: DataFrame) -> tuple[DataFrame, list[records.Rule]]:
        rows = rows.join(side, "source", "left")
        rows, rules = _measured(rows)
        return rows, [(why, F.col("_known").isNull(), ("source",)), ("captured_at is no day or instant", instant(F.col("captured_at")).isNull(), ("captured_at",)), *rules]

    return _plain(records.read(spark, path, columns, shape)).drop("_known")


def read_manual(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Hand-entered snapshots; only of declared sources without a parser. A missing file is no rows."""
    if not present(spark, path):
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in MANUAL) + ", ordinal struct<file:string,block:bigint,line:bigint>")
        return _plain(_measured(empty)[0]).withColumn("origin", F.lit("manual"))
    rows = _of_sources(spark, path, MANUAL, sources.where("parser IS NULL").select("source"), "not a source entered by hand", lambda c: F.coalesce(T.real_day(c), T.real_instant(c)))
    return rows.withColumn("origin", F.lit("manual"))


def read_fetched(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Fetched snapshots; only of fetchable, parsed sources; the address is the first declared page."""
    allowed = sources.where("parser IS NOT NULL AND fetchable").select("source", F.element_at("pages", 1).alias("source_url"))
    rows = _of_sources(spark, path, FETCHED, allowed, "not a fetched source", lambda c: F.coalesce(T.real_day(c), T.real_instant(c)))
    return rows.withColumn("origin", F.lit("fetch"))


def declared_pages(sources: DataFrame) -> DataFrame:
    """(source, page number, source_url) of every declared page."""
    return sources.select("source", F.posexplode("pages").alias("n", "source_url")).select("source", (F.col("n") + 1).cast("int").alias("page"), "source_url")


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of a JSON feed: no entry is an empty page, an entry that is no list is refused."""
    page = spark.read.text(path, wholetext=True).withColumn("entry", F.get_json_object("value", "$.feed.entry"))
    if (bad := page.where("get_json_object(value, '$.feed') IS NULL OR (entry IS NOT NULL AND entry NOT LIKE '[%')").select(F.input_file_name().alias("f")).first()) is not None:
        raise Refused(f"{bad.f}: the feed's entry is not a list")
    label = "struct<label:string>"
    kind = f"array<struct<id:{label},title:{label},content:{label},`im:rating`:{label},updated:{label}>>"
    e = page.where("entry IS NOT NULL").select(F.posexplode(F.from_json("entry", kind)).alias("place", "e"))
    df = e.select(F.col("e.id.label").alias("external_id"), F.col("e.title.label").alias("title"), F.col("e.content.label").alias("body"), F.col("e.im:rating.label").alias("rating"), T.printed_day(F.col("e.updated.label")).alias("review_date"), "place")
    refuse_where(df, F.col("external_id").isNull() | F.col("review_date").isNull() | T.half_step(F.col("rating")).isNull(), "item", "external_id", "rating", "review_date")
    return df.withColumn("rating", T.half_step(F.col("rating")))


# English month names of the export.
MONTHS = "January February March April May June July August September October November December".split()


def read_star_export(spark: SparkSession, path: str, id_col: str, date_col: str, star_col: str, title_col: str, body_col: str) -> DataFrame:
    """A review export: rating from a star image address, dates with English month names; only the named columns are read."""

    def shape(rows: DataFrame) -> tuple[DataFrame, list[records.Rule]]:
        number = F.coalesce(*[F.when(F.regexp_extract(date_col, r"^([A-Z][a-z]+) ", 1) == m, F.lit(f"{i:02d}")) for i, m in enumerate(MONTHS, 1)])
        day = F.concat(F.regexp_extract(date_col, r", ([0-9]{4})\z", 1), F.lit("-"), number, F.lit("-"), F.lpad(F.regexp_extract(date_col, r" ([0-9]{1,2}),", 1), 2, "0"))
        star = F.nullif(F.regexp_extract(star_col, r"^https://[^?#]*stars-([1-5](?:\.5)?)\.(?:svg|png)\z", 1), F.lit(""))
        out = rows.select(F.col(id_col).alias("external_id"), F.col(date_col).alias("_day"), F.col(star_col).alias("_star"), T.real_day(day).alias("review_date"), star.alias("rating"), F.col(title_col).alias("title"), F.coalesce(body_col, F.lit("")).alias("body"), "ordinal", "_broken")
        return out, [("the id is empty", blank("external_id"), ("external_id",)), ("not a printed day", F.col("review_date").isNull(), ("external_id", "_day")), ("not a star address", F.col("rating").isNull(), ("external_id", "_star"))]

    return records.read(spark, path, (id_col, date_col, star_col, title_col, body_col), shape, exact=False).drop("_day", "_star")


def read_amounts(spark: SparkSession, path: str, scratch: str | None = None, amount: str = "PRS_REM_MNT", kind: str = "PRS_REM_TYP", kinds: tuple[str, ...] = ("0", "1")) -> DataFrame:
    """(amount, file, at): positive amounts of the legal kinds with their place; gzip files are known by their first bytes, see ``amounts``.

    ``scratch`` is where mis-named files were once copied to; nothing is copied any more.
    """
    rows = amounts.rows(spark, path, amount, kind)
    return rows.where(F.trim("kind").isin(*kinds)).select(T.amount(F.col("amount")).alias("amount"), "file", "at").where("amount IS NOT NULL")


def read_fee_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A fee table, ``;`` between cells, with any number of byte order marks before its first header."""
    return read_csv(spark, path, columns, sep=";", exact=False)


def read_answer_key(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """(review_id, label) of a closed set of labels; a pair given twice or an empty id is refused."""
    closed = ("label is not one of the closed set", ~F.coalesce(F.col("label").isin(*labels), F.lit(False)), ("review_id", "label"))
    df = records.read(spark, path, ("review_id", "label"), lambda rows: (rows, [closed, ("review_id is empty", blank("review_id"), ("review_id", "label"))])).drop("ordinal")
    refuse_where(df.groupBy("review_id", "label").count(), F.col("count") > 1, "given twice", "review_id", "label")
    return df


def read_decisions(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """(review_id, prompt_version, model, theme) of cached decisions, themes from a closed set."""
    closed = ("theme is not one of the closed set", ~F.coalesce(F.col("theme").isin(*labels), F.lit(False)), ("review_id", "theme"))
    return records.read(spark, path, ("review_id", "prompt_version", "model", "theme"), lambda rows: (rows, [closed])).drop("ordinal")


def read_name_values(spark: SparkSession, path: str, names: tuple[str, ...], most: int = 64 << 10) -> dict[str, str]:
    """A small name,value artifact with exactly the closed set of names."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first().n
    if size > most:
        raise Refused(f"{path}: {size} bytes, at most {most}")
    rows = [(r.name, r.value) for r in read_csv(spark, path, ("name", "value")).collect()]
    given = [n for n, _ in rows]
    if twice := sorted({n for n in given if given.count(n) > 1}):
        raise Refused(f"{path}: names {twice} are given twice")
    if set(given) != set(names):
        raise Refused(f"{path}: unknown names {sorted(set(given) - set(names))}, missing {sorted(set(names) - set(given))}")
    return dict(rows)


# Names of the fit artifact.
FIT_NAMES = ("mu", "sigma", "n", "emp_mean", *[f"{side}_p{p}" for p in range(10, 100, 10) for side in ("emp", "fit")])


def read_fit(spark: SparkSession, path: str) -> dict[str, float]:
    """The fit artifact, every value a finite number, n a count."""
    raw, out = read_name_values(spark, path, FIT_NAMES), {}
    for name, text in raw.items():
        if not re.fullmatch(r"[0-9]{1,10}" if name == "n" else r"-?[0-9]{1,12}(\.[0-9]{1,12})?", text or ""):
            raise Refused(f"{path}: {name}={text!r}")
        out[name] = int(text) if name == "n" else float(text)
    return out


def read_fee_split(spark: SparkSession, path: str, families: tuple[str, ...]) -> dict[str, tuple[int, int, float]]:
    """family -> (extra, tariff, share): whole euros, and shares that equal the sums to six places."""
    raw, out = read_name_values(spark, path, tuple(f"{f}_{x}" for f in (*families, "overall") for x in ("extra", "tariff", "share"))), {}
    for f in (*families, "overall"):
        cells = [raw[f"{f}_{x}"] or "" for x in ("extra", "tariff", "share")]
        if not all(re.fullmatch(r"[0-9]{1,12}", c) for c in cells[:2]):
            raise Refused(f"{path}: {f}: not whole euros")
        extra, tariff = int(cells[0]), int(cells[1])
        if extra + tariff == 0:
            raise Refused(f"{path}: {f} billed nothing")
        if cells[2] != f"{extra / (extra + tariff):.6f}":
            raise Refused(f"{path}: {f}: share {cells[2]} is not that of the sums")
        out[f] = extra, tariff, float(cells[2])
    if [sum(out[f][k] for f in families) for k in (0, 1)] != list(out["overall"][:2]):
        raise Refused(f"{path}: overall is not the sum of the families")
    return out


def read_captures(spark: SparkSession, root: str, declared: list[str] | None = None, host: str | None = None) -> DataFrame:
    """(capture, source_url, captured_at, page, body, source) of capture folders: page-<n>.<ext> with page-<n>.meta.json.

    A sidecar has exactly three fields: a real instant, status 200, and an https address
    on the source's host that is one of its declared pages.  Refused pages
    (``page-<n>.refused.<ext>``) are no pages.  Files are read once; ``source`` is the folder above a capture's.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.decode("content", "UTF-8").alias("body"))
    stem = F.regexp_extract("path", r"^(.*/page-[0-9]+)\.", 1)
    kind = F.when(F.col("path").endswith(".meta.json"), "meta").when(F.col("path").rlike(r"/page-[0-9]+\.[^./]+\z"), "page")
    found = work.stored(found.select(stem.alias("stem"), kind.alias("kind"), "body").where("kind IS NOT NULL"), "captures")
    meta = found.where("kind = 'meta'").select("stem", F.from_json("body", "source_url string, captured_at string, status int").alias("m"), F.json_object_keys("body").alias("keys"))
    address = F.col("m.source_url")
    bad = F.col("m.status").isNull() | (F.col("m.status") != 200) | T.real_instant(F.col("m.captured_at")).isNull() | address.isNull() | ~address.startswith("https://")
    if host is not None:
        bad |= F.lower(F.regexp_extract(address, r"^https://([^/?#:@]+)", 1)) != host
    if declared is not None:
        bad |= ~address.isin(*declared)
    odd = ~F.coalesce(F.array_sort("keys") == F.array(F.lit("captured_at"), F.lit("source_url"), F.lit("status")), F.lit(False))
    pages = found.where("kind = 'page'").select(F.col("stem").alias("page_stem"), "body")
    both = meta.join(pages, meta["stem"] == pages["page_stem"], "full")
    says = F.when(F.col("stem").isNull(), "no sidecar").when(odd, "sidecar keys").when(F.coalesce(bad, F.lit(True)), "sidecar values")
    if row := both.select(F.coalesce("stem", "page_stem").alias("at"), says.alias("says")).where("says IS NOT NULL").agg(F.min(F.struct("at", "says")).alias("r")).first().r:
        raise Refused(f"{row.at}: {row.says}")
    capture, source = (F.regexp_extract("stem", pattern, 1) for pattern in (r"([^/]+)/page-[0-9]+$", r"([^/]+)/[^/]+/page-[0-9]+$"))
    rows = both.where("page_stem IS NOT NULL")
    return rows.select(capture.alias("capture"), "m.source_url", "m.captured_at", F.regexp_extract("stem", r"page-([0-9]+)$", 1).cast("int").alias("page"), "body", source.alias("source"))


def first_snapshot(snapshots: DataFrame, capture: str = "capture", page: str = "page") -> DataFrame:
    """One snapshot of each capture: that of its first page that carries one."""
    return latest_by(snapshots, [capture], [F.asc(page)])


def _scalar(text: str, where: str) -> str:
    """A plain, single-quoted or double-quoted scalar of one line; a comment may follow it."""
    if m := re.fullmatch(r"'((?:[^']|'')*)'\s*(?:#.*)?", text):
        return m[1].replace("''", "'")
    if m := re.fullmatch(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?', text):
        return json.loads(f'"{m[1]}"')
    plain = re.sub(r"(^|\s)#.*$", "", text).strip()
    if not plain or plain[0] in "'\"[]{}>|*&!%@`,#" or re.search(r":(\s|$)", plain):
        raise Refused(f"{where}: {text!r} is no plain text")
    return plain


def read_rules(path_text: str, allowed: tuple[str, ...]) -> dict[str, list[str]]:
    """Rules as JSON or as the YAML of a rule file: labels, each with a list in lines or in brackets; closed keys, non-empty lists.

    Anything else that YAML knows - anchors, tags, nested maps, tabs, a label given twice - is refused.
    """
    if path_text.lstrip().startswith("{"):
        pairs = json.loads(path_text, object_pairs_hook=lambda p: p)
        rules = dict(pairs)
        if len(rules) < len(pairs):
            raise Refused("a rule is given twice")
    else:
        rules, now = {}, None
        for n, line in enumerate(path_text.lstrip("\ufeff").splitlines(), 1):
            where, bare = f"rule line {n}", line.strip()
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise Refused(f"{where}: a tab before text")
            if not bare or bare.startswith("#") or bare == "---" and now is None:
                continue
            if bare.startswith("- ") and now is not None:
                rules[now].append(_scalar(bare[2:].strip(), where))
            elif m := re.fullmatch(r"([^\s#'\"\[\]{}-][^:#]*|'[^']+'|\"[^\"]+\"):\s*(\[.*\])?\s*(?:#.*)?", line):
                now = _scalar(m[1].strip(), where)
                if now in rules:
                    raise Refused(f"{where}: {now!r} is given twice")
                cells = re.findall(r"\s*('(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|[^,]+)", m[2][1:-1]) if m[2] else []
                rules[now] = [_scalar(c.strip(), where) for c in cells if c.strip()]
            else:
                raise Refused(f"{where}: {line!r}")
    for label, patterns in rules.items():
        if label not in allowed or not isinstance(patterns, list) or not patterns or not all(isinstance(p, str) and p for p in patterns):
            raise Refused(f"rule {label!r}")
    return rules
