"""Page parsers as a table function that is joined laterally to captures; titles; robots rules.

A parser turns one page into rows of one kind each: review, snapshot or, for a page outside its
shape, one refusal.  Figures come out as the page spells them; expressions check them afterwards.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .files import MONTHS

_PAGE = "kind string, external_id string, review_date string, rating string, title string, body string, review_count string, error string"


@dataclass
class _Element:
    """An element of a page; ``texts``: the first and the last of the page's text pieces inside it."""

    tag: str
    attrs: dict[str, str | None]
    parent: int
    item: int  # the element of the item that this one belongs to, or -1
    hidden: bool
    texts: list[int]


class _Page(HTMLParser):
    """Elements in document order, each with its item, as microdata defines it: the nearest element above with itemscope.

    An end tag closes the nearest open element of its name and all inside it; one that has no open element
    is skipped, which a count of open elements by name tells at once.
    """

    void = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.all: list[_Element] = []
        self.pieces: list[str] = []
        self.now, self.open = -1, Counter()
        self.feed(html)
        self.close()
        while self.now >= 0:
            self._close()

    def handle_starttag(self, tag, attrs):
        above = self.all[self.now] if self.now >= 0 else None
        item = -1 if above is None else self.now if "itemscope" in above.attrs else above.item
        own = dict(attrs)
        hidden = own.get("itemprop") == "author" or above is not None and above.hidden
        self.all.append(_Element(tag, own, self.now, item, hidden, [len(self.pieces)] * 2))
        if tag not in self.void:
            self.now = len(self.all) - 1
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self) -> str:
        element = self.all[self.now]
        element.texts[1] = len(self.pieces)
        self.open[element.tag] -= 1
        self.now = element.parent
        return element.tag

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if self.now < 0 or not self.all[self.now].hidden:
            self.pieces.append(data)

    def text(self, element: _Element) -> str:
        return "".join(self.pieces[slice(*element.texts)])

    def items(self) -> dict[int, tuple[str, dict[str, str]]]:
        """By element: the type's last part and the properties of every item outside author scopes."""
        out: dict[int, tuple[str, dict[str, str]]] = {}
        for i, e in enumerate(self.all):
            if e.hidden:
                continue
            name = e.attrs.get("itemprop")
            if "itemscope" in e.attrs:
                out[i] = ((e.attrs.get("itemtype") or "").rsplit("/", 1)[-1], {})
            elif name and e.item in out:
                held = out[e.item][1]
                if name in held:
                    raise ValueError(f"{name} is given twice")
                held[name] = (e.attrs["content"] or "") if "content" in e.attrs else self.text(e)
        return out


# --- JSON-LD -------------------------------------------------------------------


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _loaded(text: str):
    """JSON with numbers as they are spelled."""
    return json.loads(text, parse_int=str, parse_float=str, parse_constant=_no_constant)


def _spelled(value: object, name: str) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{name} is no figure: {value!r}")
    return value.strip()


def aggregate_rating(html: str) -> tuple[str, str]:
    """(ratingValue, count) of the one aggregateRating of a page, as spelled; anything else raises."""
    page, found = _Page(html), []
    for e in page.all:
        if e.tag != "script" or (e.attrs.get("type") or "").split(";")[0].strip().lower() != "application/ld+json":
            continue
        try:
            todo = [_loaded(page.text(e))]
        except ValueError:
            continue  # a block that is not JSON declares nothing
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                todo += x["@graph"] if isinstance(x.get("@graph"), list) else []
                found += [x["aggregateRating"]] if "aggregateRating" in x else []
    if len(found) != 1:
        raise ValueError(f"{len(found)} ratings on the page, one is needed")
    if not isinstance(found[0], dict) or "ratingValue" not in found[0]:
        raise ValueError("the rating has no value")
    counts = [k for k in ("ratingCount", "reviewCount") if k in found[0]]
    if len(counts) != 1:
        raise ValueError("one count is needed")
    return _spelled(found[0]["ratingValue"], "ratingValue"), _spelled(found[0][counts[0]], counts[0])


# --- microdata -----------------------------------------------------------------

_DATED = re.compile(r"([0-9]{2})/([0-9]{2})/([0-9]{4})")


def _on_scale(properties: dict[str, str], worst: str, best: str, whose: str) -> None:
    if (properties.get("worstRating", worst).strip(), properties.get("bestRating", best).strip()) != (worst, best):
        raise ValueError(f"{whose} scale is not {worst} to {best}")


def microdata(html: str) -> tuple[list[dict], dict | None]:
    """(reviews, aggregate) of a page with Review and AggregateRating items; an author's item is never read."""
    page = _Page(html)
    items = page.items()
    totals = [p for kind, p in items.values() if kind == "AggregateRating"]
    if len(totals) > 1:
        raise ValueError("more than one aggregate")
    for p in totals:
        _on_scale(p, "0", "5", "the aggregate's")
    ratings: dict[int, list[dict]] = {}
    for i, (kind, p) in items.items():
        if kind == "Rating":
            ratings.setdefault(page.all[i].item, []).append(p)
    out = []
    for i, (kind, p) in items.items():
        if kind != "Review":
            continue
        above = page.all[i].item
        while above >= 0:
            if above in items and items[above][0] == "Review":
                raise ValueError("a review inside a review")
            above = page.all[above].item
        own = ratings.get(i, [])
        if len(own) > 1:
            raise ValueError("a review with two ratings")
        for r in own:
            _on_scale(r, "1", "5", "a review's")
        rating = {**p, **(own[0] if own else {})}.get("ratingValue")
        days = ["-".join(reversed(d)) for d in _DATED.findall(p.get("datePublished", ""))]
        if not days or rating is None:
            raise ValueError(f"review {len(out)}: no date or rating")
        rating, body = rating.strip(), " ".join(p.get("reviewBody", "").split())
        own_id = hashlib.sha256("\x1f".join([days[0], days[-1], rating, body]).encode()).hexdigest()
        out.append({"external_id": own_id, "rating": rating, "review_date": days[0], "body": body})
    return out, totals[0] if totals else None


# --- the table function --------------------------------------------------------


def _listing(body: str) -> Iterator[dict]:
    value, count = aggregate_rating(body)
    yield {"kind": "snapshot", "rating": value, "review_count": count}


def _microdata(body: str) -> Iterator[dict]:
    reviews, total = microdata(body)
    yield from ({"kind": "review", **r} for r in reviews)
    if total is not None:
        yield {"kind": "snapshot", "rating": total.get("ratingValue", "").strip(), "review_count": (total.get("ratingCount") or total.get("reviewCount") or "").strip()}


def _feed(body: str) -> Iterator[dict]:
    """Reviews of a JSON feed: no entry is an empty page, an entry that is no list is refused."""
    feed = _loaded(body).get("feed") if body.lstrip().startswith("{") else None
    if not isinstance(feed, dict):
        raise ValueError("the page is no feed")
    entries = feed.get("entry", [])
    if not isinstance(entries, list):
        raise ValueError("the feed's entry is not a list")
    for n, e in enumerate(entries):
        cell = {k: e[name].get("label") if isinstance(e, dict) and isinstance(e.get(name), dict) else None for k, name in (("external_id", "id"), ("title", "title"), ("body", "content"), ("rating", "im:rating"), ("at", "updated"))}
        if not all(isinstance(v, str) for v in cell.values()):
            raise ValueError(f"entry {n} is not as declared")
        yield {"kind": "review", "review_date": cell.pop("at"), **cell}


# Header of the review export, in its order.
EXPORT = ("web_scraper_order", "web_scraper_start_url", "pagination", "headline", "name", "reviewbody", "data", "data2", "data3", "name2", "data4", "data5", "data6", "addresscountry", "data7", "image", "rating")


def _export(body: str) -> Iterator[dict]:
    """Reviews of an export: its headline, text, printed day and star image; no other column is looked at.

    The export has no ids, so a review is known by what it says.
    """
    try:
        head, *rows = list(csv.reader(io.StringIO(body.lstrip("\ufeff"), newline=""), strict=True)) or [[]]
    except csv.Error as e:
        raise ValueError(f"the page is no CSV: {e}") from e
    if tuple(head) != EXPORT:
        raise ValueError("the columns are not those of the export")
    for n, cells in enumerate((r for r in rows if r), 1):
        if len(cells) != len(EXPORT):
            raise ValueError(f"row {n}: {len(cells)} cells")
        title, text, printed, image = (cells[EXPORT.index(c)] for c in ("headline", "reviewbody", "data3", "rating"))
        day, star = re.fullmatch(r"([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})", printed), re.fullmatch(r"https://[^?#\s]+/stars-([1-5](?:\.5)?)\.svg", image)
        if not day or day[1] not in MONTHS or not star:
            raise ValueError(f"row {n}: no printed day or no star image")
        iso = f"{day[3]}-{MONTHS.index(day[1]) + 1:02d}-{int(day[2]):02d}"
        own_id = hashlib.sha256("\x1f".join([iso, title, text, star[1]]).encode()).hexdigest()
        yield {"kind": "review", "external_id": own_id, "review_date": iso, "rating": star[1], "title": title, "body": text}


PARSERS = {"jsonld": _listing, "microdata": _microdata, "feed": _feed, "export": _export}


_NAMES = [c.split()[0] for c in _PAGE.split(", ")]


def page_rows(parser: str, body: str) -> list[dict]:
    """The rows of one page by the parser that its source declares; a page is read whole or refused whole."""
    try:
        if parser not in PARSERS:
            raise ValueError(f"no parser {parser!r}")
        return list(PARSERS[parser](body or ""))
    except ValueError as e:
        return [{"kind": "refused", "error": str(e)}]


class _ParsePage:
    def eval(self, parser: str, body: str) -> Iterator[tuple]:
        for r in page_rows(parser, body):
            yield tuple(r.get(n) for n in _NAMES)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole batches of pages; the last two columns are the parser and the body, which goes."""
    for batch in batches:
        parser, body = (batch.column(k).to_pylist() for k in (batch.num_columns - 2, batch.num_columns - 1))
        found = [page_rows(*x) for x in zip(parser, body, strict=True)]
        at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
        columns = [batch.column(k).take(at) for k in range(batch.num_columns - 2)]
        columns += [pa.array([r.get(n) for rows in found for r in rows], pa.string()) for n in _NAMES]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], *_NAMES])


parse_page = F.udtf(_ParsePage, returnType=_PAGE, useArrow=True)


def parsed(pages: DataFrame, parser: str = "parser", body: str = "body") -> DataFrame:
    """The columns of ``pages`` but the body, with the rows of every page; a review's day, and all figures, checked and typed.

    A page with a figure outside its shape is refused like one that cannot be read.
    """
    kept = pages.drop(body)
    shape = StructType([*kept.schema.fields, *pages.sparkSession.createDataFrame([], _PAGE).schema.fields])
    rows = pages.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(parser).alias("_parser"), F.col(body).alias("_page")).mapInArrow(_parse, shape)
    day = F.coalesce(T.real_day(F.col("review_date")), T.printed_day(F.col("review_date")))
    rows = rows.withColumns({"_day": day, "_half": F.when(F.col("kind") == "review", T.half_step(F.col("rating"))), "_mean": F.when(F.col("kind") == "snapshot", T.page_rating(F.col("rating"))), "_count": T.count_value(F.col("review_count"))})
    bad = F.when((F.col("kind") == "review") & (F.col("_day").isNull() | F.col("_half").isNull()), F.concat(F.lit("no day or half step: "), F.concat_ws(", ", "review_date", "rating")))
    bad = bad.when((F.col("kind") == "snapshot") & (F.col("_mean").isNull() | F.col("_count").isNull()), F.concat(F.lit("no rating or count: "), F.concat_ws(", ", "rating", "review_count")))
    rows = rows.withColumns({"error": F.coalesce("error", bad), "review_date": F.col("_day")})
    return rows.withColumn("kind", F.when(F.col("error").isNotNull(), "refused").otherwise(F.col("kind"))).drop("_day", "rating", "review_count").withColumnsRenamed({"_half": "review_rating", "_mean": "rating", "_count": "review_count"})


def parse_pages(pages: DataFrame, style: str, key: str = "source_url", html: str = "body") -> DataFrame:
    """(key, kind, ...) of pages that all have one parser."""
    if style not in PARSERS:
        raise ValueError(style)
    rows = pages.select(F.col(key).cast("string").alias("key"), F.lit(style).alias("parser"), F.col(html).alias("body"))
    return parsed(rows).drop("parser")


def page_titles(pages: DataFrame) -> DataFrame:
    """Title and first heading of every page, by expressions."""
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("h1"))


# --- robots ------------------------------------------------------------------


def parse_robots(text: str) -> list[tuple[set[str], list[tuple[bool, str]]]]:
    """Groups of (agents, rules); a rule is (allow, pattern).

    A group begins with a run of user-agent lines, which any other line ends, known or not; lines
    before the first group belong to none.
    """
    groups, naming = [], False
    for line in text.lstrip("\ufeff").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not naming:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif name in ("allow", "disallow") and groups and value:
            groups[-1][1].append((name == "allow", value))
        naming = name == "user-agent"
    return groups


def names_agent(value: str, agent: str) -> bool:
    """Whether a user-agent value names us by a product token: the same, ours with more around it, or three letters of ours or more."""
    tokens, (ours, *_) = re.findall(r"[a-z_-]+", value.lower()), [*re.findall(r"[a-z_-]+", agent.lower()), ""]
    return any(len(t) > 2 and t in ours or ours and ours in t for t in tokens)


def rules_for(groups: list[tuple[set[str], list[tuple[bool, str]]]], agent: str | None) -> list[tuple[bool, str]]:
    """The rules of all groups that name us or, without an agent, everyone."""
    own = (lambda a: a == "*") if agent is None else (lambda a: names_agent(a, agent))
    return [rule for agents, rules in groups if any(map(own, agents)) for rule in rules]


def rule_matches(rule: str, path: str) -> bool:
    """Whether a rule matches a path: linear scan for each part between wildcards."""
    anchored = rule.endswith("$")
    parts = (rule[:-1] if anchored else rule).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    if len(parts) == 1:
        return not anchored or at == len(path)
    for part in parts[1:-1]:
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    last = parts[-1]
    if anchored:
        return len(path) - len(last) >= at and path.endswith(last)
    return path.find(last, at) >= 0


def robots_allows(text: str, url: str, agent: str) -> bool:
    """Allowed by the rules for the agent and by those for everyone; the longest rule wins, ties allow."""
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    groups = parse_robots(text)
    for rules in (rules_for(groups, agent), rules_for(groups, None)):
        best = max(((len(p), allow) for allow, p in rules if rule_matches(p, path)), default=(0, True))
        if not best[1]:
            return False
    return True


def rule_pattern(rule: str) -> str:
    """A rule as a regular expression in which no part is matched twice, so that many wildcards stay cheap."""
    anchored = rule.endswith("$")
    first, *rest = (rule[:-1] if anchored else rule).split("*")
    quoted = ["\\Q" + part + "\\E" if part else "" for part in rest]
    if not rest:
        return "^\\Q" + first + "\\E" + ("\\z" if anchored else "")
    inner = "".join(f"(?>.*?{part})" for part in (quoted[:-1] if anchored else quoted))
    return "(?s)^" + ("\\Q" + first + "\\E" if first else "") + inner + (f".*{quoted[-1]}\\z" if anchored else "")


def robots_path(url: Column) -> Column:
    """What rules are matched with: path and query of an address."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    return F.regexp_replace(path, r"\?$", "")


def robots_allowed(url: Column, text: str, agent: str) -> Column:
    """Allowed by the rules for the agent and by those for everyone, as an expression: the longest rule wins, ties allow."""
    path, groups, out = robots_path(url), parse_robots(text), F.lit(True)
    for rules in (rules_for(groups, agent), rules_for(groups, None)):
        hits = [F.when(path.rlike(rule_pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(allow).alias("allow"))) for allow, p in rules]
        if hits:
            best = F.array_max(F.array(*hits))
            out &= F.coalesce(best["allow"], F.lit(True))
    return F.when(url.isNotNull(), out)


def allowed_pages(pages: DataFrame, robots: str, agent: str) -> DataFrame:
    """(page_id, allowed) under one robots text; the rules are parsed once and matched in the JVM."""
    return pages.select("page_id", robots_allowed(F.col("url"), robots, agent).alias("allowed"))


_RULES = "host string, ours array<struct<pattern:string,n:int,allow:boolean>>, all array<struct<pattern:string,n:int,allow:boolean>>"


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, ours, all) of (host, text): the rules of each text as patterns, for us and for everyone."""

    def rows(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for host, text in zip(pdf["host"], pdf["text"], strict=True):
                groups = parse_robots(text or "")
                own, everyone = ([{"pattern": rule_pattern(p), "n": len(p), "allow": allow} for allow, p in rules_for(groups, a)] for a in (agent, None))
                out.append((host, own, everyone))
            yield type(pdf)(out, columns=["host", "ours", "all"])

    return robots.select("host", "text").mapInPandas(rows, _RULES)


def allowed_by_host(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, allowed): every page under the rules of its host; a host without robots text allows all.

    ``rules`` is one row a host with its patterns, so a page meets one row; the patterns are matched in the JVM.
    """
    rows = pages.select("page_id", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"), robots_path(F.col("url")).alias("path"), F.col("url").isNull().alias("none"))
    best = lambda c: F.array_max(F.transform(F.filter(c, lambda r: F.rlike(F.col("path"), r["pattern"])), lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))["allow"]
    return rows.join(rules, "host", "left").select("page_id", F.when(~F.col("none"), F.coalesce(best("ours"), F.lit(True)) & F.coalesce(best("all"), F.lit(True))).alias("allowed"))
