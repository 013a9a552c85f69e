"""Serving: panel contract, allow-list, corpus gate, report and sinks of small marts."""

from __future__ import annotations

import html
import re
import sqlite3
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.load import Refused
from ..sources.artifacts import write_sorted

TAGS = ("Measured", "Documented", "Modeled", "Pending")


@dataclass
class Point:
    label: str
    value: float | None = None
    tag: str = "Measured"
    absent: str | None = None


@dataclass
class Panel:
    id: str
    kind: str
    title: str
    points: list[Point] = field(default_factory=list)
    markers: list[float] = field(default_factory=list)
    grid: list[float] = field(default_factory=list)
    note: str = ""
    links: list[str] = field(default_factory=list)


def check_panel(p: Panel) -> Panel:
    """One tag per number, a value or a stated absence, nothing pending with a value, markers on the grid."""
    for x in p.points:
        if x.tag not in TAGS:
            raise Refused(f"{p.id}: tag {x.tag!r}")
        if (x.value is None) == (x.absent is None):
            raise Refused(f"{p.id}/{x.label}: a value or an absence")
        if x.tag == "Pending" and x.value is not None:
            raise Refused(f"{p.id}/{x.label}: a pending number has a value")
    if not set(p.markers) <= set(p.grid):
        raise Refused(f"{p.id}: a marker is off the grid")
    for link in p.links:
        if not (web_address(link) or repository_file(link)):
            raise Refused(f"{p.id}: {link!r} is no web address and no file of the repository")
    return p


def web_address(text: str) -> bool:
    """http or https with a host, and nothing that ends an attribute or begins a line."""
    parts = urlsplit(text)
    return parts.scheme in ("http", "https") and bool(parts.hostname) and not re.search(r"[\s\"'<>]", text)


def repository_file(text: str) -> bool:
    """A relative path of plain names without a step up."""
    steps = text.split("/")
    return all(re.fullmatch(r"[A-Za-z0-9_.-]+", s) and s != ".." for s in steps)


def served(df: DataFrame, allowed: set[str], most: int = 4000) -> list:
    """Rows of a small mart whose columns are all on the allow-list."""
    if extra := set(df.columns) - allowed:
        raise Refused(f"columns that are not served: {sorted(extra)}")
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise Refused(f"more than {most} rows")
    return rows


def corpus_gate(df: DataFrame, known: dict[str, str], column: str = "run_id") -> str:
    """Exactly one run id of a closed set decides what a panel says; none at all is 'no data'."""
    runs = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if not runs:
        return "no data"
    if len(runs) > 1 or runs[0] not in known:
        raise Refused(f"run ids {runs}")
    return known[runs[0]]


def gate_states(df: DataFrame, known: dict[str, str], by: list[str], column: str = "run_id") -> DataFrame:
    """(by, state, runs): the gate of many corpora in one aggregate; 'refused' where a corpus has two run ids or an unknown one."""
    runs = df.groupBy(*by).agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count_distinct(column).alias("runs"))
    state = F.when(F.col("first") != F.col("last"), "refused").when(F.col("first").isNull(), "no data")
    for run, says in known.items():
        state = state.when(F.col("first") == run, says)
    return runs.select(*by, state.otherwise("refused").alias("state"), "runs")


def render(panels: list[Panel]) -> str:
    """The report: one section per panel, everything escaped."""
    out = []
    for p in map(check_panel, panels):
        rows = "".join(f"<tr><th>{html.escape(x.label)}</th><td>{html.escape(x.absent or f'{x.value:g}')}</td><td>{x.tag}</td></tr>" for x in p.points)
        note = f"<p>{html.escape(p.note)}</p>" if p.note else ""
        links = "".join(f'<a href="{html.escape(x, True)}">{html.escape(x)}</a> ' for x in p.links)
        out.append(f'<section id="{html.escape(p.id, True)}" class="{html.escape(p.kind, True)}"><h2>{html.escape(p.title)}</h2>{note}<table>{rows}</table>{links}</section>')
    return "<!doctype html><meta charset=utf-8>" + "".join(out)


def export_sqlite(marts: dict[str, DataFrame], path: str, forbidden: set[str]) -> None:
    """Marts into a SQLite file; text columns that may identify a person never leave. Decimals are exact strings."""
    db = sqlite3.connect(path)
    with db:
        for name, df in marts.items():
            if bad := forbidden & set(df.columns):
                raise Refused(f"{name}: {sorted(bad)} must not be exported")
            plain = df.select(*[F.col(f.name).cast("string") if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields])
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" ({", ".join(chr(34) + c + chr(34) for c in df.columns)})')
            # one partition at a time, all in one transaction
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in plain.toLocalIterator()))
    db.close()


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A table as one sorted, byte-stable CSV file."""
    write_sorted(df, path, order)
