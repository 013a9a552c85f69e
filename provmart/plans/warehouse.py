"""Catalog reads, SQL files and their lint, and deleting what was built."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.load import Refused

# What portable SQL files do not use.
BANNED = {
    "a clock": r"\b(now|today|getdate|sysdate)\s*\(|\b(current_date|current_time|current_timestamp|localtime|localtimestamp)\b",
    "a pattern": r"\b(like|ilike|rlike|glob|similar\s+to)\b|regexp\w*|~",
    "a reader": r"\b(read_csv|read_parquet|read_json)\w*",
    "a form of one engine": r"\b(qualify|pivot|unpivot|lateral|summarize|list_value|group\s+by\s+all)\b|::",
}
#: A string, a quoted name, a comment to the line's end or between /* and */, or one other character.
_TOKEN = re.compile(r"(?P<string>'(?:[^']|'')*')|(?P<name>\"(?:[^\"]|\"\")*\")|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<end>;)|.", re.S)


def stripped_sql(text: str) -> str:
    """SQL with comments as a space and strings and quoted names emptied, in one pass, so that what they say is not judged."""
    return "".join(" " if m["comment"] else "''" if m["string"] else '""' if m["name"] else m[0] for m in _TOKEN.finditer(text))


def lint(text: str) -> list[str]:
    """What a SQL file uses that it should not, one line each."""
    plain = stripped_sql(text)
    return [f"{why}: {' '.join(m.group().split())}" for why, pattern in BANNED.items() for m in re.finditer(pattern, plain, re.I)]


def statements(text: str) -> list[str]:
    """Statements of a file; a semicolon inside a string, a quoted name or a comment ends none."""
    parts, at = [], 0
    for m in _TOKEN.finditer(text):
        if m["end"]:
            parts.append(text[at : m.start()])
            at = m.end()
    return [p.strip() for p in [*parts, text[at:]] if stripped_sql(p).strip()]


def run_sql(spark: SparkSession, text: str) -> list[DataFrame]:
    return [spark.sql(s) for s in statements(text)]


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    if not spark.catalog.tableExists(table):
        raise Refused(f"{table}: no such table")
    return [(f.name, f.dataType.simpleString()) for f in spark.table(table).schema.fields]


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a built table or store; False if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
