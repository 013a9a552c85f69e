"""Strict CSV in one scan: quoted records that are cut by file splits, every rule of a reader at once.

Files are read as lines, which Spark splits anywhere.  A line belongs to a block (one split of one
file); a task joins the lines of its blocks to records by counting quotes.  Whether a block
begins inside a quoted cell depends on all blocks before it, so the first pass takes it that none does
and counts the quotes of every block along the way.  If each has an even number that was right, and the
scan was the only one.  Otherwise the parities are summed along each file (one small row a
block) and a second pass reads with them; what a block has of a record that began earlier, and
the open end of its last record, are pieces that are joined by the block where the record begins.

Rules are expressions that say which rows to refuse.  They are observed while the rows are
written aside, so a reader runs one job over its input and refuses with the first bad row
in file order, for the first rule that any row breaks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import work
from ..operators.load import Refused

RECORD, OPEN, REST, BLOCK = 0, 1, 2, 3
_PIECES = "file string, block long, line long, kind int, text string, odd int"
#: Bound of a broadcast of blocks that begin inside a quoted cell.
BLOCKS_BYTES = 16 << 20

Rule = tuple[str, Column, tuple[str, ...]]


class _Block:
    """Lines of one split to records; ``inside``: it begins in a quoted cell of a record that began earlier."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.line, self.odd = file, block, 0, 0
        self.held: list[str] = []
        self.inside = self.rest = inside
        self.began = 0

    def _piece(self, kind: int) -> tuple:
        out = self.file, self.block, self.began, kind, "\n".join(self.held), None
        self.held, self.rest = [], False
        return out

    def add(self, line: str) -> Iterator[tuple]:
        if not self.held:
            self.began = self.line
        self.line += 1
        self.held.append(line)
        if line.count('"') % 2:
            self.odd, self.inside = 1 - self.odd, not self.inside
        if not self.inside:
            yield self._piece(REST if self.rest else RECORD)

    def end(self) -> Iterator[tuple]:
        if self.held:  # a block that is all inside one cell is a rest that stays open
            yield self._piece(REST if self.rest else OPEN)
        yield self.file, self.block, self.line, BLOCK, None, self.odd


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
    now, out = None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for rows in batches:
        for text, file, block, inside in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if now is None or (now.file, now.block) != (file, block):
                out += now.end() if now else ()
                now = _Block(file, block, bool(inside))
            out += now.add(text)
        if out:
            yield batch()
            out = []
    if now:
        out += now.end()
        yield batch()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _parities(pieces: DataFrame) -> DataFrame:
    """(file, block, inside, begins): where a block begins inside a cell, and the block in which that record began."""
    blocks = pieces.where(F.col("kind") == BLOCK).select("file", "block", "odd")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1
    return blocks.withColumn("inside", inside).withColumn("ends_inside", F.col("inside") != (F.col("odd") == 1))


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that span blocks, from their pieces; a record is few pieces, however many there are."""
    own = pieces.where(F.col("kind").isin(OPEN, REST)).select("file", "block", "line", "kind", "text")
    # a rest belongs to the last record that was left open before it
    starts = Window.partitionBy("file").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("at", F.last(F.when(F.col("kind") == OPEN, F.struct("block", "line")), ignorenulls=True).over(starts))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda p: p["text"]), "\n")
    return own.groupBy("file", "at").agg(text.alias("text")).select("file", F.col("at.block").alias("block"), F.col("at.line").alias("line"), "text")


def _plain(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """Records if no block begins inside a cell, and what says whether that is so."""
    seen = Observation()
    odd = F.count_if((F.col("kind") == BLOCK) & (F.col("odd") == 1))
    pieces = lines.withColumn("inside", F.lit(False)).mapInArrow(_pieces, _PIECES).observe(seen, odd.alias("odd"))
    return pieces.where(F.col("kind") == RECORD).select("file", "block", "line", "text"), seen


def _careful(lines: DataFrame, path: str) -> DataFrame:
    """Records where blocks begin inside cells: parities first, then the pieces."""
    counted = work.stored(lines.withColumn("inside", F.lit(False)).mapInArrow(_pieces, _PIECES).where(F.col("kind") == BLOCK), "quotes")
    blocks = work.stored(_parities(counted), "blocks")
    work.forget(counted)
    if bad := blocks.groupBy("file").agg(F.max_by("ends_inside", "block").alias("open")).where("open").first():
        raise Refused(f"{path}: a quoted cell of {bad.file} does not end")
    inside = blocks.where("inside").select("file", "block", "inside")
    if inside.count() * 200 <= BLOCKS_BYTES:
        marked = lines.join(F.broadcast(inside), ["file", "block"], "left")
    else:  # a shuffle join loses the order of lines
        placed = lines.withColumn("_n", F.monotonically_increasing_id()).join(inside, ["file", "block"], "left")
        marked = placed.repartition("file", "block").sortWithinPartitions("file", "block", "_n")
    pieces = work.stored(marked.select("value", "file", "block", "inside").mapInArrow(_pieces, _PIECES), "pieces")
    return pieces.where(F.col("kind") == RECORD).select("file", "block", "line", "text").union(_joined(pieces))


def _ended(rows: DataFrame) -> DataFrame:
    """Without the carriage return of a line end, and without blank lines."""
    text = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return rows.select("file", "block", "line", text.alias("text")).where("text <> ''")


def _cells(rows: DataFrame, line: str, names: Sequence[str], columns: Sequence[str], sep: str) -> DataFrame:
    """The declared columns as text, ``ordinal``, and ``_broken`` where a header differs or a row has too few or too many cells."""
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": "_broken"}
    schema = ", ".join([*(f"`{n}` string" for n in names), "_broken string"])
    is_head = (F.col("block") == 0) & (F.col("line") == 0)
    rows = _ended(rows).withColumn("_c", F.from_csv("text", schema, options))
    other = is_head & (F.ltrim(F.col("text"), F.lit("\ufeff")) != line)
    broken = F.when(other, F.lit("another header")).when(~is_head & F.col("_c._broken").isNotNull(), F.lit("number of cells"))
    rows = rows.where(~is_head | other)
    return rows.select(*[F.col("_c")[c].alias(c) for c in columns], F.struct("file", "block", "line").alias("ordinal"), broken.alias("_broken"))


Shape = Callable[[DataFrame], tuple[DataFrame, Sequence[Rule]]]


def read(spark: SparkSession, path: str, columns: Sequence[str], shape: Shape = lambda rows: (rows, ()), sep: str = ",", exact: bool = True) -> DataFrame:
    """Rows of CSV files as a work table: the declared columns as text, made into what ``shape`` says, with ``ordinal`` (file, block, line).

    Every file has to have the header of the first one, which has to be (or hold) the declared columns; a
    row with another number of cells, and one that breaks a rule of ``shape``, refuses the read.
    """
    lines = _lines(spark, path)
    head = lines.select("value").limit(1).first()
    line = (head.value if head else "").lstrip("\ufeff").rstrip("\r")
    names = line_cells(spark, line, sep)
    if (tuple(names) != tuple(columns)) if exact else not set(columns) <= set(names) or len(set(names)) < len(names):
        raise Refused(f"{path}: header {names}, declared {list(columns)}")
    rows, seen = _plain(lines)
    out, refusal = _observed(*shape(_cells(rows, line, names, columns, sep)))
    if seen.get["odd"]:  # some block begins inside a cell: what was read is not what is there
        work.forget(out)
        out, refusal = _observed(*shape(_cells(_careful(lines, path), line, names, columns, sep)))
    if why := refusal():
        work.forget(out)
        raise Refused(f"{path}: {why}")
    return out


def line_cells(spark: SparkSession, line: str, sep: str) -> list[str]:
    """The cells of one line, by the same reader as all others."""
    if not line:
        return []
    n = line.count(sep) + 1
    row = spark.createDataFrame([(line,)], "v string").select(F.from_csv("v", F.lit(", ".join(f"c{i} string" for i in range(n))), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}).alias("c")).first()
    return [c.strip() for c in row.c if c is not None]


def _observed(rows: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, Callable[[], str | None]]:
    """``rows`` written aside while every rule is observed, and the first row in file order that breaks the first rule.

    A rule is (what it says, the condition of rows to refuse, the columns to show).
    """
    rules = [("the row is not as declared", F.col("_broken").isNotNull(), ("_broken",)), *rules]
    seen = Observation()
    first = [F.min(F.when(F.coalesce(bad, F.lit(False)), F.struct("ordinal", *[F.col(c).cast("string").alias(f"s{k}") for k, c in enumerate(show)]))).alias(f"r{i}") for i, (_, bad, show) in enumerate(rules)]
    out = work.stored(rows.observe(seen, *first).drop("_broken"), "rows")

    def refusal() -> str | None:
        for i, (says, _, show) in enumerate(rules):
            if row := seen.get.get(f"r{i}"):
                at = row["ordinal"]
                return f"{says}: {', '.join(f'{c}={row[f"s{k}"]!r}' for k, c in enumerate(show))} in {at['file'].rsplit('/', 1)[-1]}, line {at['line'] + 1} from byte {at['block']}"
        return None

    return out, refusal
