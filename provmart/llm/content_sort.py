"""Exact dedup by content: rows sorted by their texts, equal neighbours compared in full.

The exchange deals rows by sampled splitters over (first ``PREFIX`` bytes, digest, id): splitters are small
however long the texts are, texts that share a long beginning are still spread, and a group of
copies that holds most rows is cut at its ids.  Inside a range Spark sorts by (first bytes, digest, text, id
descending), on disk where memory does not suffice; so equal texts are neighbours and the row that stays leads them.

Equality is decided by comparing neighbouring texts whole, never by digests.  Runs inside a range
are finished by the task that reads them and keep only ids in memory.  The first and the last run of a range may go on in the
next range: their text is kept once, compared with the neighbour's, and chains of equal runs are
summed in a table of at most two rows a range, without the texts.

Defined cases: null counts as the empty text; nulls in the id come after all ids, and if every id
of a group is null so is ``keep_id``; of rows that repeat the id that stays, one is kept; an
empty table gives an empty result; extra columns are not read.  Texts are compared byte
by byte after ``normalise``, which by default changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PREFIX = 64
#: Text of a range beyond the session's number of shuffle partitions.
RANGE_BYTES = 256 << 20
#: Bound of a broadcast table of first and last runs.
EDGES_BYTES = 32 << 20
FIRST, LAST = 1, 2


class Runs:
    """Runs of equal texts in a sorted stream; the last one is open until another text or the end comes."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.text: pa.Scalar | None = None
        self.ids: list[pa.Array] = []
        self.digest: pa.Scalar | None = None
        self.part: int = 0
        self.any_closed = False

    def read(self, part: int, ids: pa.Array, digests: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """The rows of all runs that end in this batch."""
        n, self.part = len(ids), part
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.text is None or self.text.as_py() != texts[0].as_py()
        starts = np.flatnonzero(new)
        if not len(starts):
            self.ids.append(ids)
            return
        if starts[0]:
            self.ids.append(ids.slice(0, starts[0]))
        yield from self.close()
        # runs that begin and end in this batch
        a, b = int(starts[0]), int(starts[-1])
        if a < b:
            lengths = np.diff(starts)
            first = not self.any_closed
            yield self._rows(ids.slice(a, b - a), digests.slice(a, b - a), starts[:-1] - a, lengths, FIRST if first else 0, texts[a] if first else None)
            self.any_closed = True
        # a copy, so that the batch can go
        self.text, self.digest = pa.scalar(texts[b].as_py(), texts.type), pa.scalar(digests[b].as_py(), pa.binary())
        self.ids = [pa.concat_arrays([ids.slice(b)])]

    def close(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows of the open run."""
        if self.text is not None:
            ids = pa.concat_arrays(self.ids)
            digests = pa.array([self.digest.as_py()], pa.binary()).take(pa.array(np.zeros(len(ids), np.int64)))
            edge = (0 if self.any_closed else FIRST) | (LAST if end else 0)
            yield self._rows(ids, digests, np.zeros(1, np.int64), np.array([len(ids)]), edge, self.text if edge else None)
            self.any_closed = True
        self.text, self.ids = None, []

    def _rows(self, ids: pa.Array, digests: pa.Array, starts: np.ndarray, lengths: np.ndarray, edge: int, text: pa.Scalar | None) -> pa.RecordBatch:
        """Rows of whole runs; ``edge`` and its text belong to the first of them."""
        n = len(ids)
        lead = np.repeat(starts, lengths)
        edges = np.zeros(n, np.int32)
        edges[: lengths[0]] = edge
        mark = pa.array([text.as_py() if text is not None else None], pa.string()).take(pa.array([0] + [None] * (n - 1), pa.int64()))
        columns = [ids, digests.cast(pa.binary()), ids.take(pa.array(lead)), pa.array(np.repeat(lengths, lengths), pa.int64()), pa.array(lead == np.arange(n)), pa.array(np.full(n, self.part, np.int32)), pa.array(edges), mark]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "keep_id", "group_size", "kept", "part", "edge", "edge_text"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = None
    for batch in batches:
        if batch.num_rows:
            runs = runs or Runs(batch.column(1).type)
            yield from runs.read(batch.column(0)[0].as_py(), *batch.columns[1:])
    if runs:
        yield from runs.close(end=True)
    C.give_back()


def sorted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per document as far as its range knows: see ``Runs``."""
    C.narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(normalise(F.col(text)), F.lit("")).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-C.text_bytes(rows) // RANGE_BYTES))
    rows = rows.select("doc_id", F.substring(F.col("text").cast("binary"), 1, PREFIX).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    last = F.col("doc_id").desc_nulls_last()
    cut = rows.repartitionByRange(parts, "head", "digest", last).sortWithinPartitions("head", "digest", "text", last)
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = cut.select(F.spark_partition_id().alias("part"), "doc_id", "digest", "text").mapInArrow(_neighbours, f"doc_id {kind}, digest binary, keep_id {kind}, group_size long, kept boolean, part int, edge int, edge_text string")
    return C.materialize(made, "content")


def joined_edges(found: DataFrame) -> DataFrame:
    """(part, edge, keep_id, group_size, leads) of first and last runs, with the runs of all ranges that hold the same text.

    Neighbours are met by an equi-join on range numbers; the order of ranges and the chains are windows over
    at most two rows a range without texts.
    """
    ends = found.where("edge_text IS NOT NULL")
    order = Window.orderBy("part")
    parts = ends.select("part").distinct().select("part", F.lag("part").over(order).alias("before"))
    first = ends.where(F.col("edge").bitwiseAND(FIRST) > 0).select("part", F.col("edge_text").alias("this"))
    last = ends.where(F.col("edge").bitwiseAND(LAST) > 0).select(F.col("part").alias("before"), F.col("edge_text").alias("that"))
    met = first.join(parts, "part").join(last, "before").where("this = that").select("part", F.lit(True).alias("goes_on"))
    runs = ends.select("part", "edge", "keep_id", "group_size").join(met, "part", "left")
    begins = F.when(F.col("goes_on") & (F.col("edge").bitwiseAND(FIRST) > 0), 0).otherwise(1)
    chain = C.materialize(runs.withColumn("chain", F.sum(begins).over(Window.orderBy("part", "edge"))).drop("goes_on"), "chains")
    whole = Window.partitionBy("chain")
    out = chain.select("part", "edge", F.first("keep_id").over(whole.orderBy("part", "edge")).alias("keep"), F.sum("group_size").over(whole).alias("size"), (F.row_number().over(whole.orderBy("part", "edge")) == 1).alias("leads"))
    out = C.materialize(out, "edges")
    C.drop(chain)
    return out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; of equal texts the row with the largest id is kept."""
    found = sorted_runs(docs, doc_id, text, normalise)
    edges = joined_edges(found)
    rows = found.drop("edge_text").join(C.small_side(edges, EDGES_BYTES, 48), ["part", "edge"], "left")
    keep = F.when(F.col("leads").isNull(), F.col("keep_id")).otherwise(F.col("keep"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("size", "group_size").alias("group_size"), (F.col("kept") & F.coalesce("leads", F.lit(True))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
