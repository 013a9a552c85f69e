"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so
changed case, punctuation and line breaks do not hide a passage.  Shared ``seed``-word
sequences join texts with benchmark items.  For each pair the longest common run of words
that are not yet marked on either side becomes a tile (of equal ones the first in the text,
then in the item), again and again until none of ``seed`` words is left.  Each round finds
the greatest length that both sides share by running Karp-Rabin hashes over all unmarked
runs of a length, and marks the equal runs of that length that do not overlap.  The tiles'
share of the item is its coverage; since tiles may lie in any order, reordered passages are
caught too.  A pair takes memory in proportion to its two texts, however often they
repeat a word.

The benchmark is read in blocks of bounded size; each block is sent to all tasks and
costs one pass over the texts.  With several blocks each pass is written before the next
begins, so one block at a time is held.  Texts are never shuffled.

Defined cases: null and empty texts and items match nothing; items of fewer than
``seed`` words are compared whole (a text that holds all their words in a row covers
them fully).  A null item id is kept as null.  Repeated rows give repeated results.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

SEED, COVERAGE = 4, 0.5
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
_FOUND = "coverage double, tiles int, longest int, matched int"


class _Side:
    """Words of one side by their hashes, and which of them are marked."""

    def __init__(self, words: np.ndarray, marked: np.ndarray | None = None):
        n = len(words)
        up, self.down = C.powers(C._Q, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.total[1:])
        self.marked = np.zeros(n, bool) if marked is None else marked
        self.measure()

    def measure(self) -> None:
        """The unmarked words from each place to the next marked one."""
        n = len(self.marked)
        stop = np.where(self.marked, np.arange(n), n)
        self.free = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
        self.most = int(self.free.max(initial=0))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of all unmarked runs of a length."""
        at = np.flatnonzero(self.free >= size)
        return (self.total[at + size] - self.total[at]) * self.down[at], at


def greedy_tiles(item: np.ndarray, text: np.ndarray, k: int, marked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of two sequences of word hashes; ``marked`` words of the text take no part."""
    a, b, tiles = _Side(item), _Side(text, marked), []
    most = min(a.most, b.most)
    while most >= k:
        low, high, guess = k - 1, most, most
        while low < high:  # the greatest length both sides share
            if len(np.intersect1d(a.windows(guess)[0], b.windows(guess)[0])):
                low = guess
            else:
                high = guess - 1
            guess = (low + high + 1) // 2
        if low < k:
            break
        (ha, pa_), (hb, tb) = a.windows(low), b.windows(low)
        order = np.argsort(ha, kind="stable")
        ha, pa_ = ha[order], pa_[order]
        first, last = np.searchsorted(ha, hb), np.searchsorted(ha, hb, "right")
        after: dict[int, int] = {}  # the places of one hash in the item are gone through once
        for t, x, end in zip(*(y[first < last].tolist() for y in (tb, first, last)), strict=True):
            if b.marked[t] or b.marked[t + low - 1]:  # runs of one length overlap at an end
                continue
            at = after.get(x, x)
            while at < end and (a.marked[pa_[at]] or a.marked[pa_[at] + low - 1]):
                at += 1
            if at < end:
                p = int(pa_[at])
                a.marked[p : p + low] = b.marked[t : t + low] = True
                tiles.append((p, t, low))
                at += 1
            after[x] = at
        a.measure(), b.measure()
        most = min(low - 1, a.most, b.most)
    return tiles


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where the list of each begins and ends, its distinct values, and how often each occurs."""
    pairs, n = np.unique(np.stack([keys, values.astype(np.uint64)], 1), axis=0, return_counts=True) if len(keys) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    some, at = np.unique(pairs[:, 0], return_index=True)
    return some, np.append(at, len(pairs)), pairs[:, 1].astype(np.int64), n


class Block:
    """Items by the hashes of their k-word sequences (and shorter items whole)."""

    def __init__(self, ids: list, texts: list[str], k: int):
        self.ids, self.k, base = ids, k, 0
        seeds, item, self.words = [], [], []
        short: dict[int, tuple[list, list]] = {}
        for _, _, w in C.word_chunks(pa.array(texts, pa.string()), True, C.NOT_ALNUM):
            h, start = w.hashes(), w.windows(k)
            edge = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
            seeds.append(C.span_hash(h, start, start + k, C._Q)), item.append(w.doc[start] + base)
            for d in np.flatnonzero((w.count > 0) & (w.count < k)).tolist():
                n = int(w.count[d])
                whole, items = short.setdefault(n, ([], []))
                whole.append(C.span_hash(h, edge[d : d + 1], edge[d : d + 1] + n, C._Q)[0]), items.append(d + base)
            self.words += [h[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
            base += w.n_docs
        seeds, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, item))
        self.seed, self.edge, self.item, self.places = _lists(seeds.astype(np.uint64), item)
        # of each item: the numbers of its seeds
        number = np.repeat(np.arange(len(self.seed)), np.diff(self.edge))
        order = np.argsort(self.item, kind="stable")
        self.own, self.own_edge = number[order], np.searchsorted(self.item[order], np.arange(len(ids) + 1))
        self.short = {n: _lists(np.array(whole, np.uint64), np.array(items)) for n, (whole, items) in short.items()}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, key: np.ndarray) -> np.ndarray:
        """The number of each seed, or -1."""
        out = np.full(len(key), -1, np.int64)
        some = np.flatnonzero(self.maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.seed, key[some]), max(0, len(self.seed) - 1))
        hit = self.seed[at] == key[some] if len(self.seed) else np.zeros(0, bool)
        out[some[hit]] = at[hit]
        return out

    def short_hits(self, w: C.Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, words) of the short items that occur whole."""
        for n, (whole, edge, items, _) in self.short.items():
            start = w.windows(n)
            key = C.span_hash(h, start, start + n, C._Q)
            at = np.minimum(np.searchsorted(whole, key), len(whole) - 1)
            hit = whole[at] == key
            for d, x in np.unique(np.stack([w.doc[start[hit]], at[hit]], 1), axis=0).tolist():
                for i in items[edge[x] : edge[x + 1]].tolist():
                    yield d, i, n

    def candidates(self, doc: np.ndarray, number: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(text, item) where the seeds shared could cover enough of the item: each place of one covers k words at most."""
        hit = number >= 0
        pairs = np.unique(np.stack([doc[hit], number[hit]], 1), axis=0)
        n = self.edge[pairs[:, 1] + 1] - self.edge[pairs[:, 1]]
        at = np.repeat(self.edge[pairs[:, 1]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(pairs) else np.zeros(0, np.int64)
        key = np.repeat(pairs[:, 0], n) * len(self.ids) + self.item[at]
        some, back = np.unique(key, return_inverse=True)
        most = np.bincount(back, self.places[at], len(some)) * self.k
        for x, most_ in zip(some.tolist(), most.tolist(), strict=True):
            d, i = divmod(x, len(self.ids))
            if most_ >= coverage * len(self.words[i]):
                yield d, i


def _tile(batches: Iterator[pa.RecordBatch], block, coverage: float, item: pa.DataType) -> Iterator[pa.RecordBatch]:
    b: Block = block.value
    k = b.k
    for batch in batches:
        rows, out = [], []
        for lo, _, w in C.word_chunks(batch.column("_text"), True, C.NOT_ALNUM):
            h = w.hashes()
            for d, i, n in b.short_hits(w, h):
                rows.append(lo + d), out.append((b.ids[i], 1.0, 1, n, n))
            start = w.windows(k)
            doc, number = w.doc[start], b.numbers(C.span_hash(h, start, start + k, C._Q))
            edge = np.searchsorted(doc, np.arange(w.n_docs + 1))
            for d, i in b.candidates(doc, number, coverage):
                mine = slice(edge[d], edge[d + 1])
                shared = start[mine][np.isin(number[mine], b.own[b.own_edge[i] : b.own_edge[i + 1]])]
                # only words in shared seeds can be matched; one marked word stands for those between
                first = int(shared[0])
                step = np.zeros(int(shared[-1]) - first + k + 1, np.int32)
                step[shared - first] += 1
                step[shared - first + k] -= 1
                covered = np.cumsum(step[:-1]) > 0
                keep = covered | np.concatenate([[False], covered[:-1]])
                words = h[first : first + len(covered)][keep]
                tiles = greedy_tiles(b.words[i], words, k, ~covered[keep])
                matched = sum(n for _, _, n in tiles)
                if matched >= coverage * len(b.words[i]):
                    rows.append(lo + d), out.append((b.ids[i], matched / len(b.words[i]), len(tiles), max(n for _, _, n in tiles), matched))
        if rows:
            taken = batch.take(pa.array(rows, pa.int64()))
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [taken.column(i) for i in kept] + [pa.array(cols[0], item), pa.array(cols[1], pa.float64())] + [pa.array(c, pa.int32()) for c in cols[2:]],
                [batch.schema.names[i] for i in kept] + ["item_id", "coverage", "tiles", "longest", "matched"],
            )


def blocks(benchmark: DataFrame, bytes_: int, item_id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of bounded size, fetched one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        ids.append(r.i), texts.append(r.t)
        size += len(r.t)
        if size >= bytes_:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def tiled(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest, matched) of every pair at or above the coverage."""
    spark, out = docs.sparkSession, None
    C.narrow_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = benchmark.schema[item_id].dataType
    schema, item = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, {_FOUND}", to_arrow_type(kind)
    parts = blocks(benchmark, block_bytes, item_id, item_text)
    now = next(parts, None)
    while now:
        after = next(parts, None)
        shared = spark.sparkContext.broadcast(Block(*now, seed))
        part = rows.mapInArrow(lambda it, s=shared: _tile(it, s, coverage, item), schema)
        if out is not None or after:  # one block at a time is held
            part = C.materialize(part, "tiles")
            shared.destroy()
        out = part if out is None else out.union(part)
        now = after
    return out if out is not None else spark.createDataFrame([], schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tiled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
