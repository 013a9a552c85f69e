"""How the sources of a language differ in their words: pairs of sources, and the words that mark one.

Counting: a task splits its texts into terms, numbers them in a radix trie over bytes and counts
for every leaf how often each source has it and in how many documents.  A trie that holds
``TRIE_LEAVES`` terms, ``COUNTERS`` counters or ``TERM_BYTES`` of terms is handed on and a new one
begun, so memory is bounded; a frequent word is one row for each trie, however often it occurs.

Merging: partial tries are dealt by prefix ranges (splitters sampled from the first bytes of their
terms; as many as rows, counters and bytes ask for), and a task merges its range in a trie: leaves of the same term add their counters.  Terms
in fewer than ``MIN_DOCS`` documents of their language go; the others are written.

Audit: totals of all groups come first, as every share depends on them.  Then the ranges are read
again; for each term present in a source the distance to all sources of the language is added
to sums over pairs, and pairs of sources that both lack a term add a constant for each
such term, which is counted, not walked.  A task sends its sums and ten candidates of each
group.  Work follows the (term, source) counters times the sources of the language, as the result
follows the square of the sources.  Where that square is beyond ``SUM_CELLS``, the sources are cut into
stripes, each with its own tasks and the terms that it has, so a task holds three long for each of
``SUM_CELLS`` pairs at most.

Defined cases: null text, lang and source are ''; a group without terms, or of a language without kept
terms, takes part; values tie by the item's UTF-8 bytes; a row that repeats is a document more; an
empty table gives an empty result.  Extra columns are not read.  All figures are integers; counts
beyond nine thousand million take Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Terms of a partial trie, and sums over pairs that a task holds.
TRIE_LEAVES, SUM_CELLS = 400_000, 4_000_000
#: Counters of a partial trie or a prefix range, and bytes of their terms.
COUNTERS, TERM_BYTES = 3_000_000, 64 << 20
#: Rows of partial tries in a prefix range, and the bytes that a range is cut by.
RANGE_ROWS, PREFIX = 200_000, 16
#: Rows, and bytes of terms and counters, that a task emits at once.
EMIT_ROWS, EMIT_BYTES = 50_000, 16 << 20
#: Pairs of sources that a task makes.
PAIR_ROWS = 1_000_000
#: Text that is split into terms at once.
CHUNK_BYTES = 8 << 20
#: Bound of a broadcast table of groups or languages.
GROUPS_BYTES = 32 << 20
SEPARATOR = np.array([not (chr(i).isalpha() and i < 128 or i > 127) for i in range(256)])
_TRIE = "lang string, term string, docs long, sids array<int>, counts array<long>"
_SUMS = "part int, lang string, a int, b int, item string, x long, y long, z long"
_GROUP_BITS = np.int64(24)


@dataclass(frozen=True)
class Limits:
    """What a task holds before it hands on."""

    leaves: int = TRIE_LEAVES
    cells: int = SUM_CELLS
    counters: int = COUNTERS
    term_bytes: int = TERM_BYTES


class Trie:
    """A radix trie over bytes; leaves are numbered as they come.  A node is [label, children, leaf]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.size = self.bytes = 0

    def add(self, term: bytes) -> int:
        node, at, end = self.root, 0, len(term)
        while at < end:
            child = node[1].get(term[at]) if node[1] else None
            if child is None:
                node[1] = node[1] or {}
                child = node[1][term[at]] = [term[at:], None, -1]
                at = end
            elif term.startswith(child[0], at):
                at += len(child[0])
            else:  # the label is cut where the term leaves it
                label, k = child[0], 1
                while at + k < end and label[k] == term[at + k]:
                    k += 1
                middle = [label[:k], {label[k]: child}, -1]
                child[0] = label[k:]
                node[1][term[at]] = child = middle
                at += k
            node = child
        if node[2] < 0:
            node[2] = self.size
            self.size += 1
            self.bytes += end
        return node[2]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in the order of bytes, which is UTF-8's."""
        todo = [(self.root, b"")]
        while todo:
            node, before = todo.pop()
            term = before + node[0]
            if node[2] >= 0:
                yield term, node[2]
            if node[1]:
                todo += [(node[1][c], term) for c in sorted(node[1], reverse=True)]


class Counters:
    """A trie with (count, documents) for every leaf and group; a group is (lang, source number)."""

    def __init__(self) -> None:
        self.trie, self.groups, self.held, self.rows = Trie(), {}, [], 0

    def group(self, lang: str, sid: int) -> int:
        return self.groups.setdefault((lang, sid), len(self.groups))

    def add(self, leaves: np.ndarray, groups: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        self.held.append(((leaves.astype(np.int64) << _GROUP_BITS) | groups, counts, docs))
        self.rows += len(leaves)
        if len(self.held) > 1 and self.rows > 4 * len(self.held[0][0]) + 1_000_000:
            self.settle()

    def full(self, limits: Limits) -> bool:
        if self.trie.size >= limits.leaves or self.trie.bytes >= limits.term_bytes:
            return True
        if self.rows >= 2 * limits.counters:
            self.settle()
            return self.rows >= limits.counters
        return False

    def settle(self) -> None:
        """Add up the counters of the same leaf and group."""
        keys, counts, docs = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.held = [(keys[starts], np.add.reduceat(counts[order], starts), np.add.reduceat(docs[order], starts))]
        self.rows = len(starts)

    def emit(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """Rows of (lang, term) in at least ``least`` documents, terms in the order of bytes; then it is empty."""
        if self.rows:
            self.settle()
            keys, counts, docs = self.held[0]
            terms, at = [], np.empty(self.trie.size, np.int64)
            for k, (term, leaf) in enumerate(self.trie.walk()):
                terms.append(term)
                at[leaf] = k
            langs = sorted({lang for lang, _ in self.groups})
            lang_of = np.array([langs.index(lang) for lang, _ in self.groups])
            sid_of = np.array([sid for _, sid in self.groups])
            group = keys & ((1 << _GROUP_BITS) - 1)
            place, lang, sid = at[keys >> _GROUP_BITS], lang_of[group], sid_of[group]
            order = np.lexsort((sid, lang, place))
            place, lang, sid, counts, docs = place[order], lang[order], sid[order], counts[order], docs[order]
            starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (lang[1:] != lang[:-1])]))
            total = np.add.reduceat(docs, starts)
            ends = np.append(starts[1:], len(place))
            keep = np.flatnonzero(total >= least)
            weight = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms))[place[starts[keep]]] + 12 * (ends - starts)[keep])
            terms, langs = pa.array(terms, pa.binary()), pa.array(langs, pa.string())
            hi = 0
            while hi < len(keep):
                lo, before = hi, int(weight[hi - 1]) if hi else 0
                hi = min(lo + EMIT_ROWS, max(lo + 1, int(np.searchsorted(weight, before + EMIT_BYTES, "right"))))
                k = keep[lo:hi]
                size = ends[k] - starts[k]
                offsets = np.concatenate([[0], np.cumsum(size)])
                flat = np.repeat(starts[k] - offsets[:-1], size) + np.arange(offsets[-1])
                where = pa.array(offsets.astype(np.int32))
                columns = [langs.take(pa.array(lang[starts[k]])), terms.take(pa.array(place[starts[k]])).cast(pa.string()), pa.array(total[k])]
                lists = [pa.ListArray.from_arrays(where, pa.array(sid[flat].astype(np.int32))), pa.ListArray.from_arrays(where, pa.array(counts[flat]))]
                yield pa.RecordBatch.from_arrays(columns + lists, ["lang", "term", "docs", "sids", "counts"])
        groups = self.groups
        self.__init__()
        self.groups = groups


def _count(limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Counters()
    for batch in batches:
        groups = np.array([held.group(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        for lo, _, w in C.word_chunks(batch.column(2), lower=True, separator=SEPARATOR, size=CHUNK_BYTES):
            n = len(w.start)
            if not n:
                continue
            letters = np.ascontiguousarray(w.data[~SEPARATOR[w.data]])
            offsets = np.concatenate([[0], np.cumsum(w.end - w.start)])
            terms = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
            codes = terms.indices.to_numpy().astype(np.int64)
            leaves = np.fromiter((held.trie.add(t) for t in terms.dictionary.to_pylist()), np.int64, len(terms.dictionary))
            width = len(leaves)
            pairs, counts = np.unique(w.doc * width + codes, return_counts=True)  # (document, term)
            held.add(leaves[pairs % width], groups[lo + pairs // width], counts, np.ones(len(pairs), np.int64))
            if held.full(limits):
                yield from held.emit()
    yield from held.emit()
    C.give_back()


def _merge(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Counters()
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, terms, docs, sids, counts = batch.columns
        size = np.diff(sids.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        names = langs.dictionary_encode()
        sid = sids.flatten().to_numpy().astype(np.int64)
        key, back = np.unique((names.indices.to_numpy().astype(np.int64)[row] << 32) | sid, return_inverse=True)
        names = names.dictionary.to_pylist()
        codes = np.array([held.group(names[k >> 32], k & 0xFFFFFFFF) for k in key.tolist()], np.int64)
        leaves = np.fromiter((held.trie.add(t) for t in terms.cast(pa.binary()).to_pylist()), np.int64, batch.num_rows)
        first = np.concatenate([[True], row[1:] != row[:-1]])  # the documents of a row count once
        held.add(leaves[row], codes[back], counts.flatten().to_numpy(), np.where(first, docs.to_numpy()[row], 0))
    yield from held.emit(least)
    C.give_back()


# -------------------------------------------------------------------- audit


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exactly."""
    if len(counts) and int(counts.max()) >= 9_000_000_000:
        return np.array([1 + SCALE * (c + 2) // t for c, t in zip(counts.tolist(), total.tolist(), strict=True)], np.int64)
    return 1 + SCALE * (counts + 2) // total


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _blocks(n: int, width: int, cells: int) -> Iterator[slice]:
    step = max(1, cells // (4 * max(1, width)))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


class Sums:
    """Sums over pairs of sources, and the best terms of each group, of what a task has walked."""

    def __init__(self, top: int, cells: int):
        self.top, self.cells, self.pairs, self.best = top, cells, {}, {}

    def walk(self, lang: str, first: int, width: int, kept: int, of_all: int, sizes: np.ndarray, terms: list[str], row: np.ndarray, sid: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counters (row, sid, count) of ``terms``; ``sizes``: kept occurrences of each source; sources from ``first`` on, ``width`` of them, are walked."""
        n, s = len(terms), len(sizes)
        total = np.add.reduceat(count, np.flatnonzero(np.diff(row, prepend=-1)))
        whole = share(total, np.full(n, of_all + 2 * kept))
        p = share(count, sizes[sid] + 2 * kept)
        own = (sid >= first) & (sid < first + width)
        self._candidates(lang, terms, row[own], sid[own], p[own], whole)
        lacking = share(np.zeros(s, np.int64), sizes + 2 * kept)
        width = min(width, s - first)
        if (lang, first) not in self.pairs and width * s + sum(x[0].size for x in self.pairs.values()) > self.cells:
            yield from self.hand_on()
        sums = self.pairs.setdefault((lang, first), [np.zeros((width, s), np.int64) for _ in range(3)])
        order = np.argsort(sid, kind="stable")
        for cut in _blocks(n, s, self.cells):  # some terms at a time, over all sources
            inside = order[(row[order] >= cut.start) & (row[order] < cut.stop)]
            there = np.zeros((cut.stop - cut.start, s), bool)
            dense = np.repeat(lacking[None, :], cut.stop - cut.start, 0)
            there[row[inside] - cut.start, sid[inside]] = True
            dense[row[inside] - cut.start, sid[inside]] = p[inside]
            inside = inside[own[inside]]
            for part in _blocks(len(inside), s, self.cells):
                k = inside[part]
                f = distance(p[k][:, None], dense[row[k] - cut.start])
                none = ~there[row[k] - cut.start]
                starts = np.flatnonzero(np.diff(sid[k], prepend=-1))
                at = sid[k][starts] - first
                for out, values in zip(sums, (f, np.where(none, f, 0), none.astype(np.int64)), strict=True):
                    out[at] += np.add.reduceat(values, starts, axis=0)

    def _candidates(self, lang: str, terms: list[str], row: np.ndarray, sid: np.ndarray, p: np.ndarray, whole: np.ndarray) -> None:
        k = np.flatnonzero(p > whole[row])
        value = distance(p[k], whole[row[k]])
        order = np.lexsort((row[k], -value, sid[k]))  # the terms come in the order of bytes
        k, value = k[order], value[order]
        edge = np.append(np.flatnonzero(np.diff(sid[k], prepend=-1)), len(k))
        for a, b in zip(edge, edge[1:], strict=False):  # none where no share is above the language's
            found = [(-int(v), terms[r].encode()) for v, r in zip(value[a : min(b, a + self.top)], row[k[a : min(b, a + self.top)]], strict=True)]
            key = (lang, int(sid[k[a]]))
            self.best[key] = sorted(self.best.get(key, []) + found)[: self.top]

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        for (lang, first), (x, y, z) in self.pairs.items():
            a, b = np.nonzero(~np.eye(*x.shape, first, dtype=bool) & ((x != 0) | (z != 0)))
            for lo in range(0, len(a), 100_000):
                i, j = a[lo : lo + 100_000], b[lo : lo + 100_000]
                n = len(i)
                yield _sums(np.zeros(n, np.int32), [lang] * n, i + first, j, [None] * n, x[i, j], y[i, j], z[i, j])
        self.pairs = {}

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.hand_on()
        rows = iter([(lang, sid, term.decode(), -v) for (lang, sid), best in self.best.items() for v, term in best])
        while some := list(islice(rows, 50_000)):
            lang, sid, term, value = zip(*some, strict=True)
            zero = np.zeros(len(some), np.int64)
            yield _sums(np.ones(len(some), np.int32), lang, np.array(sid), zero, term, np.array(value, np.int64), zero, zero)


def _sums(part, lang, a, b, item, x, y, z) -> pa.RecordBatch:
    columns = [pa.array(part), pa.array(lang, pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(item, pa.string()), pa.array(x), pa.array(y), pa.array(z)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SUMS.split(", ")])


def _audit(top: int, cells: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept terms of (lang, first, term, sids, counts, width, kept, of_all, sizes)."""
    found = Sums(top, cells)
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).sort_by([("lang", "ascending"), ("first", "ascending"), ("term", "ascending")]).combine_chunks()
        langs = list(zip(table.column("lang").to_pylist(), table.column("first").to_pylist(), strict=True))
        edge = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            own = table.slice(lo, hi - lo).combine_chunks()
            sids, counts = own.column("sids").combine_chunks(), own.column("counts").combine_chunks()
            size = np.diff(sids.offsets.to_numpy())
            sizes = np.array(own.column("sizes")[0].as_py(), np.int64)
            yield from found.walk(*langs[lo], own.column("width")[0].as_py(), own.column("kept")[0].as_py(), own.column("of_all")[0].as_py(), sizes, own.column("term").to_pylist(), np.repeat(np.arange(hi - lo), size), sids.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())
    yield from found.end()
    C.give_back()


def kept_terms(docs: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS, limits: Limits = Limits()) -> DataFrame:
    """(lang, term, docs, sids, counts) of the terms in at least ``min_docs`` documents of a language: a work table."""
    C.narrow_batches(docs.sparkSession)
    rows = docs.join(C.small_side(groups.select("lang", "source", "sid"), GROUPS_BYTES, 64), ["lang", "source"])
    found, seen = rows.select("lang", "sid", "text").mapInArrow(lambda it: _count(limits, it), _TRIE), Observation()
    sized = found.observe(seen, F.count("*").alias("rows"), F.sum(F.size("sids")).alias("counters"), F.sum(F.octet_length("term")).alias("bytes"))
    partial = C.materialize(sized, "tries")
    most = {"rows": RANGE_ROWS, "counters": limits.counters, "bytes": limits.term_bytes}
    cut = partial.repartitionByRange(max(1, *(-(-(seen.get[k] or 0) // n) for k, n in most.items())), F.substring(F.col("term").cast("binary"), 1, PREFIX), F.xxhash64("term"))
    out = C.materialize(cut.mapInArrow(lambda it: _merge(min_docs, it), _TRIE), "terms")
    C.drop(partial)
    return out


def striped(terms: DataFrame, by_lang: DataFrame, cells: int) -> DataFrame:
    """``terms`` with first and width of the sources that a task walks; a term goes to the stripes that have it."""
    sources = F.size("sizes")
    width = F.when(sources.cast("long") * sources <= cells, sources).otherwise(F.greatest(F.lit(1), F.expr(f"CAST({cells} DIV size(sizes) AS INT)")))
    cut = by_lang.select("lang", sources.alias("n"), width.alias("width"))
    stripes = cut.select("lang", "width", F.explode(F.expr("sequence(0, n - 1, width)")).alias("first"))
    n = by_lang.agg(F.coalesce(F.max(F.ceil(sources / width)), F.lit(0)).alias("n")).first().n
    if n <= 1:
        return terms.join(F.broadcast(stripes), "lang")
    spread = terms.join(F.broadcast(stripes), "lang").where("exists(sids, x -> x >= first AND x < first + width)")
    parts = max(1, -(-terms.count() // RANGE_ROWS))
    return spread.repartition(n * parts, "lang", "first", F.pmod(F.xxhash64("term"), F.lit(parts))).sortWithinPartitions("lang", "first")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, limits: Limits = Limits()) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(own(lang).alias("lang"), own(source).alias("source"), own(text).alias("text"))
    names = docs.select("lang", "source").distinct()
    groups = C.materialize(names.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    terms = kept_terms(docs, groups, min_docs, limits)

    pairs = terms.select("lang", F.explode(F.arrays_zip("sids", "counts")).alias("c")).select("lang", F.col("c.sids").alias("sid"), F.col("c.counts").alias("count"))
    totals = pairs.groupBy("lang", "sid").agg(F.sum("count").alias("size"), F.count("*").alias("terms"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("of_all"))
    known = groups.join(totals, ["lang", "sid"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "kept", "of_all"])
    known = C.materialize(known, "totals")
    by_lang = known.groupBy("lang", "kept", "of_all").agg(F.sort_array(F.collect_list(F.struct("sid", "size"))).alias("s")).select("lang", "kept", "of_all", F.col("s.size").alias("sizes"))
    by_lang = C.materialize(by_lang, "langs")
    # the sizes of a language are as many as its sources: the count of groups bounds the broadcast
    side = F.broadcast(by_lang) if groups.count() * 64 <= GROUPS_BYTES else by_lang
    dealt = striped(terms.select("lang", "term", "sids", "counts"), by_lang, limits.cells)
    walked = C.materialize(dealt.join(side, "lang").mapInArrow(lambda it: _audit(top, limits.cells, it), _SUMS), "sums")

    sums = C.materialize(walked.where("part = 0").groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in "xyz"]), "pairs")
    side = lambda c: known.select("lang", F.col("sid").alias(c), F.col("source").alias(f"source_{c}"), F.col("size").alias(f"size_{c}"), F.col("terms").alias(f"terms_{c}"), F.col("kept").alias(f"kept_{c}"))
    pairs = by_lang.agg(F.sum(F.size("sizes").cast("long") * F.size("sizes")).alias("n")).first().n or 0
    a = side("a").repartition(-(-pairs // PAIR_ROWS), "lang", "a") if pairs > PAIR_ROWS else side("a")
    b = F.broadcast(side("b")) if known.count() * 64 <= GROUPS_BYTES else side("b")
    both = a.join(b, "lang").where("a <> b")
    both = both.join(sums, ["lang", "a", "b"], "left").join(sums.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("y").alias("back"), F.col("z").alias("lacked")), ["lang", "a", "b"], "left").na.fill(0, ["x", "back", "lacked"])
    for c in "ab":  # the share of a term that the source lacks
        both = both.withColumn(f"p_{c}", F.expr(f"1 + {2 * SCALE}L DIV greatest(1L, size_{c} + 2 * kept_a)"))
    value = F.expr("x + back + (kept_a - terms_a - lacked) * ((p_a - p_b) * (p_a - p_b) DIV (p_a + p_b))")
    out = both.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = out.withColumn("rank", F.row_number().over(order))
    best = walked.where("part = 1").select("lang", F.col("a").alias("sid"), "item", F.col("x").alias("value"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "sid").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    best = best.join(known, ["lang", "sid"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    C.drop(terms)
    return out.union(best)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
