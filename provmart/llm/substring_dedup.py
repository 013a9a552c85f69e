"""Substring dedup: Rabin-Karp hashes of every token window, counted in Spark.

1. Every window of ``width`` consecutive words gets a rolling polynomial hash
   (64 bits), and a second, independent one that chooses its fragment.
2. Spark groups the hashes by fragment and counts them; a window whose hash
   occurs twice or more, in one text or several, is repeated.
3. Repeated windows of a text merge into maximal removal intervals.

A fragment holds the hashes of about 8 MiB of text whatever the corpus size.
Hashes travel in blocks of one fragment of one input batch; positions inside a block
are gaps of two bytes.  A window that occurs twice or more within a batch is known to be
repeated: its positions stay with the batch, and its hash travels once, marked as such.
So a passage that a third of all texts share sends one hash for each of its windows and
batch of ``_GATHER`` words, not one for each text.
Two different windows are taken for equal only if both hashes agree (64 bits plus
the fragment's): about n * 1.2e6 / 2**65 expected cases for n windows.

Null and empty texts have no words.  Texts with fewer than ``width`` words have
no window.  Repeated rows (same id and text) are repeated text like any other, and
each such row gets its result.  Extra columns pass through ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 35
_BLOCK = "frag int, batch long, head binary, known binary, firm binary, keys binary, at binary"
_SPANS = "_key long, _id long, _words long, _removed long, _spans binary"
#: Words a block batch gathers before it is sent.
_GATHER = 700_000
#: Bound of a broadcast interval table; beyond it the texts are shuffled to their intervals.
BROADCAST_BYTES = 32 << 20


def _windows(batches: Iterator[pa.RecordBatch], width: int, n_frag: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    batch_id = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    words = 0

    def flush():
        nonlocal held, words, batch_id
        keys, frags, at, head, base = [], [], [], [], 0
        for k, f, a, h, n in held:
            keys.append(k), frags.append(f), at.append(a + base), head.append(h)
            base += n
        keys, frags, at = np.concatenate(keys), np.concatenate(frags), np.concatenate(at)
        order = np.lexsort((frags, keys))
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = (keys[order][1:] != keys[order][:-1]) | (frags[order][1:] != frags[order][:-1])
        single = np.empty(len(keys), bool)
        single[order] = new[1:] & new[:-1]
        firm = order[new[:-1] & ~new[1:]]  # one of each that occurs more than once
        firm_order, firm_edge = C.cut(frags[firm], n_frag)
        firm = keys[firm][firm_order]
        known = np.sort(at[~single])
        keys, frags, at = keys[single], frags[single], at[single]
        order, edge = C.cut(frags, n_frag)
        keys, at = keys[order], at[order]
        used = np.flatnonzero(np.diff(edge) + np.diff(firm_edge))
        home = int(batch_id >> 32) % n_frag
        rows = sorted({*used.tolist(), home})
        top = np.concatenate(head, axis=1).astype("<i8").tobytes()
        for i in range(0, len(rows), 64):
            some = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([batch_id] * len(some), pa.int64()),
                    pa.array([top if f == home else None for f in some], pa.binary()),
                    pa.array([C.pack_rising(known) if f == home else None for f in some], pa.binary()),
                    pa.array([firm[firm_edge[f] : firm_edge[f + 1]].astype("<u8").tobytes() for f in some], pa.binary()),
                    pa.array([keys[edge[f] : edge[f + 1]].astype("<u8").tobytes() for f in some], pa.binary()),
                    pa.array([C.pack_rising(at[edge[f] : edge[f + 1]]) for f in some], pa.binary()),
                ],
                ["frag", "batch", "head", "known", "firm", "keys", "at"],
            )
        held, words = [], 0
        batch_id += 1
        C.give_back()

    for batch in batches:
        row_key, doc_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo, hi, w in C.word_chunks(batch.column(2)):
            h, start = w.hashes(), w.windows(width)
            key = C.span_hash(h, start, start + width, C._Q)
            frag = (C.span_hash(h, start, start + width, C._R) >> np.uint64(40)).astype(np.int64) & (n_frag - 1)
            head = np.stack([row_key[lo:hi], doc_id[lo:hi], w.count])
            held.append((key, frag, start, head, len(h)))
            words += len(h)
            if words >= _GATHER:
                yield from flush()
    if held:
        yield from flush()


def _repeated(table: pa.Table) -> pa.Table:
    """One fragment: the positions, by batch, of hashes that occur more than once or are firm in a batch."""
    C.give_back()
    blocks = [np.frombuffer(b.as_py(), "<u8") for b in table.column("keys")]
    keys = np.concatenate(blocks)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    firm = np.unique(np.concatenate([np.frombuffer(b.as_py(), "<u8") for b in table.column("firm")]))
    hit = firm[np.minimum(np.searchsorted(firm, ranked), len(firm) - 1)] == ranked if len(firm) else np.zeros(len(keys), bool)
    twice = np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1] | hit
    out, lo = [], 0
    for b, at in zip(blocks, table.column("at"), strict=True):
        hit = twice[lo : lo + len(b)]
        out.append(C.pack_rising(C.unpack_rising(at.as_py())[hit]) if hit.any() else None)
        lo += len(b)
    keep = pa.array([i for i, x in enumerate(out) if x is not None or table.column("head")[i].is_valid], pa.int64())
    return pa.table({"batch": table.column("batch").take(keep), "head": table.column("head").take(keep), "known": table.column("known").take(keep), "at": pa.array([out[i] for i in keep.to_pylist()], pa.binary())})


def _intervals(table: pa.Table, width: int) -> pa.Table:
    """One input batch: repeated windows merged into maximal word intervals of each text."""
    C.give_back()
    head = next(h.as_py() for h in table.column("head") if h.is_valid)
    row_key, doc_id, count = np.frombuffer(head, "<i8").reshape(3, -1)
    total, begin = int(count.sum()), np.concatenate([[0], np.cumsum(count)])
    step = np.zeros(total + 1, np.int32)
    for x in (*table.column("at"), *table.column("known")):
        if x.is_valid:
            start = C.unpack_rising(x.as_py())
            step[start] += 1
            step[start + width] -= 1
    covered = np.zeros(total + 2, bool)
    covered[1:-1] = np.cumsum(step[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(covered[1:-1])])
    removed = sums[begin[1:]] - sums[begin[:-1]]
    spans = []
    for i in range(len(count)):
        if not removed[i]:
            spans.append(None)
            continue
        own = np.zeros(count[i] + 2, np.int8)
        own[1:-1] = covered[begin[i] + 1 : begin[i + 1] + 1]
        edge = np.diff(own)
        spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype("<u4").tobytes())
    return pa.table({"_key": pa.array(row_key), "_id": pa.array(doc_id), "_words": pa.array(count), "_removed": pa.array(removed.astype(np.int64)), "_spans": pa.array(spans, pa.binary())})


def intervals(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: _key (hash of the row's id and text), _id, _words, _removed, _spans (pairs of word ordinals)."""
    C.narrow_batches(docs.sparkSession)
    n_frag = C.fragment_count(C.text_bytes(docs, text))
    rows = docs.select(row_key(doc_id, text).alias("_key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_id"), F.col(text).alias("_text"))
    blocks = rows.mapInArrow(lambda it: _windows(it, width, n_frag), _BLOCK)
    hits = blocks.groupBy("frag").applyInArrow(_repeated, "batch long, head binary, known binary, at binary")
    return hits.groupBy("batch").applyInArrow(lambda t: _intervals(t, width), _SPANS)


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def _cut_texts(batches: Iterator[pa.RecordBatch], text: str, digest: bool) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 512):
            batch = big.slice(lo, 512)
            at = batch.schema.names.index(text)
            whole = batch.column(at).to_pylist()
            kept, words = [], []
            for t, spans in zip(whole, batch.column("_spans").to_pylist(), strict=True):
                if spans is None and not digest:
                    kept.append(t)
                    continue
                w = (t or "").encode().split()
                words.append(len(w))
                if spans:
                    parts, last = [], 0
                    for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
                        parts += w[last:a]
                        last = b
                    w = parts + w[last:]
                kept.append(b" ".join(w))
            if digest:
                new = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
                rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (text, "_spans")]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(words, pa.int64()), new], [n for n, _ in rest] + ["n_words", "kept_sha256"])
            else:
                new = pa.array([x.decode() if isinstance(x, bytes) else x for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "_spans"], [n for n in batch.schema.names if n != "_spans"])


def _joined(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    found = C.materialize(intervals(docs, width, text, doc_id).where("_removed > 0").select("_key", "_removed", "_spans").dropDuplicates(["_key"]), "intervals")
    size = found.agg(F.coalesce(F.sum(F.octet_length("_spans") + 48), F.lit(0)).alias("n")).first().n
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    return docs.withColumn("_key", row_key(doc_id, text)).join(side, "_key", "left").withColumn("_removed", F.coalesce("_removed", F.lit(0)).cast("long")).drop("_key")


def dedup(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from the text, and n_removed (words).

    A text without repeats stays as it is, byte for byte; of the others the kept
    words are joined by one space.
    """
    docs = docs.drop("n_removed")
    out = _joined(docs, width, text, doc_id)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "_spans")
    return out.mapInArrow(lambda it: _cut_texts(it, text, False), kept).withColumnRenamed("_removed", "n_removed")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _joined(docs, WIDTH, "text", "doc_id").mapInArrow(lambda it: _cut_texts(it, "text", True), "doc_id long, _removed long, n_words long, kept_sha256 string")
    return out.select("doc_id", "n_words", F.col("_removed").alias("n_removed"), "kept_sha256")
