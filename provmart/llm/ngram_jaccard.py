"""N-gram Jaccard self-join by vertical partitioning.

1. *Counts.*  Distinct n-grams of every text (48 hash bits) go to fragments by
   hash; each fragment counts in how many texts its n-grams occur and sends back
   only the shared ones (two texts or more).  A text whose shared n-grams cannot
   reach the threshold has no partner and leaves here: random prose leaves early.
   An n-gram that ``OFTEN`` texts of a batch hold sends its hash and count once for the
   batch; which texts hold it stays with the batch.
2. *Global order.*  Rarest first: (floor(log2 count), hash).  The order is cut into
   fragments (count class, two leading hash bits); a text's n-grams become one
   short segment per fragment.
3. *Candidates.*  Two sets at or above the threshold share an n-gram of their
   prefixes in the global order, and their overlap is at most the shared n-grams
   from the first common one on (positional filter).  Sets of one size that share the
   same n-grams with others have the same links to all other sets, and are first folded to
   one row (they link with each other if the shared part suffices, and else meet through
   any link that their row has).  Then (a) every set is paired with the set that represents most of its
   prefix n-grams (an n-gram is represented by the set whose n-grams occur in most
   texts, so the original of a group of near copies, not a copy), which costs a group
   one pair per member; (b) after those links are joined into components, all pairs
   that share a prefix n-gram, pass the filter and lie in different components, less those whose part sizes by hash
   rule the overlap out.  Pairs inside a component are never listed.
4. *Partial overlaps.*  For each candidate pair the segments of each fragment are
   intersected separately and the counts summed per pair.  Segments are most of what would be
   shuffled, so a set that is in no pair, or is folded into another row, is left out where it lies,
   by a broadcast of the fewer rows (a shuffle join beyond its bound).

No link between two components is lost: (b) is the whole prefix-filter join
between components.  Components come from alternating stars in DataFrames.

Defined cases: null, empty or word-free text has size 0 and links with nothing;
fewer words than ``n`` give one shingle (the whole sequence).  Rows that repeat an
id count as one document per row but share the id's component.  A null id is its
own document with a null component.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

N, PERCENT = 5, 75
#: Parts by hash whose sizes bound an overlap before it is counted.
BINS = 64
#: Texts of a batch that hold an n-gram from which its count travels instead of its places.
OFTEN = 8
#: Bound of a broadcast of the rows that pairs name.
ENDS_BYTES = 32 << 20
#: Sets of one n-gram that a block of the pairing holds on one side.
PAIRED = 1000
_BLOCK = "frag int, batch long, head binary, own binary, own_at binary, often binary, times binary, keys binary, at binary"
_ROWS = "row long, id long, n int, shared int, sizes array<int>, segments array<struct<frag:int,grams:array<bigint>>>"
_GATHER = 700_000


def shingles(w: C.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    h, start = w.hashes(), w.windows(n)
    key, doc = C.span_hash(h, start, start + n, C._Q), w.doc[start]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        first = np.searchsorted(w.doc, short)
        key = np.concatenate([key, C.span_hash(h, first, first + w.count[short], C._Q)])
        doc = np.concatenate([doc, short])
    key >>= np.uint64(16)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def _scatter(batches: Iterator[pa.RecordBatch], n: int, n_frag: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    batch_id = TaskContext.get().partitionId() << 32
    shift = np.uint64(48 - (n_frag.bit_length() - 1))
    held: list[tuple] = []
    size = 0

    def flush():
        nonlocal held, size, batch_id
        base, doc, key, head = 0, [], [], []
        for d, k, h in held:
            doc.append(d + base), key.append(k), head.append(h)
            base += h.shape[1]
        doc, key = np.concatenate(doc), np.concatenate(key)
        order = np.lexsort((doc, key))
        ranked = key[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        many = times >= OFTEN
        own = np.repeat(many, times)
        own_key, own_doc = ranked[own], doc[order][own]
        often, times = ranked[first[many]], times[many].astype("<u4")
        often_edge = np.searchsorted(often >> shift, np.arange(n_frag + 1, dtype=np.uint64))
        by_doc = np.argsort(own_doc, kind="stable")  # places have to rise
        own_key, own_doc = own_key[by_doc], own_doc[by_doc]
        single = np.empty(len(key), bool)
        single[order] = ~own
        doc, key = doc[single], key[single]
        frag = (key >> shift).astype(np.int64)
        order, edge = C.cut(frag, n_frag)
        key, doc = key[order], doc[order].astype("<u4")
        home = int(batch_id >> 32) % n_frag
        rows = sorted({*np.flatnonzero(np.diff(edge) + np.diff(often_edge)).tolist(), home})
        top = np.concatenate(head, axis=1).astype("<i8").tobytes()
        for i in range(0, len(rows), 64):
            some = rows[i : i + 64]
            part = [slice(edge[f], edge[f + 1]) for f in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([batch_id] * len(some), pa.int64()),
                    pa.array([top if f == home else None for f in some], pa.binary()),
                    pa.array([C.pack48(own_key) if f == home else None for f in some], pa.binary()),
                    pa.array([C.pack_rising(own_doc.astype(np.int64)) if f == home else None for f in some], pa.binary()),
                    pa.array([C.pack48(often[often_edge[f] : often_edge[f + 1]]) for f in some], pa.binary()),
                    pa.array([times[often_edge[f] : often_edge[f + 1]].tobytes() for f in some], pa.binary()),
                    pa.array([C.pack48(key[p]) for p in part], pa.binary()),
                    pa.array([C.pack_rising(doc[p].astype(np.int64)) for p in part], pa.binary()),
                ],
                ["frag", "batch", "head", "own", "own_at", "often", "times", "keys", "at"],
            )
        held, size = [], 0
        batch_id += 1
        C.give_back()

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, w in C.word_chunks(batch.column(1), lower=True):
            doc, key = shingles(w, n)
            held.append((doc, key, np.stack([ids[lo:hi], np.bincount(doc, minlength=hi - lo)])))
            size += len(key) + 64 * (hi - lo)
            if size >= _GATHER:
                yield from flush()
    if held:
        yield from flush()


def _count(table: pa.Table) -> pa.Table:
    """One fragment: shared n-grams, by batch, with their count class; ``often`` ones without places."""
    C.give_back()
    blocks = [C.unpack48(b.as_py()) for b in table.column("keys")]
    heavy = [C.unpack48(b.as_py()) for b in table.column("often")]
    times = [np.frombuffer(b.as_py(), "<u4") for b in table.column("times")]
    at_heavy = sum(map(len, blocks))
    keys = np.concatenate(blocks + heavy)
    weight = np.concatenate([np.ones(at_heavy, np.int64), *times])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(first) - 1
    count = np.empty(len(keys), np.int64)
    count[order] = np.bincount(group, weight[order]).astype(np.int64)[group] if len(keys) else 0
    out, lo = [], 0
    for b, h, at in zip(blocks, heavy, table.column("at"), strict=True):
        own = count[lo : lo + len(b)]
        lo += len(b)
        hit = own > 1
        found = (C.pack48(b[hit]), C.pack_rising(C.unpack_rising(at.as_py())[hit]), np.log2(own[hit]).astype(np.uint8).tobytes()) if hit.any() else (None,) * 3
        levels = np.log2(count[at_heavy : at_heavy + len(h)]).astype(np.uint8)
        at_heavy += len(h)
        out.append(found + ((C.pack48(h), levels.tobytes()) if len(h) else (None,) * 2))
    keep = pa.array([i for i, x in enumerate(out) if x[0] is not None or x[3] is not None or table.column("head")[i].is_valid], pa.int64())
    return pa.table(
        {c: table.column(c).take(keep) for c in ("batch", "head", "own", "own_at")}
        | {c: pa.array([out[i][k] for i in keep.to_pylist()], pa.binary()) for k, c in enumerate(("keys", "at", "level", "often", "often_level"))}
    )


def _gather(table: pa.Table, percent: int) -> pa.Table:
    """One input batch: each text's size, and its shared n-grams as segments of the global order."""
    C.give_back()
    head = next(h.as_py() for h in table.column("head") if h.is_valid)
    ids, sizes = np.frombuffer(head, "<i8").reshape(2, -1)
    batch = table.column("batch")[0].as_py()
    got = [(C.unpack48(k.as_py()), C.unpack_rising(a.as_py()), np.frombuffer(v.as_py(), np.uint8)) for k, a, v in zip(table.column("keys"), table.column("at"), table.column("level"), strict=True) if k.is_valid]
    key, doc, level = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    many = [(C.unpack48(k.as_py()), np.frombuffer(v.as_py(), np.uint8)) for k, v in zip(table.column("often"), table.column("often_level"), strict=True) if k.is_valid]
    if many:  # n-grams that many texts of the batch hold, and the count classes they got
        own, own_at = next((o.as_py(), t.as_py()) for o, t, h in zip(table.column("own"), table.column("own_at"), table.column("head"), strict=True) if h.is_valid)
        often, often_level = (np.concatenate(x) for x in zip(*many, strict=True))
        order, own = np.argsort(often), C.unpack48(own)
        key, doc = np.concatenate([key, own]), np.concatenate([doc, C.unpack_rising(own_at)])
        level = np.concatenate([level, often_level[order][np.searchsorted(often[order], own)]])
    shared = np.bincount(doc, minlength=len(ids))
    live = (shared * 100 >= sizes * percent) & (sizes > 0)
    keep = live[doc]
    key, doc, level = key[keep], doc[keep], level[keep].astype(np.int64)
    order = np.lexsort((key, level, doc))
    key, doc = key[order].astype(np.int64), doc[order]
    frag = level[order] * 4 + (key >> 46)
    change = np.ones(len(key), bool)
    change[1:] = (frag[1:] != frag[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(change)
    segment = pa.StructArray.from_arrays(
        [pa.array(frag[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), pa.array(key))], ["frag", "grams"]
    )
    bins = np.bincount(doc * BINS + (key >> 42), minlength=len(ids) * BINS).astype(np.int32)
    sizes_at = np.concatenate([[0], np.cumsum(live * BINS)]).astype(np.int32)
    spread = pa.ListArray.from_arrays(pa.array(sizes_at), pa.array(bins[np.repeat(live, BINS)]))
    edge = np.searchsorted(doc[at], np.arange(len(ids) + 1)).astype(np.int32)
    # the batch counts in its upper bits by partition; texts by their place in it
    row = (np.int64(batch >> 32) << 40) + (np.int64(batch & 0xFFFFFFFF) << 24) + np.arange(len(ids))
    return pa.table({"row": pa.array(row), "id": pa.array(ids), "n": pa.array(sizes.astype(np.int32)), "shared": pa.array(np.where(live, shared, -1).astype(np.int32)), "sizes": spread, "segments": pa.ListArray.from_arrays(pa.array(edge), segment)})


def shared_grams(docs: DataFrame, n: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """Per row: id (the smallest long for null), set size, shared n-grams (-1: no partner possible), segments."""
    C.narrow_batches(docs.sparkSession)
    n_frag = C.fragment_count(C.text_bytes(docs, text))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text).alias("t"))
    blocks = rows.mapInArrow(lambda it: _scatter(it, n, n_frag), _BLOCK)
    counted = blocks.groupBy("frag").applyInArrow(_count, "batch long, head binary, own binary, own_at binary, keys binary, at binary, level binary, often binary, often_level binary")
    return counted.groupBy("batch").applyInArrow(lambda t: _gather(t, percent), _ROWS)


def folded(near: DataFrame, member: DataFrame) -> DataFrame:
    """The rows of ``near`` that stand for others or for themselves; ``member`` is a work table."""
    rep, other = (member.where(f"row {sign} rep").select("row") for sign in ("=", "<>"))
    kept = rep.count()
    if member.count() - kept < kept:
        return near.join(C.one_side(other, member.count() - kept, 16, "other"), "row", "left_anti")
    return near.join(C.one_side(rep, kept, 16, "rep"), "row", "left_semi")


def of_pairs(sets: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """(row, frag, grams) of the sets on one side of ``pairs``; of all sets if the rows are too many for a broadcast."""
    rows = C.materialize(pairs.select(F.col(side).alias("row")).distinct(), "ends")
    if rows.count() * 16 <= ENDS_BYTES:
        sets = sets.join(F.broadcast(rows), "row", "left_semi")
    return sets.select("row", F.explode("segments").alias("s")).select("row", "s.frag", "s.grams")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) whose overlap, counted by fragment and summed, reaches the threshold; ``pairs`` is a work table."""
    left = of_pairs(sets, pairs, "a").select(F.col("row").alias("a"), "frag", F.col("grams").alias("ga"))
    right = of_pairs(sets, pairs, "b").select(F.col("row").alias("b"), "frag", F.col("grams").alias("gb"))
    part = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    total = part.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("both"))
    return total.where(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b")


def links(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links between sets by row, membership: row -> row of sets with the same links).

    Sets of one size with the same shared n-grams have the same overlap with every other set.
    They overlap each other in just these n-grams; where that is too little for a link among
    them, they are joined only if their row has a link to another set.
    """
    near = found.where("shared > 0")
    member = C.materialize(near.select("row", "n", "shared", F.md5(F.to_json("segments")).alias("mark")), "member")
    first = member.groupBy("mark", "n").agg(F.min("row").alias("rep"))
    first = C.one_side(first, member.count(), 64, "first")
    member = C.materialize(member.join(first, ["mark", "n"]).select("row", "rep", F.expr(f"100 * shared >= {percent} * (2 * n - shared)").alias("alike")), "rep")
    sets = C.materialize(folded(near, member).select("row", "n", "shared", "sizes", "segments"), "sets")

    # the prefix over the global order; n-grams of one text only come first and are skipped
    length = F.expr(f"n - CAST(ceil(n * {percent} / 100) AS INT) + 1 - (n - shared)")
    hub = F.expr("aggregate(segments, 0D, (a, s) -> a + size(s.grams) * (s.frag DIV 4)) / n")
    prefix = sets.select("row", "n", "shared", hub.alias("hub"), F.slice(F.flatten("segments.grams"), 1, length).alias("g"))
    prefix = prefix.select("row", "n", "hub", F.posexplode("g").alias("pos", "gram"), "shared").withColumn("rest", F.col("shared") - F.col("pos")).drop("shared", "pos")
    prefix = C.materialize(prefix, "prefix")
    # the first common n-gram leaves rest n-grams on either side for the overlap
    near_size = f"least(na, nb) * 100 >= greatest(na, nb) * {percent} AND least(ra, rb) * {100 + percent} >= (na + nb) * {percent}"

    # (a) each set with the set that represents most of its prefix n-grams
    star = prefix.groupBy("gram").agg(F.max(F.struct("hub", "row", "n", "rest")).alias("c"), F.count("*").alias("k")).where("k > 1").select("gram", F.col("c.row").alias("b"), F.col("c.n").alias("nb"), F.col("c.rest").alias("rb"))
    star = C.one_side(star, prefix.count(), 32, "star")
    votes = prefix.select("gram", F.col("row").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra")).join(star, "gram").where(f"a <> b AND {near_size}").groupBy("a", "na", "b", "nb").count()
    best = votes.groupBy("a", "na").agg(F.max(F.struct("count", "b", "nb")).alias("m")).select("a", "na", "m.b", "m.nb")
    first_links = C.materialize(_verified(C.materialize(best, "best"), sets, percent), "links")
    joined = C.materialize(C.components(first_links), "joined")

    # (b) everything that shares a prefix n-gram across components
    own = prefix.join(joined.select(F.col("id").alias("row"), "component"), "row", "left").select("row", "n", "rest", "gram", F.coalesce("component", "row").alias("comp"))
    own = C.materialize(own, "own")
    mixed = own.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("gram", F.ceil(F.col("k") / PAIRED).cast("int").alias("parts"))
    mixed = C.one_side(mixed, own.count(), 16, "mixed")
    own = own.join(mixed, "gram")
    x, y = (own.select("gram", F.col("row").alias(k), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"r{k}"), F.col("comp").alias(f"c{k}"), "parts") for k in "ab")
    # the sets of a frequent n-gram are paired block by block
    x = x.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    across = x.join(y, ["gram", "part"]).where(f"a < b AND ca <> cb AND {near_size}").select("a", "na", "b", "nb").distinct()
    # an overlap is at most the sum, over parts by hash, of the smaller part
    part = lambda k: sets.select(F.col("row").alias(k), F.col("sizes").alias(f"s{k}"))
    most = "aggregate(zip_with(sa, sb, (p, q) -> least(p, q)), 0, (s, v) -> s + v)"
    across = across.join(part("a"), "a").join(part("b"), "b").where(f"{most} * {100 + percent} >= (na + nb) * {percent}").select("a", "na", "b", "nb")
    second_links = C.materialize(_verified(C.materialize(across, "across"), sets, percent), "links")
    C.drop(prefix, joined, sets)
    both = C.materialize(first_links.union(second_links), "links")
    # members that are not alike have no link among them, but each has those of their row
    linked = both.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("linked", F.lit(True))
    member = member.join(C.one_side(linked, 2 * both.count(), 16, "linked"), "rep", "left")
    return both, member.select("row", F.when(F.col("alike") | F.col("linked"), F.col("rep")).otherwise(F.col("row")).alias("rep"))


def _least(base: DataFrame) -> DataFrame:
    """(root, smallest id) of the components of several rows; a row alone is its own."""
    known = F.when(F.col("id") != F.expr("-9223372036854775807L - 1L"), F.col("id"))
    out = base.groupBy("root").agg(F.min(known).alias("least"), F.count("*").alias("k"))
    return C.materialize(out.where("k > 1 AND least IS NOT NULL").drop("k"), "least")


def components_of(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    found = C.materialize(shared_grams(docs, n, percent, text, doc_id), "grams")
    pairs, member = links(found, percent)
    linked = C.materialize(C.components(pairs), "comp")
    root = member.join(C.small_side(linked.withColumnRenamed("id", "rep"), 32 << 20, 16), "rep", "left").select("row", F.coalesce("component", "rep").alias("root"))
    base = C.materialize(found.select("row", "id", "n").join(root, "row", "left").select("id", "n", F.coalesce("root", "row").alias("root")), "base")
    least = _least(base)
    # an id on several rows ties their components together
    by_id = base.groupBy("id").agg(F.min("root").alias("r"), F.max("root").alias("r2"))
    ties = C.materialize(by_id.where(f"r <> r2 AND id <> {-(1 << 63)}").select("id"), "ties")
    if ties.limit(1).count():
        edges = base.join(ties, "id").select(F.col("root").alias("a"), F.col("id").alias("key"))
        first = edges.groupBy("key").agg(F.min("a").alias("b"))
        tied = C.components(edges.join(first, "key").select("a", "b"))
        base = C.materialize(base.join(tied.select(F.col("id").alias("root"), "component"), "root", "left").select("id", "n", F.coalesce("component", "root").alias("root")), "base")
        least = _least(base)
    out = base.join(C.small_side(least, 32 << 20, 16), "root", "left").withColumn("least", F.coalesce("least", "id"))
    null_id = F.col("id") == F.lit(-(1 << 63))
    return out.select(F.when(~null_id, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(~null_id, F.col("least")).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
