"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more coordinate, sqrt(max norm**2 - norm**2), which turns largest
inner product into smallest angle; queries get 0 there.  The trees are fitted on a
bounded sample (``SAMPLE`` vectors, those of least hash); every vector is indexed.
A query walks all trees through one shared priority queue, best margin first, until
the leaves it has reached hold a budget of vectors.  Queries that have fewer than ``k``
different neighbours from these leaves (a vector lies in one leaf of every tree) are asked
again with four times the budget, until they have them or have walked all leaves.  All vectors of those leaves are
then reranked exactly, in double precision, on the original coordinates.

The leaves of a query come in the order of that queue: a leaf's place in it is the largest margin on
the wrong side of which its path lies, which is worked out for all leaves of some queries at once.

The budget is measured, not guessed: ``CALIBRATE`` queries (those of least hash) are
answered by brute force in one linear pass, and the budget is where ``TARGET`` of
their true neighbours have been reached.  On vectors without structure no forest
can do with a small part of the rows; the budget then grows with the index.

Vectors and queries are dealt out by hash in blocks of bounded size, and each block of
vectors meets each block of queries once.  ``CHUNK`` queries travel as one row, with a word of bits for every leaf that
says which of them reached it; the words of a vector's leaves, or-ed, say which of them it
is a candidate of.  So a vector that lies in several reached leaves is scored once, one that a third of
all rows repeat does not gather in one task, and memory is that of one block of either.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part; nor do vectors of another length than most.  A null id
takes no part.  Ids are taken as unique; a query never finds its own id, and an id
on several rows is found once, by its best score.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

TREES, SAMPLE, K = 24, 20_000, 20
#: Queries that set the budget, and the part of their neighbours it has to reach.
CALIBRATE, TARGET = 64, 0.96
#: Rows of an index block at most and at least, blocks of a smaller index, queries of a query block.
BLOCK, LEAST_BLOCK, BLOCKS, QUERIES = 32_768, 512, 24, 4096
#: Queries whose bits make one word, queries that walk the trees at once, vectors placed by a task.
CHUNK, WALKED, PLACED = 64, 16, 16_384
#: Parts in which the answers to one query are merged first.
SIDES = 64


class Forest:
    """Trees over augmented vectors: node -> (normal, offset, children); negative children are leaves."""

    def __init__(self, sample: np.ndarray, most: float, trees: int, leaf: int, seed: int = 7):
        self.most, rng = most, np.random.default_rng(seed)
        self.normals, self.offsets, self.children, self.roots, self.leaves = [], [], [], [], 0
        x = self.augmented(sample)
        for _ in range(trees):
            self.roots.append(self._grow(x, np.arange(len(x)), leaf, rng, 0))
        dim = x.shape[1] if x.ndim == 2 else 1
        self.normals = np.array(self.normals, np.float64).reshape(-1, dim)
        self.offsets, self.children = np.array(self.offsets, np.float64), np.array(self.children, np.int64).reshape(-1, 2)

    def augmented(self, v: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, self.most**2 - (v * v).sum(1))
        return np.concatenate([v, np.sqrt(rest)[:, None]], 1)

    def _grow(self, x, rows, leaf, rng, depth) -> int:
        if len(rows) > leaf and depth < 40:
            for _ in range(4):
                p, q = x[rng.choice(rows, 2, replace=False)]
                normal = p - q
                size = np.sqrt((normal * normal).sum())
                if size == 0:
                    continue
                normal = normal / size
                side = x[rows] @ normal
                offset = float(np.median(side))
                up = side > offset
                if up.any() and not up.all():
                    node = len(self.normals)
                    self.normals.append(normal), self.offsets.append(offset), self.children.append((0, 0))
                    kids = (self._grow(x, rows[~up], leaf, rng, depth + 1), self._grow(x, rows[up], leaf, rng, depth + 1))
                    self.children[node] = kids
                    return node
        self.leaves += 1
        return -self.leaves

    def place(self, v: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree: (rows, trees)."""
        x, out = self.augmented(v), np.empty((len(v), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(v), root)
            while len(go := np.flatnonzero(at >= 0)):
                node = at[go]
                up = np.einsum("ij,ij->i", x[go], self.normals[node]) > self.offsets[node]
                at[go] = self.children[node, up.astype(np.int64)]
            out[:, t] = -at
        return out

    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """From the roots down: nodes, and where their two children are in a row of all nodes and then all leaves."""
        if not hasattr(self, "_levels"):
            self._levels, at = [], np.array([r for r in self.roots if r >= 0], np.int64)
            while len(at):
                kids = self.children[at]
                self._levels.append((at, np.where(kids >= 0, kids, len(self.normals) - kids)))
                at = kids[kids >= 0]
        return self._levels

    def probe(self, q: np.ndarray, size: np.ndarray, search: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every query the leaves, by one queue over all trees, until they hold ``search`` vectors, and how many they hold up to each."""
        x = np.concatenate([q, np.zeros((len(q), 1))], 1)
        x /= np.sqrt((x * x).sum(1))[:, None]
        x *= self.most
        n = len(self.normals)
        full = np.flatnonzero(size)
        for lo in range(0, len(x), WALKED):
            some = x[lo : lo + WALKED]
            margins = some @ self.normals.T - self.offsets if n else np.zeros((len(some), 0))
            place = np.full((len(some), n + len(size)), -np.inf)
            for at, kids in self.levels():
                side, far = margins[:, at], place[:, at]
                other = np.maximum(far, np.abs(side))
                place[:, kids[:, 0]], place[:, kids[:, 1]] = np.where(side > 0, other, far), np.where(side > 0, far, other)
            for own in place[:, n + full]:
                order = np.argsort(own, kind="stable")
                held = np.cumsum(size[full[order]])
                end = int(np.searchsorted(held, search)) + 1
                yield full[order[:end]], held[:end]


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("v")
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    flat = _unpacked(col, np.float64) if pa.types.is_binary(col.type) else col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))


def _packed(rows: np.ndarray) -> pa.Array:
    """A row of numbers as one binary value."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _unpacked(col: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind)


def valid(vectors: DataFrame, vec_id: str, vector: str, length: int | None = None) -> DataFrame:
    """(id, v) of the rows that take part; vectors of another length than ``length``, by default the usual one, take none."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    if length is None:
        shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = shape.d if shape else 0
    return rows.where(F.size("v") == length)


def drawn(rows: DataFrame, n: int, seed: int | None, count: int) -> DataFrame:
    """The ``n`` rows with the least hash of their id, of ``count``: a threshold leaves little more than ``n`` rows to sort."""
    h = F.xxhash64("id") if seed is None else F.xxhash64("id", F.lit(seed))
    share = (n + 10 * n**0.5 + 10) / max(1, count)
    few = rows if share >= 1 else rows.where(h < F.lit(int(share * 2.0**64) - (1 << 63)))
    return few.orderBy(h, "id").limit(n)


def _nearest(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some rows by the exact measure, ties to the smaller id; an id counts once."""
    score = np.einsum("ij,j->i", v, q, optimize=False)
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return ids[keep], score[keep]


def _rerank(key: tuple, queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best candidates in one block of the index for each query of a block."""
    C.one_thread()
    out_q, out_i, out_s = [], [], []
    if queries.num_rows and rows.num_rows:
        batch = rows.combine_chunks().to_batches()[0]
        ids, v = _vectors(batch)
        leaves = _unpacked(batch.column("leaves"), np.int32).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, v, leaves = ids[order], v[order], leaves[order]
        most = np.sqrt((v * v).sum(1).max())
        for names, vectors, words in zip(*(queries.column(c).to_pylist() for c in ("ids", "v", "words")), strict=True):
            asked = np.bitwise_or.reduce(np.frombuffer(words, "<u8")[leaves], axis=1)
            some = np.flatnonzero(asked)  # what at least one of these queries reaches
            if not len(some):
                continue
            own, asked = (v, asked) if len(some) == len(v) else (v[some], asked[some])
            qs, q = np.frombuffer(names, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, v.shape[1])
            scores = q @ own.T
            for j, one in enumerate(qs.tolist()):
                reached = (asked >> np.uint64(j)) & np.uint64(1) > 0
                reached[slice(*np.searchsorted(ids[some], [one, one + 1]))] = False
                near = np.where(reached, scores[j], -np.inf)
                # of k groups' best, the least is no more than the k-th best; products in another order differ in the last digits
                cut = len(near) // 64 * 64
                best = np.concatenate([near[:cut].reshape(-1, 64).max(1), near[cut:]])
                bound = np.partition(best, -k)[-k] if len(best) >= k else -np.inf
                found = np.flatnonzero(~(near < bound - 1e-12 * most * np.sqrt(q[j] @ q[j])) & reached)
                got = _nearest(ids[some[found]], own[found], q[j], k)
                if len(got[0]) < k and len(found) < np.count_nonzero(reached):  # an id on many rows
                    found = np.flatnonzero(reached)
                    got = _nearest(ids[some[found]], own[found], q[j], k)
                if len(got[0]):
                    out_q.append(one), out_i.append(got[0]), out_s.append(got[1])
    return pa.table({"q": pa.array(out_q, pa.int64()), "side": pa.array([key[0].as_py()] * len(out_q), pa.int32()), "ids": pa.array(out_i, pa.list_(pa.int64())), "scores": pa.array(out_s, pa.list_(pa.float64()))})


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, ids, scores = [], [], []
        for one, i, s in zip(batch.column("q").to_pylist(), batch.column("ids").to_pylist(), batch.column("scores").to_pylist(), strict=True):
            i, s = np.array([x for y in i for x in y], np.int64), np.array([x for y in s for x in y])
            order = np.lexsort((i, -s))
            i, s = i[order], s[order]
            _, first = np.unique(i, return_index=True)
            keep = np.sort(first)[:k]
            q.append(one), ids.append(i[keep]), scores.append(s[keep])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), batch.column("side"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["q", "side", "ids", "scores"])


def _brute(batches: Iterator[pa.RecordBatch], qs: list[int], q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of every batch for a few queries."""
    for batch in batches:
        ids, v = _vectors(batch)
        if not len(ids):
            continue
        leaves = _unpacked(batch.column("leaves"), np.int32).reshape(len(ids), -1)
        for one, vec in zip(qs, q, strict=True):
            score = v @ vec
            score[ids == one] = -np.inf
            top = np.argsort(-score)[:k]
            top = top[score[top] > -np.inf]
            if len(top):
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(top), pa.int64()), pa.array(score[top]), _packed(leaves[top])], ["q", "score", "leaves"])


def _budget(forest: Forest, size: np.ndarray, rows: DataFrame, asks: DataFrame, n_asks: int, k: int, target: float) -> float:
    """Vectors a query has to reach so that ``target`` of the true neighbours are among them."""
    few = drawn(asks, CALIBRATE, 1, n_asks).toPandas()
    if few.empty:
        return 1.0
    qs, q = few["id"].tolist(), np.stack(few["v"].to_list()).astype(np.float64)
    near = rows.mapInArrow(lambda it: _brute(it, qs, q, k), "q long, score double, leaves binary")
    # the best of a few hundred parts first, then of these
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "leaves"))
    near = near.withColumn("part", F.pmod(F.xxhash64("score"), F.lit(256))).withColumn("r", rank("q", "part")).where(F.col("r") <= k)
    near = near.withColumn("r", rank("q")).where(F.col("r") <= k)
    best = near.groupBy("q").agg(F.collect_list(F.struct("score", "leaves")).alias("best"))
    best, seen = {r.q: r.best for r in best.collect()}, []
    for one, (order, held) in zip(qs, forest.probe(q, size, np.inf), strict=True):
        reached = np.full(len(size), np.inf)
        reached[order] = held
        seen += [reached[np.frombuffer(b.leaves, np.int32)].min() for b in best.get(one, [])]
    return float(np.quantile(seen, target)) if seen else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, target: float = TARGET, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every query vector."""
    spark = vectors.sparkSession
    rows = C.materialize(valid(vectors, vec_id, vector), "vectors")
    stats = rows.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("m"), F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not stats.n:
        return empty
    asks = C.materialize(valid(queries, vec_id, vector, stats.d), "asks")
    n_asks = asks.count()
    sample = drawn(rows, SAMPLE, None, stats.n).select("v").toArrow().column("v").combine_chunks()
    sample = sample.flatten().to_numpy().reshape(len(sample), -1)
    # in the sample, a leaf that holds about 100 of all vectors, but 16 sampled ones at least
    forest = Forest(sample, float(np.sqrt(stats.m)), trees, max(16, 100 * len(sample) // stats.n))
    shared = spark.sparkContext.broadcast(forest)

    def assign(batches):
        for batch in batches:
            ids, v = _vectors(batch)
            if len(ids):
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(v), _packed(shared.value.place(v).astype(np.int32))], ["id", "v", "leaves"])

    def held(batches):
        total = np.zeros(shared.value.leaves + 1, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column("leaves"), np.int32), minlength=len(total))
        leaf = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(total[leaf])], ["leaf", "n"])

    dealt = rows.repartition(max(1, stats.n // PLACED), F.xxhash64("id", "v"))
    placed = C.materialize(dealt.mapInArrow(assign, "id long, v binary, leaves binary"), "placed")
    # bounded by the number of leaves, which the sample bounds
    size = np.zeros(forest.leaves + 1, np.int64)
    for r in placed.select("leaves").mapInArrow(held, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        size[r.leaf] = r.n
    sizes = spark.sparkContext.broadcast(size)
    budget = _budget(forest, size, placed, asks, n_asks, k, target)

    budget, parts, walked = float(budget), [], float(size.sum())
    while n_asks:
        found = C.materialize(_asked(asks, n_asks, placed, stats.n, sizes, shared, budget, k), "found")
        if budget >= walked:
            parts.append(found)
            break
        enough = found.where(F.size("ids") >= min(k, stats.n - 1))
        parts.append(enough)
        short = asks.join(enough.select(F.col("q").alias("id")), "id", "left_anti")
        asks, budget = C.materialize(short, "asks"), 4 * budget
        n_asks = asks.count()
    if not parts:
        return empty
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    return best.select(F.col("q").alias("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _asked(asks: DataFrame, n_asks: int, placed: DataFrame, n_rows: int, sizes, shared, budget: float, k: int) -> DataFrame:
    """(q, ids, scores): the k best of the vectors that the queries reach with a budget."""

    def probe(batches):
        C.one_thread()
        for batch in batches:
            ids, v = _vectors(batch)
            reached = shared.value.probe(v, sizes.value, budget)
            for lo in range(0, len(ids), CHUNK):
                some = ids[lo : lo + CHUNK]
                words = np.zeros(len(sizes.value), "<u8")
                for j in range(len(some)):
                    words[next(reached)[0]] |= np.uint64(1 << j)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (some, v[lo : lo + CHUNK], words)], ["ids", "v", "words"])

    blocks = -(-n_rows // min(BLOCK, max(LEAST_BLOCK, n_rows // BLOCKS)))
    parts = -(-n_asks // QUERIES)
    # a chunk of queries is some 64 of one task
    chunks = asks.repartition(max(1, -(-n_asks // (4 * CHUNK))), "id").mapInArrow(probe, "ids binary, v binary, words binary")
    part, block = F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    left = chunks.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = placed.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    key = ["block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda kk, a, b: _rerank(kk, a, b, k), "q long, side int, ids array<long>, scores array<double>")
    # a query gathers the answers of its blocks in up to SIDES parts, and then the best of each part
    for level in (f"pmod(side, {SIDES})", "0") if blocks > SIDES else ("0",):
        found = found.withColumn("side", F.expr(level).cast("int")).groupBy("q", "side").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
        found = found.mapInArrow(lambda it: _best(it, k), "q long, side int, ids array<long>, scores array<double>")
    return found.drop("side")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
