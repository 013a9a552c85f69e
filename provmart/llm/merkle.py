"""Merkle manifest of a dataset: a tree for every source, a tree over their roots, proofs for every row.

Leaves are hashed in the scan; only ids and digests travel from there.  Rows get their place
in their source from ranges of (source, id), see ``operators.ranks``, so a source that holds most rows is
spread over many tasks.

Growing is a combineByKey that is driven by events: a task merges the children it meets
into partial parents, keyed by (tree, level, place) and indexed by the child's slot.  How many children
a parent takes follows from the tree's size, so the task that adds the last one hashes the
parent at once, writes it with its children (the reverse link) and adds it to its own parent.  Partial
parents that are left over at the end of a task - at most some fifteen children at either
edge of its rows, for every level - form the frontier, which is dealt by key and merged
again, at most once for every level.

Proofs follow the reverse links down from the root: a child's path is its siblings and then its
parent's path.  Above blocks of 256 leaves that is a join for each level; inside a block one group
walks the links of its leaves.  No task gets more than a block, whatever the size of a source.

Defined cases: a null field is ``-`` in the leaf; a null source is a source of its own and comes
first, a null id comes first in its source and is never tampered with; rows that repeat an id are leaves next to
each other in the order of their digests; an empty text is a value of zero bytes;
an empty table has no leaves, no root and an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common as C

ARITY = 16
#: Levels inside a block of ARITY ** BLOCK_LEVELS leaves, whose proofs one group writes.
BLOCK_LEVELS = 2
#: Partial parents of the frontier in a task.
FRONTIER_ROWS = 20_000
#: Bound of a broadcast table of sources.
SOURCES_BYTES = 32 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, n long, level int, idx long, slots binary, children binary, digest binary, top boolean"
_PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def hashed(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of ``n`` leaves."""
    return -(-n // ARITY**level)


# ------------------------------------------------------------------ growing


class Forest:
    """Partial parents of a task; ``add`` returns the parents that it completes."""

    def __init__(self) -> None:
        self.partial: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}

    def add(self, tree: int, n: int, level: int, idx: int, slots: bytes, children: bytes) -> Iterator[tuple]:
        """Merge children into the parent (tree, level, idx), and go on upwards for as long as that completes one."""
        found = {s: children[32 * i : 32 * i + 32] for i, s in enumerate(slots)}
        while True:
            key = (tree, level, idx)
            held = self.partial.setdefault(key, (n, {}))[1]
            held.update(found)
            if len(held) < min(ARITY, width(n, level - 1) - ARITY * idx):
                return
            del self.partial[key]
            order = sorted(held)
            digest = sha256("".join(held[s].hex() for s in order).encode()).digest()
            top = width(n, level) == 1
            yield tree, n, level, idx, bytes(order), b"".join(held[s] for s in order), digest, top
            if top:
                return
            found, level, idx = {idx % ARITY: digest}, level + 1, idx // ARITY

    def left(self) -> Iterator[tuple]:
        for (tree, level, idx), (n, held) in self.partial.items():
            yield tree, n, level, idx, bytes(held), b"".join(held.values()), None, False


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _NODE.split(", ")])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, out = Forest(), []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out += forest.add(*row)
        if out:
            yield _batch(out)
            out = []
    left = list(forest.left())
    for i in range(0, len(left), 10_000):
        yield _batch(left[i : i + 10_000])


def grow(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All parents of the trees of (tree, n, idx, digest), and the work tables that hold them."""
    slot = F.unhex(F.lpad(F.hex(F.col("idx") % ARITY), 2, "0"))
    partial = leaves.where("n > 1").select("tree", "n", F.lit(1).alias("level"), F.expr(f"idx DIV {ARITY}").alias("idx"), slot.alias("slots"), F.col("digest").alias("children"))
    rounds: list[DataFrame] = []
    while True:
        rounds.append(C.materialize(partial.mapInArrow(_combine, _NODE), "grown"))
        frontier = rounds[-1].where("digest IS NULL")
        if not (left := frontier.count()):
            break
        dealt = frontier.repartition(-(-left // FRONTIER_ROWS), "tree", "level", "idx")
        partial = dealt.select("tree", "n", "level", "idx", "slots", "children")
    return reduce(DataFrame.union, [r.where("digest IS NOT NULL") for r in rounds]), rounds


# ------------------------------------------------------------ reverse links


def paths(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, n, idx, path) of the nodes of ``level`` in trees that are higher: siblings up to the top, left to right."""
    highest = nodes.agg(F.max("level")).first()[0] or 0
    none = F.unhex(F.lit(""))
    found = None
    for up in range(highest, level, -1):
        at = nodes.where(F.col("level") == up)
        here = at.where("top").select("tree", "n", "idx", "children", none.alias("path"))
        if found is not None:
            here = here.union(at.join(found, ["tree", "n", "idx"]).select("tree", "n", "idx", "children", "path"))
        child = here.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("octet_length(children) DIV 32 - 1").cast("int"))))
        siblings = F.concat(F.expr("substring(children, 1, 32 * k)"), F.expr("substring(children, 32 * k + 33)"), F.col("path"))
        below = C.materialize(child.select("tree", "n", (F.col("idx") * ARITY + F.col("k")).alias("idx"), siblings.alias("path")), "paths")
        if found is not None:
            C.drop(found)
        found = below
    return found if found is not None else nodes.where("false").select("tree", "n", "idx", none.alias("path"))


def fold(digest: str, idx: int, n: int, path: str) -> str:
    """The top of a tree of ``n`` leaves from one of them and the hex digests of its siblings, level by level."""
    while n > 1:
        slot, parent = idx % ARITY, idx // ARITY
        take = 64 * (min(ARITY, n - ARITY * parent) - 1)
        siblings, path = path[:take], path[take:]
        digest = sha256((siblings[: 64 * slot] + digest + siblings[64 * slot :]).encode()).hexdigest()
        idx, n = parent, width(n, 1)
    return digest


def _prove(root: str, n_trees: int, table: pa.Table) -> pa.Table:
    """Proofs of one block: its leaves, the links inside it, and the path of the block's top."""
    links: dict[tuple[int, int], list[str]] = {}
    head: dict = {}
    leaves = []
    for row in table.to_pylist():
        if row["kind"] == 0:
            leaves.append(row)
        elif row["kind"] == 1:
            whole = row["blob"].hex()
            links[row["level"], row["idx"]] = [whole[i : i + 64] for i in range(0, len(whole), 64)]
        else:
            head = row
    tree, subroot, above, over = head["tree"], head["digest"].hex(), head["blob"].hex(), head["extra"].hex()
    rest: dict[int, str] = {}  # by parent: the siblings above it inside the block, and the path from there
    out = []
    for row in leaves:
        idx, n, leaf = row["idx"], row["n"], row["digest"].hex()
        siblings, parent = "", idx // ARITY
        if n > 1:
            run = links[1, parent]
            siblings = "".join(run[: idx % ARITY] + run[idx % ARITY + 1 :])
        if parent not in rest:
            steps, at = [], parent
            for level in range(2, BLOCK_LEVELS + 1):
                if width(n, level - 1) == 1:
                    break
                run = links[level, at // ARITY]
                steps += run[: at % ARITY] + run[at % ARITY + 1 :]
                at //= ARITY
            rest[parent] = "".join(steps) + above
        path = siblings + rest[parent]
        forged = row["extra"].hex() if row["extra"] is not None else leaf
        top = fold(fold(forged, idx, n, path), tree, n_trees, over)
        out.append((row["doc_id"], leaf, subroot, root, sha256((path + over).encode()).hexdigest(), top, top == root))
    names = ["doc_id", *[x.split()[0] for x in _PROOF.split(", ")]]
    types = [table.schema.field("doc_id").type, *[pa.string()] * 5, pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


# ----------------------------------------------------------------- manifest


@dataclass
class Manifest:
    """Leaves, parents, and the root of each tree with its path to the root over all; empty data has no root."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    n_trees: int
    tables: list[DataFrame]

    def drop(self) -> None:
        C.drop(*self.tables)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", forged: Sequence[Column] | None = None, when: Column | None = None) -> Manifest:
    """Grow the trees of ``docs``; where ``when`` holds, ``forged`` are the fields of a tampered row."""
    other = F.when(when, digest_of(forged)) if forged is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), digest_of([F.col(f) for f in fields]).alias("digest"), other.alias("forged"))
    rows = C.materialize(rows, "leaves")
    names = C.materialize(rows.select("source").distinct(), "sources")
    names_at = C.materialize(ranked(names, [F.col("source").asc_nulls_first()]).select(F.col("source").alias("_source"), F.col("idx").alias("tree")), "trees")
    n_trees = names.count()
    placed = ranked(rows, [F.col("doc_id").asc_nulls_first(), "digest", "forged"], ["source"])
    leaves = C.materialize(placed.join(C.small_side(names_at, SOURCES_BYTES, 64), F.col("source").eqNullSafe(F.col("_source"))).select("tree", "n", "idx", "doc_id", "digest", "forged"), "placed")
    nodes, rounds = grow(leaves.select("tree", "n", "idx", "digest"))
    tops = C.materialize(nodes.where("top").select("tree", "digest").union(leaves.where("n = 1").select("tree", "digest")), "tops")
    over, over_rounds = grow(tops.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"))
    root = over.where("top").select("digest").first() or (tops.first() if n_trees == 1 else None)
    way = paths(over, 0)
    trees = C.materialize(tops.join(way.select(F.col("idx").alias("tree"), "path"), "tree", "left").select("tree", "digest", F.coalesce("path", F.unhex(F.lit(""))).alias("path")), "roots")
    C.drop(rows, names, names_at, tops, way, *over_rounds)
    return Manifest(leaves, nodes, trees, root and bytes(root["digest"]).hex(), n_trees, [leaves, trees, *rounds])




def prove(found: Manifest) -> DataFrame:
    """One row per leaf: its digest, the roots, its proof's digest, and the root that its (tampered) leaf folds to."""
    size = ARITY**BLOCK_LEVELS
    binary = F.lit(None).cast("binary")
    kind = found.leaves.schema["doc_id"].dataType.simpleString()
    no_id, block = F.lit(None).cast(kind).alias("doc_id"), F.expr(f"idx DIV {size}L").alias("block")
    leaves = found.leaves.select("tree", block, F.lit(0).alias("kind"), F.lit(0).alias("level"), "idx", "n", "digest", binary.alias("blob"), F.col("forged").alias("extra"), "doc_id")
    inside = found.nodes.where(F.col("level") <= BLOCK_LEVELS)
    own = F.expr(f"CASE level {' '.join(f'WHEN {k} THEN idx DIV {ARITY ** (BLOCK_LEVELS - k)}L' for k in range(1, BLOCK_LEVELS + 1))} END")
    links = inside.select("tree", own.alias("block"), F.lit(1), "level", "idx", "n", binary, F.col("children"), binary, no_id)
    above = paths(found.nodes, BLOCK_LEVELS)
    lowest = found.leaves.where(f"n <= {size} AND idx = 0").select("tree", "n", F.lit(0).cast("long").alias("idx"), F.unhex(F.lit("")).alias("path"))
    heads = above.union(lowest).join(found.trees.withColumnRenamed("path", "over"), "tree")
    heads = heads.select("tree", F.col("idx").alias("block"), F.lit(2), F.lit(0), "idx", "n", "digest", F.col("path"), F.col("over"), no_id)
    root, n_trees = found.root, found.n_trees
    return leaves.union(links).union(heads).groupBy("tree", "block").applyInArrow(lambda table: _prove(root, n_trees, table), f"doc_id {kind}, {_PROOF}")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forged = [F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in FIELDS]
    found = manifest(docs, forged=forged, when=C.fold_of(F.col("doc_id"), 5) == 0)
    out = C.materialize(prove(found), "proofs")
    found.drop()
    return out
