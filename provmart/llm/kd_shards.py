"""Sharding by k-d tree: distributed weighted medians along the widest metadata dimension.

Law ``bytes``: the shards' sizes are near equal.  Rows with equal texts form a group and
stay in one shard.  Groups of over ``PINNED`` of a shard, of which there are at most
shards / ``PINNED``, are placed first, the largest in the emptiest shard; what a shard still
lacks is what its leaf of the tree is to hold.  Only a group that is larger than a shard is
split, by id, into parts of a shard's size; its rows say so in ``split``.

A node of the tree is split where the part of its bytes that its left leaves are to hold
lies before the cut, along the dimension in which it is widest relative to the whole table.
The cut is found without sorting: a histogram of bytes by bin (a partial aggregate; only
bins reach the driver, a number bounded by nodes times ``BINS``) is refined inside the bin
that holds the cut.  Groups with the same value along the dimension are cut by a hash of
their text.  Where a row goes depends on its text (and on its id, if its group is split), so
a written shard holds the rows that the manifest names.  Only DataFrame operations; texts
are read once and not shuffled to find their shards.

Defined cases: null text has size 1 and crc32 0, as has the empty text, with which it
forms one group; null ids are rows like any other, and rows of one id and text stay
together; repeated rows each get a slot; an empty table gives no rows.  Extra columns are
not read, and are written as they are.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARDS, BINS, PINNED = 8, 512, 0.05
#: Rows numbered by one task when slots are given.
NUMBERED = 20_000


def dimensions(text: Column) -> dict[str, Column]:
    """Metadata of a text: its length (log scale), words and lines per byte, first and last byte."""
    size = F.octet_length(text) + 1
    return {
        "length": F.log2(size.cast("double")),
        "spaces": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))) / size,
        "lines": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))) / size,
    }


def measured(docs: DataFrame, text: str, doc_id: str, *more: str) -> tuple[DataFrame, list[str]]:
    """One row per document without its text: row, doc_id, size, crc, dimensions, tie (hash of the text), and more columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    dims = dimensions(t)
    names = [f"d{i}" for i in range(len(dims))]
    size = (F.octet_length(t) + 1).cast("long")
    own = [F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), size.alias("size")]
    own += [F.crc32(t.cast("binary")).cast("long").alias("crc"), F.xxhash64(t, F.lit(1)).alias("tie")]
    return docs.select(*own, *[d.cast("double").alias(n) for n, d in zip(names, dims.values(), strict=True)], *more), names


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline table as SQL VALUES: unlike a table made from Python objects, it runs no Python worker."""
    kinds = [f.split() for f in schema.split(", ")]
    word = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)"
    body = ", ".join(f"({', '.join(map(word, r))})" for r in rows) or f"({', '.join(['NULL'] * len(kinds))})"
    cols = ", ".join(f"CAST(col{i + 1} AS {kind}) AS {name}" for i, (name, kind) in enumerate(kinds))
    return spark.sql(f"SELECT {cols} FROM VALUES {body}" + ("" if rows else " WHERE false"))


def _cuts(nodes: DataFrame, open_: dict[int, tuple[float, str]], names: list[str]) -> dict[int, tuple[str, float, int]]:
    """For every open node (-> part of its bytes to the left, dimension): groups with (value, tie) < cut go left."""
    spark = nodes.sparkSession
    weight = {r.node: r.b for r in nodes.groupBy("node").agg(F.sum("bytes").alias("b")).collect()}
    value = F.coalesce(*[F.when(F.col("dim") == n, F.col(n)) for n in names])
    find = {n: {"dim": d, "need": weight.get(n, 0) * part, "lo": None, "on": "value"} for n, (part, d) in open_.items()}
    for _ in range(12):
        active = {n: f for n, f in find.items() if f["on"] in ("value", "tie") and n in weight}
        if not active:
            break
        spec = _values(spark, [(n, f["dim"], f["on"], f.get("at"), f["lo"], f.get("hi")) for n, f in active.items()], "node long, dim string, mode string, at double, lo double, hi double")
        rows = nodes.join(F.broadcast(spec), "node").withColumn("value", value)
        rows = rows.where("mode = 'value' OR value = at").withColumn("x", F.expr("CASE mode WHEN 'value' THEN value ELSE CAST(tie AS DOUBLE) END"))
        rows = rows.where("lo IS NULL OR (x >= lo AND x <= hi)")
        ends = {r.node: (r.lo, r.hi) for r in rows.groupBy("node").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        span = _values(spark, [(n, lo, hi) for n, (lo, hi) in ends.items()], "node long, a double, b double")
        binned = rows.join(F.broadcast(span), "node").withColumn("bin", F.expr(f"CASE WHEN b > a THEN least({BINS - 1}, CAST((x - a) / (b - a) * {BINS} AS INT)) ELSE 0 END"))
        table = defaultdict(dict)
        for r in binned.groupBy("node", "bin").agg(F.sum("bytes").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            table[r.node][r.bin] = (r.w, r.lo, r.hi)
        for n, f in active.items():
            before = 0
            for b in sorted(table[n]):
                w, lo, hi = table[n][b]
                if before + w >= f["need"] or b == max(table[n]):
                    break
                before += w
            f["need"] -= before
            if lo < hi and w > 0.001 * weight[n]:
                f["lo"], f["hi"] = lo, hi
            elif f["on"] == "value" and w > 0.001 * weight[n]:
                f.update(on="tie", at=lo, lo=None, hi=None)
            else:  # the bin is light, or a single group: it goes where it balances best
                right = f["need"] < w / 2
                if f["on"] == "value":
                    f.update(on="done", cut=(lo if right else float(_next(hi)), -(1 << 63)))
                else:
                    f.update(on="done", cut=(f["at"], max(-(1 << 63), int(lo) - 2048) if right else min((1 << 63) - 1, int(hi) + 2048)))
    for f in find.values():
        if "cut" not in f:
            f["cut"] = (f.get("at") if f.get("at") is not None else (f["lo"] or 0.0), int(f["lo"]) if f["on"] == "tie" and f["lo"] is not None else -(1 << 63))
    return {n: (f["dim"], *f["cut"]) for n, f in find.items()}


def _next(x: float) -> float:
    import math

    return math.nextafter(x, math.inf)


def kd_tree(groups: DataFrame, names: list[str], wanted: list[float]) -> list[dict[int, tuple[str, float, int]]]:
    """Cuts level by level for leaves that are to hold ``wanted`` bytes; node numbers are 1 for the root, 2n and 2n + 1 for the parts of n."""
    spread = groups.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    whole = {n: (spread[f"hi_{n}"] or 0) - (spread[f"lo_{n}"] or 0) for n in names}
    open_, levels, nodes = {1: (0, len(wanted))}, [], groups.withColumn("node", F.lit(1).cast("long"))
    while todo := {n: span for n, span in open_.items() if span[1] - span[0] > 1}:
        wide = {r.node: r for r in nodes.groupBy("node").agg(*[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()}
        width = lambda r, n: (r[n] or 0) / whole[n] if r is not None and whole[n] else 0
        ask, after = {}, {n: span for n, span in open_.items() if n not in todo}
        for node, (a, b) in todo.items():
            middle = a + (b - a) // 2
            total = sum(wanted[a:b])
            part = sum(wanted[a:middle]) / total if total else (middle - a) / (b - a)
            ask[node] = part, max(names, key=lambda n, r=wide.get(node): (width(r, n), n))
            after[2 * node], after[2 * node + 1] = (a, middle), (middle, b)
        cuts = _cuts(nodes, ask, names)
        levels.append(cuts)
        nodes = place(nodes, [cuts], names)
        open_ = after
    return levels


def place(rows: DataFrame, levels: list[dict[int, tuple[str, float, int]]], names: list[str]) -> DataFrame:
    """Move rows down the tree. The cuts of a level are at most one for each leaf, and are broadcast."""
    spark = rows.sparkSession
    for cuts in levels:
        table = F.broadcast(_values(spark, [(n, *c) for n, c in cuts.items()], "node long, cut_dim string, cut_value double, cut_tie long"))
        value = F.coalesce(*[F.when(F.col("cut_dim") == n, F.col(n)) for n in names])
        right = (value > F.col("cut_value")) | ((value == F.col("cut_value")) & (F.col("tie") >= F.col("cut_tie")))
        rows = rows.join(table, "node", "left").withColumn("node", F.when(F.col("cut_dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("long"))).drop("cut_dim", "cut_value", "cut_tie")
    return rows


def _leaf_numbers(leaves: int) -> dict[int, int]:
    out, stack = {}, [(1, leaves)]
    while stack:
        node, k = stack.pop()
        if k == 1:
            out[node] = len(out)
        else:
            stack += [(2 * node + 1, k - k // 2), (2 * node, k // 2)]
    return out


def pinned(heavy: list[tuple[tuple, int]], total: int, shards: int) -> tuple[dict[tuple, list[int]], list[float]]:
    """(heavy group -> the shards of its parts, bytes each shard still lacks): the largest part goes to the emptiest shard."""
    target, room = total / shards, [total / shards] * shards
    parts = [(size / k, key, k) for key, size in heavy for k in [max(1, -(-int(size) // max(1, int(target)))) if size > target else 1]]
    where: dict[tuple, list[int]] = {}
    for size, key, k in sorted(parts, key=lambda p: (-p[0], p[1])):
        for _ in range(k):
            at = max((s for s in range(shards)), key=lambda s: (room[s], -s))
            room[at] -= size
            where.setdefault(key, []).append(at)
    return where, [max(0.0, r) for r in room]


class Plan:
    """Where rows go: the tree, and the shards of heavy groups."""

    def __init__(self, names: list[str], levels: list, shards: int, heavy: dict[tuple, list[int]]):
        self.names, self.levels, self.shards, self.heavy = names, levels, shards, heavy

    def shard(self, rows: DataFrame, doc_id: str) -> DataFrame:
        """Measured rows with shard and split; heavy groups and leaves are few and broadcast."""
        spark = rows.sparkSession
        table = [(*key, len(at), i, s) for key, at in self.heavy.items() for i, s in enumerate(at)]
        heavy = _values(spark, table, "tie long, size long, crc long, parts long, part long, pin int")
        few = heavy.groupBy("tie", "size", "crc").agg(F.max("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("part", "pin"))).alias("pins"))
        rows = rows.join(F.broadcast(few), ["tie", "size", "crc"], "left")
        part = F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.col("parts")).cast("int")
        rows = rows.withColumn("pin", F.get(F.col("pins.pin"), part)).withColumn("split", F.coalesce(F.col("parts") > 1, F.lit(False))).drop("parts", "pins")
        number = F.broadcast(_values(spark, list(_leaf_numbers(self.shards).items()), "node long, leaf int"))
        rows = place(rows.withColumn("node", F.lit(1).cast("long")), self.levels, self.names).join(number, "node")
        return rows.withColumn("shard", F.coalesce("pin", "leaf").cast("int")).drop("node", "leaf", "pin")


def planned(rows: DataFrame, names: list[str], shards: int | None, target_bytes: int | None) -> Plan:
    """The plan for a work table of measured rows; ``target_bytes`` sets the number of shards if given."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    group = rows.groupBy("tie", "size", "crc").agg(*[F.first(n).alias(n) for n in names], F.sum("size").alias("bytes"))
    group = C.materialize(group, "groups")
    limit = max(1.0, PINNED * total / shards)
    # at most shards / PINNED groups are above the limit
    heavy = [((r.tie, r["size"], r.crc), r.bytes) for r in group.where(F.col("bytes") > limit).select("tie", "size", "crc", "bytes").collect()]
    where, room = pinned(heavy, total, shards)
    light = group.where(F.col("bytes") <= limit).select("tie", *names, "bytes")
    plan = Plan(names, kd_tree(light, names, room), shards, where)
    C.drop(group)
    return plan


def assign(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, size, text_crc32, shard, slot, split) for every row; ``target_bytes`` sets the number of shards if given."""
    rows, names = measured(docs, text, doc_id)
    rows = C.materialize(rows, "measured")
    plan = planned(rows, names, shards, target_bytes)
    placed = plan.shard(rows, "doc_id").select("row", "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "split")
    placed = C.materialize(placed, "placed")
    C.drop(rows)
    # slots: rows are numbered in chunks by hash of the row, chunks by a running sum
    chunks = max(1, -(-placed.count() // (NUMBERED * plan.shards)))
    chunk = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    count = chunk.groupBy("shard", "chunk").agg(F.count("*").alias("k"))
    base = count.selectExpr("shard", "chunk", "sum(k) OVER (PARTITION BY shard ORDER BY chunk) - k AS base")
    numbered = chunk.selectExpr("*", "row_number() OVER (PARTITION BY shard, chunk ORDER BY row) - 1 AS k")
    return numbered.join(base, ["shard", "chunk"]).select("row", "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), "split")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the rows of ``docs`` as one folder per shard, as ``assign`` places them; a shard is dealt over several tasks."""
    rows, names = measured(docs, text, doc_id)
    plan = planned(C.materialize(rows, "measured"), names, shards, None)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, _ = measured(docs.withColumn("_whole", whole), text, doc_id, "_whole")
    placed = plan.shard(rows, "doc_id").select("shard", F.pmod(F.col("tie"), F.lit(8)).alias("part"), "_whole")
    kept = [F.col("_whole").getField(c).alias(c) for c in docs.columns if c != "shard"]
    placed.repartition("shard", "part").select("shard", *kept).write.partitionBy("shard").parquet(path)


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "split")
