"""Shared pieces: work tables in the shared folder, vectorised tokens, hash exchange, components.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Those separators are
ASCII, so byte work on UTF-8 gives the same words as a pattern over code points.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import work

_CHUNK = 1 << 19
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: For loose matching: only ASCII letters and digits, and all bytes above 127, belong to words.
NOT_ALNUM = np.array([not (chr(i).isalnum() or i > 127) for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- work tables


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this process only where none is set and all runs in it (tests)."""
    return work.folder(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/work/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete work tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "work_path", None):
            delete(df.sparkSession, path)


def small_side(df: DataFrame, bound_bytes: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit the bound, else unchanged (shuffle join).

    ``df`` must be a work table, so that the count is a footer read.
    """
    return F.broadcast(df) if df.count() * row_bytes <= bound_bytes else df


def one_side(df: DataFrame, most_rows: int, row_bytes: int, name: str, bound_bytes: int = 32 << 20) -> DataFrame:
    """An aggregate of at most ``most_rows`` rows as the side of a join: broadcast if that bound fits.

    A larger one is written first: then both sides of the join are plain exchanges, and adaptive
    execution can split the rows of a heavy key, which it does not with an aggregate below the join.
    """
    return F.broadcast(df) if most_rows * row_bytes <= bound_bytes else materialize(df, name)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first().n


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; null where the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so clashing extra columns cannot interfere."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


#: Rows of whole texts that a Python worker gets at once; the buffers on both sides follow this.
BATCH_ROWS = 2000


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches of whole texts to ``BATCH_ROWS``; smaller ones stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


@lru_cache(1)
def one_thread() -> None:
    """Matrix products of this worker on one thread, as Spark gives a task one core; other BLAS libraries are left as they are."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def give_back() -> None:
    """Return freed memory to the system, as workers idle between tasks while others run."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


# ------------------------------------------------------------- numpy tokens


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n; the table doubles when it is too short."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (key, pow(key, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers[key] = (out[0], out[1])
        if size > 1 << 20:  # a giant text: do not keep its table
            _powers.pop(key)
    return have


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end], for all spans at once."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of consecutive whole texts: byte spans, the text of each word, words per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = _SEPARATOR):
        self.data = LOWER[data] if lower else data
        self.offsets, self.n_docs = offsets, len(offsets) - 1
        sep = separator[data]
        word = ~sep
        begin, end = word.copy(), word.copy()
        begin[1:] &= sep[:-1]
        end[:-1] &= sep[1:]
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[first], end[last] = word[first], word[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        return span_hash(_BYTE[self.data], self.start, self.end)

    def windows(self, k: int) -> np.ndarray:
        """Ordinals of the words at which k words of one text begin."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array without copying more than needed; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def word_chunks(texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR, size: int = _CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words): whole texts in chunks of about ``size`` bytes."""
    raw, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower, separator)
        lo = hi


# ------------------------------------------------------------ hash exchange


def fragment_count(n_bytes: int, target: int = 8 << 20) -> int:
    """A power of two so that a fragment holds the keys of about ``target`` bytes of text."""
    return 1 << max(6, (max(1, n_bytes // target) - 1).bit_length())


def cut(frag: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by fragment, and where each fragment begins in it."""
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    order = np.argsort(frag.astype(kind), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(frag, minlength=n))])


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack_rising(x: np.ndarray) -> bytes:
    """Rising positions as gaps of two bytes, or four where a gap does not fit."""
    gaps = np.diff(x, prepend=0)
    wide = len(gaps) and int(gaps.max()) > 65535
    return (b"\4" if wide else b"\2") + gaps.astype("<u4" if wide else "<u2").tobytes()


def unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<u4" if b[:1] == b"\4" else "<u2", offset=1), dtype=np.int64)


# --------------------------------------------------------------- components


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links by alternating large and small stars.

    Returns (id, component): the smallest id reachable.  Every round is one
    aggregate with map-side combining and one equi-join per star, written to the
    shared folder; nothing but a sum reaches the driver.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    n, before = edges.count(), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(one_side(low, 2 * n, 16, "low"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(one_side(least, 2 * n, 16, "least"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        drop(edges)
        edges = after
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.count_distinct("a").alias("d")).first()
        n = now.n
        if before == now and now.n == now.d:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
