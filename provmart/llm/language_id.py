"""Language identification by rank-order n-gram profiles.

A profile is the list of the ``size`` most frequent letter 1-, 2- and 3-grams
(words padded by one boundary on each side), ties by gram code.  Language profiles
come from the counts over all training texts.  A text gets the language whose
profile has the least out-of-place distance: the sum over the text's profile of
|rank in text - rank in language|, ``size`` where the language lacks the gram.
Ties go to the alphabetically first language.

Letters are lower-cased; those below U+0180 have a symbol each, all others share
127 symbols by a fixed hash, so every script has profiles.

Defined cases: null text and text without a letter give ``und`` with score 0; so
does everything if no training row has a language.  Rows with a null id are never
held out, but are not trained on either.  Repeated rows count as often as they
occur.  Only id, text and language of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SIZE = 300
#: Training folds: crc32(id as text) mod FOLDS; HELD is never trained on.
FOLDS, HELD = 4, 2
UNDETERMINED = "und"
_CHARS = 1 << 18


@lru_cache(1)
def symbols() -> np.ndarray:
    """Code point -> symbol; 0 is everything that is not a letter."""
    out = np.zeros(0x110000, np.uint8)
    latin = sorted({ord(chr(i).lower()) for i in range(0x180) if chr(i).isalpha() and len(chr(i).lower()) == 1})
    number = {c: k for k, c in enumerate((c for c in latin if c < 0x180), 1)}
    if len(number) > 128:
        raise AssertionError("too many symbols")
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = number.get(low) or 129 + low * 40503 % 127
    return out


def _grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every n-gram, unsorted, as one key: text << 26 | code; and letters per text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cp = np.frombuffer(("\n" + "\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[cp].astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths) << np.uint64(26)
    m = len(doc)
    a, b, c = s[:m], s[1 : m + 1], s[2 : m + 2]
    one = a > 0
    two = one | (b > 0)
    three = b > 0
    code2 = (a << np.uint64(8) | b) + np.uint64(1 << 24)
    code3 = (a << np.uint64(16) | b << np.uint64(8) | c) + np.uint64(2 << 24)
    letters = np.bincount((doc[one] >> np.uint64(26)).astype(np.int64), minlength=len(texts))
    return np.concatenate([(doc | a)[one], (doc | code2)[two], (doc | code3)[three]]), letters


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.flatnonzero(first)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= _CHARS or i - lo >= 30_000:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts by language, combined per task."""
    table, names, held, size, most = symbols(), {}, [], 0, 1_000_000

    def combine(parts):
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, at = np.unique(key[order], return_index=True)
        return [(key, np.add.reduceat(n[order], at))]

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=langs.__getitem__)
        langs, texts = [langs[i] for i in order], [texts[i] for i in order]
        for lo, hi in _chunks(texts):
            key, _ = _grams(texts[lo:hi], table)
            if not len(key):
                continue
            lang = np.array([names.setdefault(x, len(names)) for x in langs[lo:hi]], np.uint64)
            code = key & np.uint64((1 << 26) - 1)
            key = lang[(key >> np.uint64(26)).astype(np.int64)] << np.uint64(26) | code
            key.sort()
            held.append(_runs(key))
            size += len(held[-1][0])
            if size > most:
                held = combine(held)
                size = len(held[0][0])
                most = max(most, 2 * size)
    if held:
        by = list(names)
        key, n = combine(held)[0]
        lang = (key >> np.uint64(26)).astype(np.int64)
        for lo in range(0, len(key), 100_000):
            p = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([by[i] for i in lang[p].tolist()]), pa.array((key[p] & np.uint64((1 << 26) - 1)).astype(np.int32)), pa.array(n[p].astype(np.int64))], ["lang", "code", "n"])
    C.give_back()


def train(docs: DataFrame, size: int = SIZE, lang: str = "lang", text: str = "text") -> dict[str, list[int]]:
    """Language -> gram codes, most frequent first, from every row with a language and a text.

    The driver gets ``size`` codes for each language; nothing that grows with the corpus.
    """
    C.narrow_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    total = rows.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.code)
    return out


def _predict(batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], size: int, text: str) -> Iterator[pa.RecordBatch]:
    names, table = sorted(profiles), symbols()
    known = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
    ranks = np.full((len(known) + 1, max(1, len(names))), -1, np.int32)
    for k, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))
    mask = np.uint64((1 << 26) - 1)
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        pred, score = [], []
        for lo, hi in _chunks(texts):
            key, letters = _grams(texts[lo:hi], table)
            best, dist, grams = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
            if len(key) and names:
                key.sort()
                gram, n = _runs(key)
                if n.max() < 1 << 20:
                    least = ((1 << 20) - 1 - n).astype(np.uint64)
                    ranked = (gram >> np.uint64(26)) << np.uint64(46) | least << np.uint64(26) | gram & mask
                    ranked.sort()
                    doc = (ranked >> np.uint64(46)).astype(np.int64)
                else:  # a giant text: its counts do not fit the packed key
                    ranked = gram[np.lexsort((gram & mask, -n, gram >> np.uint64(26)))]
                    doc = (ranked >> np.uint64(26)).astype(np.int64)
                begin = np.searchsorted(doc, np.arange(hi - lo + 1))
                rank = np.arange(len(doc)) - begin[doc]
                keep = rank < size
                doc, rank, code = doc[keep], rank[keep], (ranked[keep] & mask).astype(np.int64)
                at = np.searchsorted(known, code)
                at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == code), at, len(known))
                theirs = ranks[at]
                away = np.where(theirs < 0, size, np.abs(theirs - rank[:, None]))
                grams = np.bincount(doc, minlength=hi - lo)
                total = np.stack([np.bincount(doc, away[:, k], hi - lo) for k in range(len(names))], 1)
                best = total.argmin(1)
                dist = total[np.arange(hi - lo), best]
            for i in range(hi - lo):
                if letters[i] and names:
                    pred.append(names[best[i]]), score.append(max(0.0, 1.0 - dist[i] / (grams[i] * size)))
                else:
                    pred.append(UNDETERMINED), score.append(0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])
    C.give_back()


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (which replace columns of those names). One pass, no shuffle."""
    C.narrow_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double"
    return docs.mapInArrow(lambda it: _predict(it, profiles, size, text), schema)


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(C.fold_of(F.col(doc_id), FOLDS) != HELD)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train(training_rows(docs).select("lang", "text"))
    rows = docs.select("doc_id", F.coalesce(C.fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "text")
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
