"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by piece score (then
leftmost) and merges the best pair until no pair forms a piece; symbols outside
the vocabulary fall back to their UTF-8 bytes.  A pair is only ever merged into
a vocabulary piece, so a text may be cut wherever no piece holds the two
characters on both sides; the cuts used here (before a run of the space mark)
are verified against the vocabulary when a model is loaded.  The pieces between
cuts are encoded once per worker and kept in a bounded table.  Every newly
encoded stretch is compared, in Arrow-batch groups, with the sentencepiece
library; a difference raises.

Null text is the empty text (only the begin and end ids).  Extra columns pass
through untouched; the result columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")
#: Encoded stretches a worker keeps, and the longest that is kept.
TABLE_ENTRIES, TABLE_LENGTH = 400_000, 40
NONE = np.int32(2**31 - 1)


class Codec:
    """The agenda encoder and the decoder of one merge-type model with byte fallback."""

    def __init__(self, model_file: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib, n = self.library, self.library.vocab_size()
        self.check, self.begin, self.end = check, lib.bos_id(), lib.eos_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece = {names[i]: (-lib.get_score(i), i) for i in plain}
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no complete byte fallback")
        inner = re.compile(f"[^{MARK}]{MARK}")
        if any(inner.search(p) for p in self.piece):
            raise ValueError("a piece crosses a word start: texts cannot be cut there")
        probe = lib.encode(" a  b\n c ")
        if lib.decode(probe) != " a  b\n c ":
            raise ValueError("only models with identity normalisation are supported")
        self.known = np.zeros(n, object)
        for i, name in enumerate(names):
            self.known[i] = b"" if lib.is_control(i) else bytes([int(name[3:5], 16)]) if lib.is_byte(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else name.replace(MARK, " ").encode()
        self.marked = np.array([x.startswith(MARK) for x in names])
        self.control = np.array([lib.is_control(i) for i in range(n)])
        self.table: dict[str, bytes] = {}
        self._pairs(plain, names)

    def _pairs(self, plain: list[int], names: list[str]) -> None:
        """Number the symbols (pieces and the single characters in them) and list every pair that forms a piece."""
        symbols = {names[i]: k for k, i in enumerate(plain)}
        for p in list(symbols):
            for c in p:
                symbols.setdefault(c, len(symbols))
        scores = {x: k for k, x in enumerate(sorted({self.piece[names[i]][0] for i in plain}))}
        pairs = {}
        for i in plain:
            p = names[i]
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] << 20 | symbols[p[k:]]] = scores[self.piece[p][0]], symbols[p]
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank, self.pair_made = np.array([pairs[k] for k in sorted(pairs)], np.int32).T.copy()
        self.symbol_id = np.full(len(symbols) + 1, -1, np.int64)
        self.symbol_id[: len(plain)] = plain
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that two symbols form, or NONE."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) << 20 | b)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def together(self, parts: list[str]) -> list[bytes]:
        """Ids of many short stretches: their agendas advance side by side, one best merge each per step."""
        m, size = len(parts), max(map(len, parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        count = np.fromiter(map(len, parts), np.int64, m)
        inside = np.arange(size) < count[:, None]
        symbols = np.full((m, size + 1), -1, np.int32)
        symbols[:, :size][inside] = self.of_char[codes]
        symbols_out, left = np.full((m, size + 1), -1, np.int32), count.copy()
        agenda = np.full((m, size + 1), NONE, np.int32)
        agenda[:, : size - 1] = self._rank(symbols[:, : size - 1], symbols[:, 1:size])
        rows, cols = np.arange(m), np.arange(size)
        odd = np.zeros(m, bool)
        odd[np.repeat(rows, count)[self.symbol_id[self.of_char[codes]] < 0]] = True
        while len(rows):
            best = agenda.argmin(1)
            here = np.arange(len(rows))
            rank = agenda[here, best]
            over = rank == NONE
            if over.any():
                symbols_out[rows[over]] = symbols[over]
                go = ~over
                rows, symbols, agenda, best = rows[go], symbols[go], agenda[go], best[go]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            pair = symbols[here, best].astype(np.int64) << 20 | symbols[here, best + 1]
            symbols[here, best] = self.pair_made[np.searchsorted(self.pair_key, pair)]
            left[rows] -= 1
            step = cols + (cols > best[:, None])
            symbols[:, :size] = np.take_along_axis(symbols, step, 1)
            step = cols + (cols >= best[:, None])
            agenda[:, :size] = np.take_along_axis(agenda, step, 1)
            agenda[here, best] = self._rank(symbols[here, best], symbols[here, best + 1])
            far = best > 0
            agenda[here[far], best[far] - 1] = self._rank(symbols[here[far], best[far] - 1], symbols[here[far], best[far]])
        flat = self.symbol_id[symbols_out[:, :size][np.arange(size) < left[:, None]]].astype("<u4").tobytes()
        ends = np.cumsum(left) * 4
        out = [flat[a:b] for a, b in zip((ends - left * 4).tolist(), ends.tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():  # it holds characters without a piece of their own
            out[i] = np.array(self.stretch(parts[i]), "<u4").tobytes()
        return out

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        fresh: dict[str, bytes] = {}
        parts = sorted(parts, key=len)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        lo = 0
        for most in (5, 8, 11, 15, 23, 39):
            hi = int(np.searchsorted(lengths, most, "right"))
            for k in range(lo, hi, 20_000):
                some = parts[k : min(hi, k + 20_000)]
                fresh.update(zip(some, self.together([MARK + p for p in some]), strict=True))
            lo = hi
        for p in parts[lo:]:
            fresh[p] = np.array(self.stretch(MARK + p), "<u4").tobytes()
        return fresh

    def stretch(self, text: str) -> list[int]:
        """Ids of one stretch: the agenda itself."""
        piece, symbols = self.piece, list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            if both in piece:
                agenda.append((piece[both][0], i, i + 1, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or len(symbols[i]) + len(symbols[j]) != len(both):
                continue  # one side was merged since this pair was put on the agenda
            symbols[i], symbols[j] = both, None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                new = both + symbols[after]
                if new in piece:
                    heapq.heappush(agenda, (piece[new][0], i, after, new))
            before = left[i]
            if before >= 0:
                new = symbols[before] + both
                if new in piece:
                    heapq.heappush(agenda, (piece[new][0], before, i, new))
        out = []
        for s in symbols:
            if s is not None:
                found = piece.get(s)
                out.extend([found[1]] if found else [self.byte[b] for b in s.encode()])
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """Stretches of a text without the mark that each begins with."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _STRETCH.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text, between begin and end."""
        head, tail = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        cuts = [self.cut(t) for t in texts]
        fresh = self.encode_new(list(set().union(*cuts).difference(self.table)))
        if self.check and fresh:
            self.verify(fresh)
        seen = ChainMap(fresh, self.table) if len(self.table) + len(fresh) > TABLE_ENTRIES else None
        if seen is None:
            self.table.update(fresh)
            seen = self.table
        out = [head + b"".join([seen[p] for p in parts]) + tail for parts in cuts]
        if seen is not self.table:  # full: the frequent stretches come back with the next batch
            self.table = {k: v for k, v in fresh.items() if len(k) <= TABLE_LENGTH} if len(fresh) < TABLE_ENTRIES else {}
        return out

    def verify(self, fresh: dict[str, bytes]) -> None:
        """Compare newly encoded stretches with the library, which adds the leading mark itself."""
        keys = [k for k in fresh if k]  # it gives nothing at all for an empty input
        want = self.library.encode([k.replace(MARK, " ") for k in keys], num_threads=1)
        flat = np.fromiter(chain.from_iterable(want), "<u4").tobytes()
        if flat != b"".join([fresh[k] for k in keys]) or any(len(w) * 4 != len(fresh[k]) for w, k in zip(want, keys, strict=True)):
            bad = next(k for w, k in zip(want, keys, strict=True) if np.array(w, "<u4").tobytes() != fresh[k])
            raise AssertionError(f"the agenda and the library differ on {bad[:80]!r}")

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, one leading space removed, broken UTF-8 replaced."""
        ids_ = np.frombuffer(ids, "<u4")
        raw = b"".join(self.known[ids_].tolist())
        first = ids_[~self.control[ids_]][:1]
        raw = raw[1:] if len(first) and self.marked[first[0]] else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(2)
def _codec(model_file: str, check: bool) -> Codec:
    """One codec, with its table, for all tasks of a worker."""
    return Codec(model_file, check)


#: Result columns, in order.
RESULT = "n_tokens long, ids binary, decoded string"


def _batches(batches: Iterator[pa.RecordBatch], model_file: str, column: str, digests: bool, check: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(model_file, check)
    C.give_back()
    for big in batches:
        for lo in range(0, big.num_rows, 256):
            batch = big.slice(lo, 256)
            texts = [t or "" for t in batch.column(column).to_pylist()]
            ids = codec.encode_all(texts)
            back = [codec.decode(x) for x in ids]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                more = [counts, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
            else:
                more = [counts, pa.array(ids, pa.binary()), pa.array(back)]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != column or not digests]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + more, [n for n, _ in rest] + (["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]))


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", digests: bool = False, check: bool = True) -> DataFrame:
    """Add n_tokens, ids (little-endian 32-bit) and decoded to every row.

    ``digests`` gives ids_sha256 and decoded_sha256 instead and drops the text, so
    that no text or id list travels on.  No shuffle: one pass over the input.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    C.narrow_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in added if c in docs.columns and c != text])
    kept = [f for f in docs.schema.fields if f.name != text or not digests]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = (types + ", " if types else "") + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else RESULT)
    return docs.mapInArrow(lambda it: _batches(it, model_file, text, digests, check), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, default_model(), digests=True).select("doc_id", "n_tokens", F.col("ids_sha256"), F.col("decoded_sha256"))
