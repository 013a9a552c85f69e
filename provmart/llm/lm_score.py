"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words of the text with A-Z lower-cased, then one end.  The model predicts
a token from the two before it (the end stands before the beginning):

    s(c | a, b) = q_c . (C1 * r_b + C2 * r_a) + bias_c

The most frequent words and the end are classes of their own; all other words share
classes by their last letters.  This is the top of a class tree.  Below it, the most
frequent words of each shared class, ``GROWTH`` times the root of the training tokens in
all, are units with vectors of their own, as inputs and as outputs, and one unit stands
for the rest of the class.  ``GROUP`` units of a class, next to each other by frequency,
form a group:

    P(w | a, b) = P(class | a, b) * P(group | class, a, b) * P(unit | group, a, b) * P(w | unit)

The network gives the first three factors, each normalised in blocks by a matrix product.
The fourth is 1 for a word with a unit, and its smoothed frequency in the rest of its class.
So the probabilities of all words, with one unseen word per class, sum to one.

Training gathers three things from the whole training part of the corpus: the count of
every word, the count of every triple of classes (bounded by classes**3), and what one
pass over all tokens changes in the vectors of the words.  For the classes the NCE
objective and its noise expectation are exact sums over all observed contexts, computed
in numpy as batched matrix products.  The vectors of words start as those of their
classes; they are trained by NCE on pieces of the corpus, with noise classes and groups drawn
for a step and a noise unit of the same group for each token, and the changes are
averaged by how often a piece used a word.  Pieces hold about ``PIECE`` tokens and are dealt by a
hash of id and text, so the scores depend neither on files nor on the number of tasks, and
a larger corpus has more pieces, not smaller ones.

Words beyond the ``FREQUENT`` most frequent are scored by a join with the word counts.
Words are told apart by 64-bit hashes.

Defined cases: null text is the empty text (one end).  A row with a null id belongs to
no fold: it is neither trained on nor held out.  Repeated rows count, and are scored,
as often as they occur.  An empty training part leaves N = V = 0: the base score is
then that of one uniform unseen word, and so is the model's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD = 10, 0
#: Words that are classes of their own; ending classes; vector size; words scored without a join.
TOP, ENDINGS, DIM, FREQUENT = 96, 63, 24, 1 << 18
END = TOP + ENDINGS
CLASSES = END + 1
ALPHA = 0.1
#: NCE: noise samples per token (as an expectation), epochs, contexts per step, Adam's rate.
NOISE, EPOCHS, STEP, RATE = 8, 24, 512, 0.02
#: Words with vectors of their own, per root of the training tokens; units of a group.
GROWTH, GROUP = 4, 8
#: Tokens per step (at least half the units); classes, and groups of each class, drawn as noise for a step;
#: what the noise of a group counts; Adagrad's rate; rows of a block of vectors sent to the driver.
WORD_STEP, NOISE_CLASSES, NOISE_GROUPS, NOISE_WORDS, WORD_RATE, BLOCK = 16_384, 32, 16, 2, 0.1, 4096
#: Bytes of text scored or trained on at once.
CHUNK = 1 << 20
#: Training tokens of a piece, on which one task trains from the common start.
PIECE = 8_000_000


def _ending(w: C.Words) -> np.ndarray:
    """The ending class of every word: a hash of its last two bytes."""
    last = w.data[w.end - 1].astype(np.int64)
    long = w.end - w.start > 1
    before = np.where(long, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return TOP + (last * 31 + before * 131) % ENDINGS


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, ending class, count) combined over some megabytes of text."""
    held, size = [], 0

    def flush():
        nonlocal held, size
        h, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        h, at, n = np.unique(h, return_index=True, return_counts=True)
        cls = cls[at]
        held, size = [], 0
        for lo in range(0, len(h), 200_000):
            p = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[p].view(np.int64)), pa.array(cls[p].astype(np.int32)), pa.array(n[p].astype(np.int64))], ["h", "cls", "n"])

    for batch in batches:
        for _, _, w in C.word_chunks(batch.column(0), lower=True):
            held.append((w.hashes(), _ending(w)))
            size += len(w.start)
            if size >= 4_000_000:
                yield from flush()
    if held:
        yield from flush()


class Vocabulary:
    """Frequent words by hash: count and class; and the class totals."""

    def __init__(self, h, n, cls, totals, n_docs: int):
        n_top = min(TOP, len(h))
        top = np.lexsort((h, -n))[:n_top]
        cls = cls.copy()
        own_n, own_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, (total, distinct) in totals.items():
            own_n[c], own_v[c] = total, distinct
        np.subtract.at(own_n, cls[top], n[top])
        np.subtract.at(own_v, cls[top], 1)
        cls[top] = np.arange(n_top)
        order = np.argsort(h)
        self.h, self.n, self.cls = h[order], n[order], cls[order]
        self.size_n, self.size_v, self.n_top = own_n, own_v, n_top
        self.total = int(sum(t for t, _ in totals.values())) + n_docs
        self.distinct = int(sum(v for _, v in totals.values())) + (n_docs > 0)
        self.n_docs = n_docs
        self._units(np.lexsort((self.h, -self.n))[: max(n_top, int(np.ceil(GROWTH * np.sqrt(self.total))))])

    def _units(self, some: np.ndarray) -> None:
        """Units of the network: in each shared class its words among ``some``, most frequent first, then one for the rest.

        A class begins a new group, so units have places in groups; places without a unit have no mass.
        """
        some = some[(self.cls[some] >= self.n_top) & (self.cls[some] >= TOP)]
        cls = np.concatenate([self.cls[some], np.arange(TOP, END)])
        own_n, own_v = np.bincount(self.cls[some], self.n[some], CLASSES), np.bincount(self.cls[some], minlength=CLASSES)
        #: the mass of what is left of a class, one unseen word included
        self.rest_mass = self.size_n - own_n + ALPHA * (self.size_v - own_v + 1)
        order = np.argsort(cls, kind="stable")
        per_class = np.bincount(cls, minlength=CLASSES)
        groups = -(-per_class // GROUP)
        self.group_first = np.concatenate([[0], np.cumsum(groups)])
        self.group_cls = np.repeat(np.arange(CLASSES), groups)
        self.unit_cls = cls[order]
        begin = np.concatenate([[0], np.cumsum(per_class)])
        self.place = self.group_first[self.unit_cls] * GROUP + np.arange(len(cls)) - begin[self.unit_cls]
        number = np.empty(len(cls), np.int64)
        number[order] = np.arange(len(cls))
        self.unit = np.full(len(self.h), -1, np.int64)
        self.unit[some] = number[: len(some)]
        self.rest = np.full(CLASSES, -1, np.int64)
        self.rest[TOP:END] = number[len(some) :]
        mass = np.zeros(len(self.group_cls) * GROUP)
        mass[self.place[self.unit[some]]], mass[self.place[self.rest[TOP:END]]] = self.n[some] + ALPHA, self.rest_mass[TOP:END]
        of_group = mass.reshape(-1, GROUP).sum(1)
        self.unit_share = (mass / np.repeat(of_group, GROUP)).astype(np.float32).reshape(-1, GROUP)
        self.group_share = of_group / np.bincount(self.group_cls, of_group, CLASSES)[self.group_cls]
        with np.errstate(divide="ignore"):
            self.unit_log = np.maximum(np.log(self.unit_share), np.float32(-1e9))
        self.group_log = np.log(self.group_share).astype(np.float32)
        #: of an input: a class, or past the classes a unit
        self.input_cls = np.concatenate([np.arange(CLASSES), self.unit_cls])

    def inputs(self, cls: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The input of every word: its unit, or else its class."""
        unit = np.where(known, self.unit[at], -1) if len(self.h) else np.full(len(cls), -1)
        return np.where(unit >= 0, CLASSES + unit, cls)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is in the table, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if len(h) > 2000:  # look up each distinct hash once, in order
            some, back = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(self.h, some), len(self.h) - 1)[back]
        else:
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def classes(self, w: C.Words, h: np.ndarray):
        at, known = self.find(h)
        cls = _ending(w)
        if len(self.h):
            cls = np.where(known, self.cls[at], cls)
        return cls, at, known


def _sequences(w: C.Words, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class triples with ends put in: (a, b, c, text of c)."""
    count = w.count + 3  # two ends before, one after
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    seq = np.full(int(count.sum()), END, np.int64)
    place = np.arange(len(cls)) + 3 * w.doc + 2
    seq[place] = cls
    doc = np.repeat(np.arange(w.n_docs), count)
    use = np.ones(len(seq), bool)
    use[begin] = use[begin + 1] = False
    at = np.flatnonzero(use)
    return seq[at - 2], seq[at - 1], seq[at], doc[at]


def _count_triples(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.uint32)
    for batch in batches:
        keys = []
        for _, _, w in C.word_chunks(batch.column(0), lower=True):
            cls, _, _ = vocabulary.value.classes(w, w.hashes())
            a, b, c, _ = _sequences(w, cls)
            keys.append((a * CLASSES + b) * CLASSES + c)
        if keys:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            total[key] += n.astype(np.uint32)
    for a in range(CLASSES):
        own = total[a * CLASSES**2 : (a + 1) * CLASSES**2]
        at = np.flatnonzero(own)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([own[at].astype("<u8").tobytes()], pa.binary())], ["a", "at", "n"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(CLASSES**2, np.float64)
    for at, n in zip(table.column("at"), table.column("n"), strict=True):
        total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<u8")
    at = np.flatnonzero(total)
    return pa.table({"a": table.column("a").slice(0, 1), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "n": pa.array([total[at].astype("<u8").tobytes()], pa.binary())})


class LogBilinear:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.word, self.out = rng.normal(0, 0.1, (CLASSES, DIM)), rng.normal(0, 0.1, (CLASSES, DIM))
        self.near, self.far = np.ones(DIM), np.full(DIM, 0.5)
        self.bias = np.zeros(CLASSES)

    def parameters(self) -> list[np.ndarray]:
        return [self.word, self.out, self.near, self.far, self.bias]

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unnormalised scores of all classes after contexts (a, b): one matrix product."""
        return (self.near * self.word[b] + self.far * self.word[a]) @ self.out.T + self.bias

    def table(self) -> np.ndarray:
        """log10 P(class | a, b), normalised over the classes, for all contexts in batches."""
        a, b = np.divmod(np.arange(CLASSES**2), CLASSES)
        out = np.empty((CLASSES**2, CLASSES), np.float32)
        for lo in range(0, len(a), 4096):
            s = self.scores(a[lo : lo + 4096], b[lo : lo + 4096])
            s -= s.max(1, keepdims=True)
            out[lo : lo + 4096] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out.reshape(-1)

    def train(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> None:
        """NCE over all observed contexts; noise is the classes' own frequency."""
        class_n = np.zeros(CLASSES)
        row, col, n = [], [], []
        for a, (at, k) in sorted(counts.items()):
            b, c = np.divmod(at, CLASSES)
            row.append(a * CLASSES + b), col.append(c), n.append(k)
        if not row:
            return
        row, col, n = (np.concatenate(x) for x in (row, col, n))
        np.add.at(class_n, col, n)
        noise = (class_n + 0.01) / (class_n + 0.01).sum()
        self.bias = np.log(noise)
        shift = np.log(NOISE * noise)
        contexts, first = np.unique(row, return_index=True)
        edge = np.append(first, len(row))
        rng = np.random.default_rng(seed)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(contexts))
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for lo in range(0, len(order), STEP):
                some = np.sort(order[lo : lo + STEP])
                data = np.zeros((len(some), CLASSES))
                for i, j in enumerate(some):
                    data[i, col[edge[j] : edge[j + 1]]] = n[edge[j] : edge[j + 1]]
                a, b = np.divmod(contexts[some], CLASSES)
                r = self.near * self.word[b] + self.far * self.word[a]
                p = 1 / (1 + np.exp(np.clip(shift - r @ self.out.T - self.bias, -30, 30)))
                weight = data.sum(1, keepdims=True)
                # gradient of sum n log p + NOISE * sum N noise log(1 - p), scaled by the step's tokens
                g = (data * (1 - p) - weight * NOISE * noise * p) / weight.sum()
                gr = g @ self.out
                gw = np.zeros_like(self.word)
                np.add.at(gw, b, gr * self.near)
                np.add.at(gw, a, gr * self.far)
                grads = [gw, g.T @ r, (gr * self.word[b]).sum(0), (gr * self.word[a]).sum(0), g.sum(0)]
                step += 1
                for param, (m, v), grad in zip(self.parameters(), state, grads, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


    def add_words(self, vocabulary: Vocabulary) -> None:
        """Vectors of words: as inputs those of their class, as outputs none, which gives each its frequency."""
        self.inputs = self.word[vocabulary.input_cls].astype(np.float32)
        self.groups = np.zeros((len(vocabulary.group_cls), DIM), np.float32)
        self.units = np.zeros((len(vocabulary.group_cls) * GROUP, DIM), np.float32)

    def tables(self) -> list[np.ndarray]:
        return [self.inputs, self.groups, self.units]

    def contexts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r, more = self.inputs.take(b, 0), self.inputs.take(a, 0)
        r *= self.near.astype(np.float32)
        more *= self.far.astype(np.float32)
        r += more
        return r

    def log_class(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """ln P(class | context), normalised over the classes in blocks."""
        out, q, bias = np.empty(len(c), np.float32), np.ascontiguousarray(self.out.T, np.float32), self.bias.astype(np.float32)
        for lo in range(0, len(c), 2048):
            out[lo : lo + 2048] = _log_share(r[lo : lo + 2048] @ q, bias, c[lo : lo + 2048])
        return out

    def log_unit(self, r: np.ndarray, unit: np.ndarray, v: Vocabulary) -> np.ndarray:
        """ln P(unit | its class, context): over the groups of the class, then over the units of the group."""
        out, place = np.empty(len(unit), np.float32), v.place[unit]
        order = by_group(place)
        group = place[order] // GROUP
        edge = np.searchsorted(group, v.group_first)
        of_group = self.units.reshape(-1, GROUP, DIM)
        for g in range(TOP, END):
            first, last = v.group_first[g], v.group_first[g + 1]
            q, bias = np.ascontiguousarray(self.groups[first:last].T), v.group_log[first:last]
            rows = max(64, (1 << 18) // max(1, last - first))
            for lo in range(edge[g], edge[g + 1], rows):
                hi = min(lo + rows, edge[g + 1])
                some, at = order[lo:hi], group[lo:hi]
                out[some] = _log_share(r.take(some, 0) @ q, bias, at - first)
        for lo in range(0, len(order), 4096):
            some, at = order[lo : lo + 4096], group[lo : lo + 4096]
            out[some] += _log_share(np.einsum("nkd,nd->nk", of_group.take(at, 0), r.take(some, 0)), v.unit_log.take(at, 0), place[some] % GROUP)
        return out


def by_group(place: np.ndarray) -> np.ndarray:
    """The order of tokens by the group of their unit."""
    group = place // GROUP
    return np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")


def _log_share(s: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ln softmax of s + bias at one column of each row."""
    s += bias
    top = s.max()
    if top - s[:, 0].min() < 60:  # one shift for all rows cannot underflow the largest score of a row
        s -= top
    else:
        s -= s.max(1, keepdims=True)
    own = s[np.arange(len(at)), at]
    return own - np.log(np.exp(s, out=s) @ np.ones(s.shape[1], np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _add_rows(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """table[ids] += rows, with repeated ids.

    The views give arrays that were unpickled numpy's own type objects; without, numpy takes a path 15 times as slow.
    """
    at = (ids[:, None] * DIM + np.arange(DIM)).ravel()
    np.add.at(table.reshape(-1).view(np.float32), at.view(np.int64), rows.ravel().view(np.float32))


class _Step:
    """Adagrad on the rows of one table, with one scale a row."""

    def __init__(self, table: np.ndarray):
        self.before, self.now, self.grads = table, table.copy(), np.zeros_like(table)
        self.squares, self.used = np.full(len(table), 1e-6, np.float32), np.zeros(len(table), np.float32)

    def add(self, ids: np.ndarray, grads: np.ndarray) -> None:
        _add_rows(self.grads, ids, grads)
        self.used += np.bincount(ids, minlength=len(self.used))

    def move(self) -> None:
        """Rows along what was added since the last move."""
        size = np.einsum("ij,ij->i", self.grads, self.grads)
        some = np.flatnonzero(size)
        self.squares[some] += size[some] / DIM
        grads = self.grads.take(some, 0)
        grads *= (WORD_RATE / np.sqrt(self.squares[some]))[:, None]
        self.now[some] += grads
        self.grads[some] = 0

    def changed(self, kind: int) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.now), BLOCK):
            at = lo + np.flatnonzero(self.used[lo : lo + BLOCK])
            if len(at):
                change = self.now[at] - self.before[at]
                columns = [(at - lo).astype("<u2"), self.used[at].astype("<f4"), change.astype("<f2")]
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([lo], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], ["kind", "first", "at", "n", "change"])


def _train_words(batches: Iterator[pa.RecordBatch], vocabulary, model) -> Iterator[pa.RecordBatch]:
    """One pass of NCE over the tokens of a piece, with sampled noise; gives what changed, weighted by use."""
    C.one_thread()
    v, m = vocabulary.value, model.value
    inputs, groups, units = (_Step(t) for t in m.tables())
    local = LogBilinear()
    local.near, local.far, local.inputs = m.near, m.far, inputs.now
    near, far, out = m.near.astype(np.float32), m.far.astype(np.float32), m.out.astype(np.float32)
    noise = np.exp(m.bias) / np.exp(m.bias).sum()
    odds = (m.bias - np.log(NOISE * noise)).astype(np.float32)
    up = np.cumsum(v.group_share)  # a whole number is reached at the end of each class
    within, less = np.cumsum(v.unit_share, 1), np.float32(np.log(NOISE_WORDS))
    rng = np.random.default_rng(7)
    step = max(WORD_STEP, len(v.unit_cls) // 2)

    def inner(r: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Moves groups and units by the tokens of shared classes, sorted by group; gives the gradient of their contexts."""
        group = place // GROUP
        # groups: the true one, and some of its class drawn as noise
        q = groups.now.take(group, 0)
        p = 1 - _sigmoid(np.einsum("ij,ij->i", r, q) - less)
        gr = p[:, None] * q
        groups.add(group, p[:, None] * r)
        edge = np.searchsorted(group, v.group_first)
        for g in range(TOP, END):
            if edge[g] < edge[g + 1]:
                own = slice(edge[g], edge[g + 1])
                drawn = np.minimum(np.searchsorted(up, g - TOP + rng.random(NOISE_GROUPS)), v.group_first[g + 1] - 1)
                q = groups.now[drawn]
                p = _sigmoid(r[own] @ q.T - less)
                p *= np.float32(NOISE_WORDS / NOISE_GROUPS)
                gr[own] -= p @ q
                _add_rows(groups.grads, drawn, -(p.T @ r[own]))
        groups.move()
        # units: the true one, and one of the same group drawn as noise
        other = group * GROUP + np.minimum((within.take(group, 0) < rng.random(len(place), np.float32)[:, None]).sum(1), GROUP - 1)
        for some, label in ((place, 1), (other, 0)):
            q = units.now.take(some, 0)
            g = (label - _sigmoid(np.einsum("ij,ij->i", r, q)))[:, None]
            q *= g
            gr += q
            units.add(some, g * r)
        units.move()
        return gr

    for batch in batches:
        for _, _, w in C.word_chunks(batch.column(0), lower=True, size=CHUNK):
            cls, at, known = v.classes(w, w.hashes())
            a, b, c, _ = _sequences(w, v.inputs(cls, at, known))
            for lo in range(0, len(c), step):
                x, y, z = a[lo : lo + step], b[lo : lo + step], c[lo : lo + step]
                r = local.contexts(x, y)
                k = v.input_cls[z]
                gr = out.take(k, 0)
                gr *= (1 - _sigmoid(np.einsum("ij,ij->i", r, gr) + odds[k]))[:, None]
                drawn = rng.choice(CLASSES, NOISE_CLASSES, p=noise)
                gr -= np.float32(NOISE / NOISE_CLASSES) * (_sigmoid(r @ out[drawn].T + odds[drawn]) @ out[drawn])
                inside = np.flatnonzero((k >= TOP) & (k < END))
                if len(inside):
                    place = v.place[np.where(z[inside] >= CLASSES, z[inside] - CLASSES, v.rest[k[inside]])]
                    order = by_group(place)
                    inside = inside[order]
                    gr[inside] += inner(r.take(inside, 0), place[order])
                # the vectors of classes stay
                for ids, scale in ((x, far), (y, near)):
                    own = np.flatnonzero(ids >= CLASSES)
                    inputs.add(ids[own], gr.take(own, 0) * scale)
                inputs.move()
    for kind, table in enumerate((inputs, groups, units)):
        yield from table.changed(kind)
    C.give_back()


def _mean_change(table: pa.Table) -> pa.Table:
    """The mean change of each row of a block, by how often tasks used it."""
    total, weight = np.zeros((BLOCK, DIM)), np.zeros(BLOCK)
    for at, n, change in zip(table.column("at"), table.column("n"), table.column("change"), strict=True):
        at, n = np.frombuffer(at.as_py(), "<u2"), np.frombuffer(n.as_py(), "<f4")
        total[at] += n[:, None] * np.frombuffer(change.as_py(), "<f2").reshape(-1, DIM)
        weight[at] += n
    mean = (total / np.maximum(weight, 1)[:, None]).astype("<f4")
    return pa.table({"kind": table.column("kind").slice(0, 1), "first": table.column("first").slice(0, 1), "change": pa.array([mean.tobytes()], pa.binary())})


def _score(batches: Iterator[pa.RecordBatch], vocabulary, model) -> Iterator[pa.RecordBatch]:
    """Per text: what frequent words and the end give, and the hashes of all other words."""
    C.one_thread()
    v = vocabulary.value
    m = model.value
    rest = np.log10(v.rest_mass)
    denominator = np.log10(v.total + ALPHA * (v.distinct + 1))
    own = np.arange(CLASSES) < v.n_top
    own[END] = True
    log_n = np.log10(v.n + ALPHA)
    for batch in batches:
        for lo, hi, w in C.word_chunks(batch.column("t"), lower=True, size=CHUNK):
            h = w.hashes()
            cls, at, known = v.classes(w, h)
            a, b, c, doc = _sequences(w, v.inputs(cls, at, known))
            n = hi - lo
            r, k = m.contexts(a, b), v.input_cls[c]
            net = m.log_class(r, k).astype(float)
            shared = np.flatnonzero(~own[k])
            net[shared] += m.log_unit(r[shared], np.where(c[shared] >= CLASSES, c[shared] - CLASSES, v.rest[k[shared]]), v)
            net = np.bincount(doc, net / np.log(10), n)
            inside = ~own[cls] & ~(known & (v.unit[at] >= 0) if len(v.h) else False)
            logs = np.where(known, log_n[at] if len(log_n) else 0, 0)
            # words without a unit: log(c + alpha) - log of the mass of their rest; rare ones get log(c + alpha) from the join
            word = np.bincount(w.doc[inside], logs[inside] - rest[cls[inside]], n)
            base = np.bincount(w.doc, logs, n) + np.log10(v.n_docs + ALPHA) - (w.count + 1) * denominator
            rare = np.flatnonzero(~known)
            edge = np.searchsorted(w.doc[rare], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *[x.slice(lo, n) for x in batch.columns[:-1]],
                    pa.array(w.count + 1),
                    pa.array(np.bincount(w.doc, known, n).astype(np.int64) + int(v.n_docs > 0)),
                    pa.array(base),
                    pa.array(net + word),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(h[rare].view(np.int64))),
                ],
                [*batch.schema.names[:-1], "n_tokens", "known", "base", "model", "rare"],
            )


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The ``most`` words of greatest count, ties by hash, without a sort of more than little more than these.

    Counts fall into bins: each of its own below 1,024, above that by their first ten bits.  The bin in which the
    ``most``-th word lies is cut by a threshold on the hash, as by far most words may share one small count.
    """
    wide = F.greatest(F.lit(0), F.length(F.bin("n")) - 10)
    bin_ = F.col("n") - F.pmod(F.col("n"), F.pow(F.lit(2.0), wide).cast("long"))
    sized = words.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k")).collect()  # some thousands of bins at most
    above = 0
    for r in sorted(sized, key=lambda r: -r.bin):
        if above + r.k >= most:
            need = most - above
            share = min(1.0, (need + 10 * need**0.5 + 10) / r.k)
            edge = F.col("h") < F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))) if share < 1 and r.bin < 1024 else F.lit(True)
            words = words.where((bin_ > r.bin) | (bin_ == r.bin) & edge)
            break
        above += r.k
    return words.orderBy(F.desc("n"), "h").limit(most)


def pieces(docs: DataFrame, text: str, doc_id: str, tokens: int, size: int) -> DataFrame:
    """The texts dealt by a hash of id and text into pieces of about ``size`` tokens, each in a fixed order.

    What is learnt then depends neither on files nor on cores, and the tokens of a piece are the same for any corpus.
    """
    key = [F.col(c) for c in (text, doc_id) if c in docs.columns]
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(*key).alias("h"))
    return rows.repartition(max(1, -(-tokens // size)), "h").sortWithinPartitions("h", "t").select("t")


def train(docs: DataFrame, text: str = "text", epochs: int = EPOCHS, doc_id: str = "doc_id", piece: int = PIECE) -> tuple[DataFrame, Vocabulary, LogBilinear]:
    """(word counts, frequent words and class totals, network) from every row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("t"))
    words = texts.mapInArrow(_count_words, "h long, cls int, n long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))
    words = C.materialize(words, "words")
    totals = {r.cls: (r.total, r.k) for r in words.groupBy("cls").agg(F.sum("n").alias("total"), F.count("*").alias("k")).collect()}
    # the bound of the table that is broadcast: FREQUENT rows of 20 bytes
    frequent = most_frequent(words, FREQUENT)
    got = frequent.toArrow() if totals else None
    cols = [got.column(c).to_numpy() for c in ("h", "n", "cls")] if got else [np.zeros(0, np.int64)] * 3
    vocabulary = Vocabulary(cols[0].astype(np.int64).view(np.uint64), cols[1].astype(np.int64), cols[2].astype(np.int64), totals, docs.count())
    shared = spark.sparkContext.broadcast(vocabulary)
    parts = texts.mapInArrow(lambda it: _count_triples(it, shared), "a int, at binary, n binary")
    triples = parts.groupBy("a").applyInArrow(_add, "a int, at binary, n binary")
    counts = {r.a: (np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.n, "<u8").astype(np.float64)) for r in triples.toLocalIterator()}
    model = LogBilinear()
    model.train(counts, epochs)
    model.add_words(vocabulary)
    start = spark.sparkContext.broadcast(model)
    dealt = pieces(docs, text, doc_id, vocabulary.total, piece)
    parts = dealt.mapInArrow(lambda it: _train_words(it, shared, start), "kind int, first long, at binary, n binary, change binary")
    for r in parts.groupBy("kind", "first").applyInArrow(_mean_change, "kind int, first long, change binary").toLocalIterator():
        table = model.tables()[r.kind][r.first : r.first + BLOCK]
        table += np.frombuffer(r.change, "<f4").reshape(-1, DIM)[: len(table)]
    return words, vocabulary, model


def score(docs: DataFrame, words: DataFrame, vocabulary: Vocabulary, model: LogBilinear, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    v, m = sc.broadcast(vocabulary), sc.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = rows.mapInArrow(lambda it: _score(it, v, m), f"doc_id {kind}, n_tokens long, known long, base double, model double, rare array<long>")
    first = C.materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = first.where("size(rare) > 0").select("row", F.explode("rare").alias("h")).groupBy("h", "row").count()
    found = rare.join(words.select("h", "n"), "h", "left")
    logs = found.groupBy("row").agg(F.sum(F.col("count") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("count")).otherwise(0)).alias("seen"))
    out = first.drop("rare").join(logs, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(C.fold_of(F.col(doc_id), FOLDS) != HELD)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, *train(training_rows(docs)))
    held = F.coalesce(C.fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
