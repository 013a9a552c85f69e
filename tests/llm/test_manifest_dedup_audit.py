"""Merkle manifest, content sort and term audit against brute force, on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provmart.llm import common as C
from provmart.llm import content_sort, merkle, term_audit

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\x00", "One", "two Words", "x" * 3000, "\U0001f642 é\n\t ÉA ß", "La " * 4000, "A-b_c9D"]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, source, lang, n_chars, text): a source that holds most rows, lone sources, nulls, repeats."""
    r = random.Random(3)
    out = []
    for i in range(1200):
        source = "hot" if i < 700 else r.choice([None, "", "é", "z", "a", *(f"s{k}" for k in range(30))])
        text = r.choice(ODD) if i % 9 == 0 else " ".join(r.choice("alpha Beta gamma delta Épsilon".split()) for _ in range(r.randrange(8)))
        out.append((i * 7, source, r.choice([None, "en", "de"]), r.choice([None, i]), text))
    out += [(None, "hot", "en", 1, "none"), (None, None, None, None, None), (70, "hot", "en", 5, "again"), (70, "hot", "en", 5, "again"), (77, "lone", None, 0, "only ONE")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1, "c") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, tree string")


# 11


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([merkle.hashed(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def runs_of(levels, i):
    for level in levels[:-1]:
        yield level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        i //= 16


def manifest_by_hand(rows):
    leaf = lambda r: merkle.hashed([field(v) for v in r])
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for x in by.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf(r) for r in by[s]]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = [*runs_of(trees[s], i), *runs_of(top, k)]
            proof = merkle.hashed([x for run, j in steps for m, x in enumerate(run) if m != j])
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].translate(LOW)) if forged else r)
            for run, j in steps:
                h = merkle.hashed([*run[:j], h, *run[j + 1 :]])
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]


def proved(docs):
    forged = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if f == "text" else F.col(f) for f in merkle.FIELDS]
    return merkle.prove(merkle.manifest(docs, forged=forged, when=C.fold_of(F.col("doc_id"), 5) == 0))


@pytest.mark.parametrize("frontier", [merkle.FRONTIER_ROWS, 3])
def test_proofs_equal_those_made_by_hand(docs, rows, monkeypatch, frontier):
    monkeypatch.setattr(merkle, "FRONTIER_ROWS", frontier)
    got = collections.Counter(tuple(r) for r in proved(docs).collect())
    want = collections.Counter(manifest_by_hand(rows))
    assert got == want and 0 < sum(not r[-1] for r in want) < len(rows)


def test_manifests_of_one_row_one_source_and_none(docs, rows):
    for few in ("doc_id = 77 AND source = 'lone'", "source = 'hot'", "doc_id IS NULL"):
        part = docs.where(few)
        kept = [r for r in rows if (r[1] == "hot" if "hot" in few else r[0] is None if "NULL" in few else r[1] == "lone")]
        assert collections.Counter(tuple(r) for r in proved(part).collect()) == collections.Counter(manifest_by_hand(kept))
    found = merkle.manifest(docs.where("false"))
    assert found.root is None and not merkle.prove(found).count()


def test_a_parent_is_emitted_by_the_task_that_adds_its_last_child():
    forest, digests = merkle.Forest(), [hashlib.sha256(bytes([i])).digest() for i in range(18)]
    order = random.Random(1).sample(range(18), 18)
    out = [x for i in order for x in forest.add(0, 18, 1, i // 16, bytes([i % 16]), digests[i])]
    want = levels_of([d.hex() for d in digests])
    assert sorted((x[2], x[3], x[6].hex()) for x in out) == [(1, 0, want[1][0]), (1, 1, want[1][1]), (2, 0, want[2][0])]
    assert not list(forest.left()) and out[-1][-1]


# 12


def groups_by_hand(rows):
    """keep_id, size and digest of every row; of the rows with the id that stays, one is kept."""
    by = collections.defaultdict(list)
    for i, text in rows:
        by[text or ""].append(i)
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest, left = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            yield i, keep, len(ids), left and i == keep, digest
            left &= i != keep


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_groups_of_equal_texts_over_any_number_of_ranges(spark, rows, ranges):
    """A group of a third of all rows, texts with a long common beginning, longer and shorter ones."""
    r = random.Random(ranges)
    long = "the same beginning of many texts, longer than what splitters see " * 3
    texts = [t for *_, t in rows] + ["the copy of a third of all rows"] * 600 + [long + str(k % 20) for k in range(60)] + ["y" * 400_000] * 3
    data = [(r.randrange(10**6) if k % 50 else None, t) for k, t in enumerate(texts)] + [(5, "twice"), (5, "twice"), (None, "never an id")]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in data], "doc_id long, text string, digest string, part int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = collections.Counter(tuple(x) for x in content_sort.exact_groups(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == collections.Counter(groups_by_hand(data))


def test_equality_after_a_normal_form_and_an_empty_table(spark):
    docs = spark.createDataFrame([("b", "A  x"), ("a", "a x"), ("c", None), ("d", "")], "doc_id string, text string")
    plain = lambda c: F.regexp_replace(F.lower(c), " +", " ")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in content_sort.exact_groups(docs, normalise=plain).collect()}
    assert got == {"a": ("b", 2, False), "b": ("b", 2, True), "c": ("d", 2, False), "d": ("d", 2, True)}
    assert not content_sort.exact_groups(docs.where("false")).count()


def test_digests_decide_nothing():
    """Neighbours with one digest and different texts stay apart."""
    runs = content_sort.Runs(pa.int64())
    texts = ["a", "a", "b", "b", "c"]
    out = [*runs.read(3, pa.array([9, 8, 7, 6, 5]), pa.array([b"x"] * 5), pa.array(texts)), *runs.read(3, pa.array([4, 3]), pa.array([b"x"] * 2), pa.array(["c", "d"])), *runs.close(end=True)]
    table = pa.Table.from_batches(out)
    assert table.column("keep_id").to_pylist() == [9, 9, 7, 7, 5, 5, 3] and table.column("group_size").to_pylist() == [2, 2, 2, 2, 2, 2, 1]
    assert table.column("edge").to_pylist() == [1, 1, 0, 0, 0, 0, 2] and table.column("edge_text").to_pylist() == ["a", None, None, None, None, None, "d"]


# 13


def audit_by_hand(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = collections.Counter(), collections.defaultdict(set)
    for n, (lang, source, text) in enumerate(rows):
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW)):
            count[lang, source, term] += 1
            docs[lang, term].add(n)
    for lang in {r[0] for r in rows}:
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least]
        v, sources = len(kept), sorted({r[1] for r in rows if r[0] == lang})
        p = {}
        for s in sources:
            n = sum(count[lang, s, t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s, t] + 2) // (n + 2 * v) for t in kept}
        n = sum(count[lang, s, t] for s in sources for t in kept)
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, _, item) in enumerate(sorted(found)[:most], 1):
                    yield lang, s, part, item, -value, rank


@pytest.fixture(scope="module")
def audited(rows):
    r = random.Random(8)
    words = "the The of été ÉTÉ naïve x yy zzz 日本 日本語 日 ß the-end a_b don't thea thean".split()
    out = [(lang, source, (text or "") + " " + " ".join(r.choice(words) for _ in range(r.randrange(12)))) for _, source, lang, _, text in rows]
    return [*out, (None, None, None), ("xx", "no terms", "12 34 !"), ("en", "no terms", ""), ("en", "rare", "hapax " * 40), ("de", "hot", "q" * 200_000), *[("en", "hot", "q" * 5000)] * 12]


def shape(df):
    return collections.Counter(tuple(x) for x in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("leaves, cells, rows_of_range", [(term_audit.TRIE_LEAVES, term_audit.SUM_CELLS, term_audit.RANGE_ROWS), (5, 40, 20)])
def test_audit_equals_the_one_by_hand(spark, audited, monkeypatch, leaves, cells, rows_of_range):
    """Also with tries that are handed on early, many ranges, and sums that are handed on early."""
    monkeypatch.setattr(term_audit, "RANGE_ROWS", rows_of_range)
    defaults = term_audit.Limits(leaves, cells)
    docs = spark.createDataFrame([(*x, "clash", 2) for x in audited], "lang string, source string, text string, term string, sid int").repartition(5)
    got = shape(term_audit.audit(docs, limits=defaults))
    assert got == collections.Counter(audit_by_hand(audited)) and len(got) > 1000


def test_audit_of_nothing(spark, audited):
    docs = spark.createDataFrame(audited, "lang string, source string, text string")
    assert not term_audit.audit(docs.where("false")).count()
    none = term_audit.audit(docs.where("lang = 'xx' OR source = 'rare'"), min_docs=99)
    assert not none.count()


def test_terms_that_mark_no_source(spark):
    """Of one source, or of one kept term, no share is above the language's; the audit has to end all the same."""
    rows = [("en", "alone", "one two two")] * 12 + [("de", s, "eins") for s in "ab" for _ in range(10)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = shape(term_audit.audit(docs))
    assert got == collections.Counter(audit_by_hand(rows)) and {x[2] for x in got} == {"pair"}


def test_a_trie_walks_in_the_order_of_bytes_and_numbers_its_leaves():
    r = random.Random(2)
    terms = ["".join(r.choice("ab日é") for _ in range(r.randrange(1, 9))).encode() for _ in range(800)]
    trie = term_audit.Trie()
    leaf = {t: trie.add(t) for t in terms}
    assert all(trie.add(t) == leaf[t] for t in terms) and sorted(leaf.values()) == list(range(trie.size))
    assert list(trie.walk()) == sorted(leaf.items())


def test_shares_of_counts_beyond_64_bits():
    counts, total = np.array([10**12, 0]), np.array([3 * 10**12, 3 * 10**12])
    assert term_audit.share(counts, total).tolist() == [1 + 10**9 * (10**12 + 2) // (3 * 10**12), 1 + 2 * 10**9 // (3 * 10**12)]
