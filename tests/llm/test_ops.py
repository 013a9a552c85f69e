"""Operators against brute force, on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provmart.llm import common as C
from provmart.llm import decontaminate, html_wrapper, kd_shards, language_id, lm_score, nearest, ngram_jaccard, sentencepiece_codec, substring_dedup, warc_index

ODD = [None, "", " ", "\x00", "one", "two words", "a b c d", "x" * 3000, "🙂 é\n\t ▁▁ z", "La " * 400]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(i, 60 + i) for i in range(12)]
    near = [base[0] + " tail", base[0].upper(), base[1], base[2] + "\n" + base[3]]
    texts = ODD + base + near
    out = list(enumerate(texts)) + [(3, texts[12]), (None, base[4]), (None, None), (12, base[2])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", "s", "clash", 1.0, 2) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, row string, score double, n_removed int")


def empty(docs):
    return docs.where("false")


# 1


def test_encoding_equals_the_library(docs):
    lib = sentencepiece_codec.Codec(sentencepiece_codec.default_model()).library
    for r in sentencepiece_codec.encode_decode(docs, sentencepiece_codec.default_model()).collect():
        want = [lib.bos_id(), *lib.encode(r.text or ""), lib.eos_id()]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == lib.decode(want) and r.row == "clash"
    assert not sentencepiece_codec.encode_decode(empty(docs), sentencepiece_codec.default_model(), digests=True).count()


def test_random_strings_encode_as_the_library_does():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    r = random.Random(5)
    parts = list("ab e\n\t  ▁é中😀́\x00#=-~.,'\"0123THEing ") + ["the", "  ", "tion", "    "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        want = [1, *codec.library.encode(t), 2]
        assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids) == codec.library.decode(want)


# 2


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_components_equal_brute_force(docs, rows):
    sets, root = shingle_sets(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                tie(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = collections.Counter((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows))
    assert collections.Counter(tuple(r) for r in ngram_jaccard.components_of(docs).collect()) == want
    assert not ngram_jaccard.components_of(empty(docs)).count()


def test_a_group_of_near_copies_without_its_original(spark):
    r, words = random.Random(1), prose(99, 120).split()
    texts = []
    for _ in range(60):
        w = list(words)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets, root = shingle_sets(rows), list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {x.doc_id: x.component_id for x in ngram_jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_templates_that_nearly_reach_the_threshold(spark):
    """17 of 20 shingles in common are 0.74; a bridge links all that share them, and templates of other sizes link."""
    words = prose(7, 21).split()
    same = lambda tail: " ".join(words + tail)
    apart = [(i, same([f"u{i}a", f"u{i}b", f"u{i}c"])) for i in range(40)]
    longer = [(100 + i, " ".join(prose(8, 60).split() + [f"v{i}a", f"v{i}b", f"v{i}c"])) for i in range(30)]
    bridge = [(200, same([]))]
    for rows in (apart + longer, apart + longer + bridge, [(i, t) for i, t in apart for _ in range(2)]):
        sets, root = shingle_sets(rows), list(range(len(rows)))
        for _ in range(3):
            for i in range(len(rows)):
                for j in range(len(rows)):
                    if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                        root[i] = root[j] = min(root[i], root[j])
        got = collections.Counter((x.doc_id, x.component_id) for x in ngram_jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == collections.Counter((d, rows[root[i]][0]) for i, (d, _) in enumerate(rows))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))


# 3


def test_language_profiles(spark):
    said = {"en": "the house and the garden with this tree", "de": "der hund und die katze nicht mit dem baum", "fr": "le chien et la maison dans le jardin avec"}
    r = random.Random(2)
    rows = [(i, lang, " ".join(r.choices(said[lang].split(), k=30))) for i, lang in enumerate(list(said) * 30)] + [(900, None, "the garden"), (901, "en", None), (None, "en", "12 !?"), (902, "fr", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    profiles = language_id.train(language_id.training_rows(df))
    assert set(profiles) == set(said)
    for x in language_id.predict(df.withColumn("score", F.lit("old")), profiles).collect():
        known = bool(x.text) and any(c.isalpha() for c in x.text)
        assert 0 <= x.score <= 1 and (x.lang_pred == "und") == (not known)
        if known:
            assert x.lang_pred == (x.lang or "en")
    assert {x.lang_pred for x in language_id.predict(df, {}).collect()} == {"und"}
    assert language_id.train(empty(df)) == {}


def test_profiles_and_distances_equal_brute_force(spark):
    """Letter n-grams of padded words counted in plain Python; ties by gram code; repeated rows count twice."""
    r = random.Random(12)
    alphabet = {"xx": "abcde é", "yy": "abfgß h", "zz": "éßcg  "}
    rows = [(i, lang, "".join(r.choice(alphabet[lang]) for _ in range(r.randrange(1, 60)))) for i, lang in enumerate(list(alphabet) * 12)]
    rows += rows[:5] + [(99, "xx", None), (98, None, "abc")]
    table = language_id.symbols()

    def grams(text):
        out, s = collections.Counter(), [0, *[int(table[ord(c)]) for c in text], 0]
        for i in range(1, len(s) - 1):
            if s[i]:
                out[s[i]] += 1
                out[(1 << 24) + (s[i - 1] << 8) + s[i]] += 1
                out[(2 << 24) + (s[i - 1] << 16) + (s[i] << 8) + s[i + 1]] += 1
                if not s[i + 1]:
                    out[(1 << 24) + (s[i] << 8)] += 1
        return out

    top = lambda c, n: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    profiles = language_id.train(df, size=20)
    want = {}
    for lang in alphabet:
        total = collections.Counter()
        for _, x, t in rows:
            if x == lang and t:
                total += grams(t)
        want[lang] = top(total, 20)
    assert profiles == want
    for x in language_id.predict(df, profiles, 20).collect():
        own = top(grams(x.text or ""), 20)
        far = {k: sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(own)) for k, p in want.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert x.lang_pred == best and abs(x.score - (1 - far[best] / (20 * len(own)) if own else 0)) < 1e-9


def test_ranks_of_counts_beyond_the_packed_key():
    spell = lambda first, second, n: first * (n + 9) + " " + second * n
    batch = lambda **c: pa.RecordBatch.from_pydict(c)
    profiles = {}
    for lang, text in (("ab", spell("a", "b", 50)), ("ba", spell("b", "a", 50))):
        (out,) = language_id._count([batch(lang=[lang], text=[text])])
        rows = sorted(zip(out.column("n").to_pylist(), out.column("code").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        profiles[lang] = [code for _, code in rows]
    (out,) = language_id._predict([batch(text=[spell("b", "a", 1 << 20), spell("a", "b", 1 << 20)])], profiles, 300, "text")
    assert out.column("lang_pred").to_pylist() == ["ba", "ab"]
    assert out.column("score").to_pylist() == [1.0, 1.0]


# 4


def test_archives_round_trip(spark):
    data = [(1, "http://www.b.example/x", "<p>same"), (2, "https://a.example:8080/Q?z#f", "<p>same"), (3, None, None), (4, "http://a.example/\r\nx", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 5), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 5), (None, "u", "<p>same"), (None, "u", "lone")]
    pages = spark.createDataFrame([(*x, "extra") for x in data], "page_id long, url string, html string, digest string")
    path = C.new_path(spark, "warc")
    warc_index.write(pages, path)
    got = warc_index.merged_index(C.materialize(warc_index.read(spark, path), "runs")).collect()
    key = [(r.urlkey.encode(), r.timestamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert len(got) == len(data) and key == sorted(key)
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2), (None, "response", None)} == kind
    assert warc_index.url_key("https://www.A.example:443/B") == "example,a)/b"


def test_archives_are_closed_by_bytes(spark):
    long = [(i, "http://h.example/x", "x" * (200_000 if i % 50 < 4 else 10) + str(i)) for i in range(200)]
    pages = spark.createDataFrame(long, "page_id long, url string, html string").coalesce(1)
    path = C.new_path(spark, "warc")
    warc_index.write(pages, path, file_bytes=500_000)
    files = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").collect()]
    assert len(files) > 1 and max(files) < 800_000
    index = warc_index.merged_index(C.materialize(warc_index.read(spark, path), "runs"))
    assert [r.page_id for r in index.collect()] == list(range(200))
    none = C.new_path(spark, "warc")
    warc_index.write(empty(pages), none)
    assert not warc_index.merged_index(C.materialize(warc_index.read(spark, none), "runs")).count()


def test_loser_tree_merges():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((r.randrange(30),) for _ in range(r.randrange(12))) for _ in range(k)]
        got = [runs[a][b] for a, b in warc_index.LoserTree(runs)]
        assert got == sorted(x for run in runs for x in run)


# 5


def test_shards(docs, rows):
    got = kd_shards.assign(docs, 4).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = collections.Counter((d, len((t or "").encode()) + 1) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size) for r in got) == want and {r.shard for r in got} <= set(range(4))
    assert not kd_shards.assign(empty(docs), 4).count()


def test_shards_balance_and_keep_light_groups_whole(spark):
    texts = [prose(i % 700, 20 + i % 90) for i in range(2000)]
    got = kd_shards.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) < 1.08 * min(size.values())
    where = collections.defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    same = kd_shards.assign(spark.createDataFrame([(i, "copy") for i in range(800)], "doc_id long, text string"), 8).collect()
    assert max(collections.Counter(r.shard for r in same).values()) < 200 and all(r.split for r in same)


def test_heavy_groups_stay_whole_and_shards_stay_even(spark, tmp_path):
    big = [prose(5000 + k, 60) for k in range(3)]
    texts = [prose(i, 20 + i % 90) for i in range(1500)] + [big[0]] * 130 + [big[1]] * 60 + [big[2]] * 25 + [None, ""]
    rows = [(i % 1600 if i % 7 else None, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, node string")
    got = kd_shards.assign(df, 8).collect()
    size, where = collections.Counter(), collections.defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        where[r.size, r.text_crc32].add(r.shard)
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())
    assert all(len(s) == 1 for s in where.values()) and not any(r.split for r in got)
    path = str(tmp_path / "shards")
    kd_shards.write_shards(df, path, 8)
    back = spark.read.parquet(path).collect()
    manifest = collections.Counter((r.doc_id, r.size, r.shard) for r in got)
    assert collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, r.shard) for r in back) == manifest and {r.node for r in back} == {"x"}


def test_cuts_equal_brute_force(spark):
    """Each leaf holds what sorting by (value, tie) and summing gives, to within one group."""
    r = random.Random(3)
    groups = [(r.randrange(-(2**60), 2**60), float(r.choice((1, 2, r.random() * 4))), r.randrange(1, 50)) for _ in range(700)]
    df = spark.createDataFrame(groups, "tie long, d0 double, bytes long")
    wanted = [5.0, 1.0, 2.0]
    total = sum(b for *_, b in groups)
    levels = kd_shards.kd_tree(df, ["d0"], wanted)
    placed = kd_shards.place(df.withColumn("node", F.lit(1).cast("long")), levels, ["d0"]).groupBy("node").agg(F.sum("bytes").alias("b"), F.min("d0").alias("lo"), F.max("d0").alias("hi")).collect()
    number = kd_shards._leaf_numbers(3)
    got = {number[x.node]: x for x in placed}
    for leaf, part in enumerate(wanted):
        assert abs(got[leaf].b - total * part / sum(wanted)) <= 101
    assert got[0].hi <= got[1].lo and got[1].hi <= got[2].lo


# 6

PAGE = """<html><head><title>T</title><script>var x="</p><article>";</script></head><body><header>Site</header><nav><ul><li>Menu {0}</li></ul></nav>
<div class="cookie-notice">We use {0}</div><article><h1>Head {0}</h1><p>One &amp; <b>two {0}<br><p>Three&nbsp;four<ul><li>a<li>b</ul><form>f</form><div id="comments"><p>reply {0}</div></article><aside>side {0}</aside><footer>foot {0}</footer></body></html>"""


def test_main_text(spark):
    data = [(i, f"https://h.example/{i}", PAGE.format(i)) for i in range(8)] + [(20, "https://lone.example/", PAGE.format(20)), (21, None, PAGE.format(21)), (22, "https://h.example/e", None), (23, "https://h.example/f", ""), (24, "https://h.example/g", "<p>only <i>this")]
    df = spark.createDataFrame([(*x, "old") for x in data], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_wrapper.extract(df).collect()}
    for i in [*range(8), 20, 21]:
        assert got[i].text == f"Head {i}\n\nOne & two {i}\n\nThree four\n\na\n\nb" and got[i].n_chars == len(got[i].text)
    assert got[22].text == got[23].text == "" and got[24].text == "only this"
    plain = '<html><body><div class="top">Brand</div><div class="box"><p>story {0} goes on and on and on</p></div><div class="end">c</div></body></html>'
    w = html_wrapper.induce([plain.format(i) for i in range(4)])
    assert html_wrapper.main_text(plain.format(9), w) == "story 9 goes on and on and on"
    assert html_wrapper.main_text(plain.format(9)) == "Brand\n\nstory 9 goes on and on and on\n\nc"
    assert not html_wrapper.extract(empty(df)).count()


def test_constant_containers_go_and_varying_ones_stay():
    body = " ".join(f"word{k}" for k in range(80))
    for tag in ("article", "main", "div class=box"):  # with and without telling names
        page = f"<body><div class=top>Brand</div><{tag}><h1>Title {{0}}</h1><div class=entry>{{0}} {{1}}</div><section class=x>Follow us</section></{tag.split()[0]}></body>"
        pages = [page.format(i, body) for i in range(4)]
        w = html_wrapper.induce(pages)
        assert html_wrapper.main_text(page.format(9, body), w) == f"Title 9\n\n9 {body}"
        assert html_wrapper.main_text(page.format(9, body)).endswith("Follow us")
        few = html_wrapper.induce(pages[:2])  # two pages prove nothing about an article's own parts
        assert html_wrapper.main_text(pages[0], few).endswith("Follow us") == (tag != "div class=box")
    same = html_wrapper.induce([pages[0]] * 9)
    assert html_wrapper.main_text(pages[0], same) == html_wrapper.main_text(pages[0])


def test_what_articles_keep():
    page = '<article><header><h1>T</h1></header><div class="share-price">up</div><div class="notice-board">n</div><p class="comments">c</p><section class="comments">gone</section><div class="ad">gone</div></article>'
    assert html_wrapper.main_text(page) == "T\n\nup\n\nn\n\nc"


def test_layouts_are_aligned(spark):
    """A part that only some pages have does not stop the rest from being compared."""
    extra = lambda i: f"<section class=q>extra {i}</section>" if i % 2 else "<section class=p></section>"
    page2 = lambda i: f"<body><div class=a>Brand</div>{extra(i)}<div class=a>story {i}</div><section class=r></section><div class=a>Imprint</div></body>"
    pages = [page2(i) for i in range(8)]
    w = html_wrapper.induce(pages)
    assert [html_wrapper.main_text(p, w) for p in pages[:2]] == ["story 0", "extra 1\n\nstory 1"]


def matched(a, b):
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + matched(x, y))
    return 1 + best[-1][-1]


def test_tree_matching_equals_brute_force():
    r = random.Random(1)
    grow = lambda depth: (r.choice("ab"), [grow(depth - 1) for _ in range(r.randrange(4))] if depth else [])

    def pack(tree):
        out, stack = [], [(tree, 0, 0)]
        while stack:
            (name, kids), depth, nth = stack.pop()
            out.append((depth, ord(name), nth))
            stack += reversed([(k, depth + 1, i) for i, k in enumerate(kids)])
        return html_wrapper.Tree(np.array(out, "<u4").tobytes())

    for _ in range(600):
        x, y = grow(3), grow(3)
        a, b = pack(x), pack(y)
        pairs = html_wrapper.Matching(a, b).pairs()
        assert len(pairs) == len(set(pairs.values())) == matched(x, y)
        for j, i in pairs.items():
            assert a.symbol[i] == b.symbol[j] and (not j or pairs[b.above[j]] == a.above[i])
            inside = [pairs[k] for k in b.kids[j] if k in pairs]
            assert inside == sorted(inside)


def test_deep_wide_and_repeated_pages(spark, monkeypatch):
    deep = "<div>" * 10_000 + "deep"
    wide = lambda k: "".join(f"<div>t{i}</div><section class=c{i * k % 7}>u</section>" for i in range(400))
    fonts = "<font>" * 3000 + "x" * 200_000
    pages = [deep, deep, "<div>" * 9_000 + "other", wide(1), wide(3), fonts, None, ""]
    df = spark.createDataFrame([(i, "http://h.example/x", p, "k") for i, p in enumerate(pages)], "page_id long, url string, html string, _keys string")
    out = []
    for bound in (32 << 20, -1):  # wrappers sent to all tasks, and joined
        monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", bound)
        got = {r.page_id: r.text for r in html_wrapper.extract(df.drop("_keys")).collect()}
        out.append(got)
    assert out[0] == out[1] and got[0] == got[1] == "deep" and got[2] == "other" and got[6] == got[7] == "" and len(got[5]) == 200_000


def test_every_page_and_layout_of_a_host_counts(spark):
    a = '<body><div class="top">Brand</div><div class="box"><h2>Head {0}</h2><p>story {0}</p></div><div class="end">Made by us</div></body>'
    b = '<body><div class="top">Brand</div><section><div class="long"><p>essay {0} ' + "goes on " * 400 + '</p></div></section><div class="tail">Our shop</div></body>'
    c = '<body><div class="top">Brand</div><div class="letter"><p>dear {0}</p></div><div class="end">Made by us</div></body>'
    again = '<body><div class="top">Brand</div><div class="box"><p>told {1}</p></div><div class="extra"></div><div class="seen">{0} times</div></body>'
    pages = [a.format(i) for i in range(190)] + [b.format(i) for i in range(190, 200)] + [c.format(200)] + [again.format(i, 7) for i in range(201, 203)]
    pages += ["<p>only this", "<div>" * 3000 + "deep"]
    data = [(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)] + [(i, f"https://copies.example/{i}", pages[0]) for i in range(300, 340)] + [(340, "https://copies.example/x", pages[1])]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    assert all(got[i] == f"Head {i}\n\nstory {i}" for i in range(190)) and all(got[i] == "Head 0\n\nstory 0" for i in range(300, 340)) and got[340] == "Head 1\n\nstory 1"
    assert all(got[i].startswith(f"essay {i} goes on") and got[i].endswith("goes on") for i in range(190, 200))
    assert got[200] == "dear 200" and all("told 7" in got[i] for i in range(201, 203)) and got[203] == "only this" and got[204] == "deep"
    w = html_wrapper.induce(pages)
    assert all(got[i] == html_wrapper.main_text(p, w) for i, p in enumerate(pages))


# 7


def removed_by_hand(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


def test_substring_dedup_equals_brute_force(docs, rows, monkeypatch):
    words, kept = removed_by_hand(rows, 35)
    want = collections.Counter((d, len(w) - len(k), (" ".join(x.decode() for x in k) if len(k) < len(w) else t)) for (d, t), w, k in zip(rows, words, kept, strict=True))
    for bound in (32 << 20, 0):  # broadcast, and shuffled
        monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", bound)
        got = substring_dedup.dedup(docs).collect()
        assert collections.Counter((r.doc_id, r.n_removed, r.text) for r in got) == want
    assert not substring_dedup.dedup(empty(docs)).count()


def test_gaps_of_any_size():
    for x in ([], [0], [5, 6, 70000, 70001], list(range(0, 300000, 7))):
        assert C.unpack_rising(C.pack_rising(np.array(x, np.int64))).tolist() == x
    x = np.arange(5, dtype=np.uint64) * np.uint64(2**45 - 1)
    assert (C.unpack48(C.pack48(x)) == x).all()


# 8


def test_base_score_and_normalisation(spark, docs, rows):
    train = language_id.F and lm_score.training_rows(docs)
    words, vocabulary, model = lm_score.train(train, epochs=2)
    p = 10.0 ** model.table().reshape(-1, lm_score.CLASSES).astype(float)
    assert np.allclose(p.sum(1), 1, atol=1e-3)
    import zlib

    toks = [((d, t), (t or "").encode().lower().split() + [None]) for d, t in rows]
    c = collections.Counter(x for (d, _), w in toks if d is not None and zlib.crc32(str(d).encode()) % 10 for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((d is None, d or 0, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4), len(w), sum(c[x] > 0 for x in w)) for (d, _), w in toks)
    got = lm_score.score(docs.drop("row"), words, vocabulary, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.base_score, 4), r.n_tokens, r.n_known) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(np.isfinite(r.score) and r.score < 0 for r in got)
    nothing = lm_score.train(empty(docs), epochs=1)
    assert all(np.isfinite(r.score) for r in lm_score.score(docs, *nothing).collect())


def test_words_beyond_the_classes_reach_the_network(spark):
    r = random.Random(8)
    text = lambda pairs: " ".join(f"left{i}aa right{j}zz" for i, j in pairs)
    rows = [(n, text([(i, i) for i in r.choices(range(300), k=30)])) for n in range(2000)]
    words, vocabulary, model = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    own = lm_score.C.Words(*lm_score.C.buffers(pa.array([f"left{i}aa right{i}zz" for i in range(300)])))
    _, at, known = vocabulary.classes(own, own.hashes())
    assert known.all() and (vocabulary.unit[at] >= 0).sum() == 600 - lm_score.TOP  # all but the words that are classes
    rare = [i for i in range(300) if (vocabulary.unit[at[2 * i : 2 * i + 2]] >= 0).all()]
    pairs = list(zip(rare[::2], rare[1::2], strict=False))
    asked = [(0, text([(i, i) for p in pairs for i in p])), (1, text([x for i, j in pairs for x in ((i, j), (j, i))]))]
    got = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(asked, "doc_id long, text string"), words, vocabulary, model).collect()}
    assert got[0] > got[1] + 1  # the same words, each after its own partner or after another's
    a, b = np.array([0, lm_score.END, lm_score.CLASSES + 3]), np.array([lm_score.CLASSES, lm_score.END, 5])
    ctx = model.contexts(a, b)
    assert np.allclose(sum(np.exp(model.log_class(ctx, np.full(3, c))) for c in range(lm_score.CLASSES)), 1, atol=1e-3)
    share = np.array([np.exp(model.log_unit(ctx, np.full(3, u), vocabulary)) for u in range(len(vocabulary.unit_cls))])
    assert np.allclose([share[vocabulary.unit_cls == g].sum(0) for g in range(lm_score.TOP, lm_score.END)], 1, atol=1e-3)


def test_score_equals_brute_force_and_beats_the_base(spark):
    """Every token's log10 probability by hand from the model's tables, and held-out texts scored better than by counts."""
    said = [f"w{i}" for i in range(150)]
    r = random.Random(6)
    follow = {w: r.sample(said, 4) for w in said}

    def text(n):
        out = [r.choice(said)]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(i, text(r.randrange(5, 60))) for i in range(1500)]
    held = [(i, text(40)) for i in range(2000, 2040)] + [(3000, "w1 unseen W2"), (3001, ""), (3002, None)]
    words, v, m = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    got = {x.doc_id: x for x in lm_score.score(spark.createDataFrame(held, "doc_id long, text string"), words, v, m).collect()}
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    for d, t in held:
        w = C.Words(*C.buffers(pa.array([t or ""])), True)
        cls, at, known = v.classes(w, w.hashes())
        inputs = [lm_score.END, lm_score.END, *v.inputs(cls, at, known).tolist(), lm_score.END]
        total = 0.0
        for k in range(2, len(inputs)):
            ctx = m.inputs[inputs[k - 1]] * m.near + m.inputs[inputs[k - 2]] * m.far
            c = int(v.input_cls[inputs[k]])
            total += soft(m.out @ ctx + m.bias)[c]
            if not (c < v.n_top or c == lm_score.END):
                unit = inputs[k] - lm_score.CLASSES if inputs[k] >= lm_score.CLASSES else int(v.rest[c])
                a, b = v.group_first[c], v.group_first[c + 1]
                place = int(v.place[unit])
                group = place // lm_score.GROUP
                total += soft(m.groups[a:b] @ ctx + v.group_log[a:b])[group - a]
                own = slice(group * lm_score.GROUP, (group + 1) * lm_score.GROUP)
                total += soft(m.units[own] @ ctx + v.unit_log[group])[place % lm_score.GROUP]
                if inputs[k] < lm_score.CLASSES:
                    seen = int(v.n[at[k - 2]]) if known[k - 2] else 0
                    total += np.log((seen + lm_score.ALPHA) / v.rest_mass[c])
        assert abs(got[d].score - total / np.log(10)) < 1e-3 * got[d].n_tokens
    better = [got[d].score > got[d].base_score for d, t in held[:40]]
    assert sum(better) == 40


def test_the_network_grows_with_the_corpus():
    h = np.arange(1, 50_001, dtype=np.uint64)
    sizes = [len(lm_score.Vocabulary(h, np.full(50_000, k), np.full(50_000, lm_score.TOP), {lm_score.TOP: (50_000 * k, 50_000)}, 10).unit_cls) for k in (2, 8, 32)]
    assert sizes[1] > 1.9 * sizes[0] and sizes[2] > 1.9 * sizes[1]


# 9


def test_tiling_catches_reordered_passages(spark, rows):
    item = prose(1000, 40).split()
    turned = item[20:] + ["filler"] + item[:20]
    texts = [(1, " ".join(item)), (2, "Intro. " + ", ".join(turned).upper()), (3, " ".join(item[:12])), (4, prose(5, 300)), (5, None), (6, ""), (7, "x only two here y"), (7, "x only two here y")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "only two"), (13, "")], "item_id long, text string")
    for block in (8 << 20, 1):
        got = decontaminate.tiled(df, bench, block_bytes=block).collect()
        assert sorted((r.doc_id, r.item_id, r.tiles) for r in got) == [(1, 10, 1), (2, 10, 2), (7, 12, 1), (7, 12, 1)]
    assert not decontaminate.tiled(df, empty(bench)).count() and not decontaminate.tiled(empty(df), bench).count()


def tiles_by_hand(a, b, k):
    """The longest common run of unmarked words, first in b, then in a; again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < k:
            return out
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append((i, j, n))


def test_greedy_tiles_equal_brute_force():
    r = random.Random(4)
    word = np.random.default_rng(1).integers(0, 2**63, 5, dtype=np.uint64)
    for _ in range(150):
        size = r.choice((2, 3, 4))
        a, b = [[r.randrange(size) for _ in range(r.randrange(2, 40))] for _ in range(2)]
        assert decontaminate.greedy_tiles(word[a], word[b], 3) == tiles_by_hand(a, b, 3)


def test_tiling_of_texts_equals_brute_force(spark):
    r = random.Random(9)
    say = lambda n, k: " ".join(r.choice("abcdefghij"[:k]) for _ in range(n))
    items = [(i, say(r.randrange(1, 30), r.choice((2, 10)))) for i in range(25)]
    texts = [(i, say(r.randrange(0, 90), 10) + " " + " ".join(r.choice(items)[1] for _ in range(r.randrange(3)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, 7, 0.5, "x") for i, t in texts], "doc_id long, text string, item_id int, coverage double, _text string")
    got = {(x.doc_id, x.item_id): (x.tiles, x.longest, x.matched) for x in decontaminate.tiled(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in texts:
        for i, s in items:
            a, b = s.split(), t.split()
            if len(a) < 4:
                if any(b[j : j + len(a)] == a for j in range(len(b))):
                    want[d, i] = (1, len(a), len(a))
                continue
            tiles = tiles_by_hand(a, b, 4)
            if sum(n for _, _, n in tiles) >= 0.5 * len(a):
                want[d, i] = (len(tiles), max(n for _, _, n in tiles), sum(n for _, _, n in tiles))
    assert got == want


def test_tiling_of_one_repeated_word_takes_little_memory(spark):
    import tracemalloc

    word = np.full(200_000, 77, np.uint64)
    tracemalloc.start()
    assert decontaminate.greedy_tiles(word[:400], word, 4) == [(0, 0, 400)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    df = spark.createDataFrame([(1, "la " * 200_000), (2, None)], "doc_id long, text string")
    (got,) = decontaminate.tiled(df, spark.createDataFrame([(5, "la " * 400)], "item_id long, text string")).collect()
    assert (got.doc_id, got.tiles, got.matched) == (1, 1, 400)


# 10


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(600, 16))
    v[100:160] = v[100]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame([(*x, "e") for x in data], "vec_id long, embedding array<double>, v string")
    got = collections.defaultdict(list)
    for x in nearest.search(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    hit = 0
    for q in range(0, 600, 20):
        s = np.einsum("ij,j->i", v, v[q])
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:5]
        assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(x == s[i] for _, i, x in got[q])
        hit += len({i for _, i, _ in got[q]} & set(best.tolist()))
    assert set(got) == set(range(0, 600, 20)) and hit >= 0.9 * 150
    assert [i for _, i, _ in got[100]][:5] == [101, 102, 103, 104, 105]
    assert not nearest.search(empty(df), empty(df)).count()


def test_queries_that_find_too_few_are_asked_again(spark, monkeypatch):
    monkeypatch.setattr(nearest, "_budget", lambda *a: 1.0)  # one leaf
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[3].tolist())], "vec_id long, embedding array<double>")
    got = collections.Counter(x.query_id for x in nearest.search(df, df.where("vec_id % 50 = 0"), k=20).collect())
    assert got == {q: 20 for q in range(0, 300, 50)}
    few = nearest.search(df.where("vec_id < 10"), df.where("vec_id = 0"), k=20).collect()
    assert [x.rank for x in few] == list(range(1, 10))


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) <= first.count() and all(hashlib.sha256(r.ids).digest() for r in out)
    texts = {r.doc_id: r.text for r in first.collect()}
    comp = {r.doc_id: r.component_id for r in ngram_jaccard.components_of(first).collect()}
    leaks = {r.doc_id for r in decontaminate.tiled(first, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    kept = {r.doc_id for r in out}
    assert all(comp[i] == i for i in kept) and not kept & leaks
    _, rest = removed_by_hand([(i, texts[i]) for i in sorted(i for i in texts if comp[i] == i)], 35)
    for i, words in zip(sorted(i for i in texts if comp[i] == i), rest, strict=True):
        if i in kept:
            assert next(r.text for r in out if r.doc_id == i).encode().split() == words


def test_the_last_stage_keeps_texts_that_decode_otherwise(spark, docs, rows):
    import corpus_pipeline

    out = corpus_pipeline.encode(spark, docs, "").collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, _ in rows)
    assert {r.doc_id for r in out if not r.round_trip} == {ODD.index("🙂 é\n\t ▁▁ z")}


def test_stages_tell_rows_with_null_and_repeated_ids_apart(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d, e, leak = (prose(2000 + i, 60) for i in range(6))
    rows = [(1, a), (None, a), (None, a), (2, b), (2, b), (None, c), (None, c), (3, d), (3, e), (3, leak), (None, leak + " tail")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, df, "").collect())
    assert got == collections.Counter([(1, a), (2, b), (None, c), (3, d), (3, e), (3, leak)])
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_benchmark_passages(spark, df, str(tmp_path)).collect())
    assert got == collections.Counter(rows[:9])


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    """Repeated rows, null ids and texts, the space mark, a long text, garbage, leaks and shared passages."""
    import corpus_pipeline

    passage, item = prose(70, 50), prose(71, 40)
    base = [prose(100 + i, 50 + 7 * i) for i in range(24)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(40, base[1]), (None, base[2]), (None, prose(90, 45)), (None, prose(90, 45)), (3, base[3]), (3, base[3]), (3, prose(91, 66))]
    texts += [(50, base[5] + " tail"), (51, f"{prose(92, 50)} {passage} {prose(93, 50)}"), (52, f"{prose(94, 50)}\n{passage}\n{prose(95, 60)}"), (53, passage)]
    texts += [(60, f"{prose(96, 30)} {item}"), (61, " ".join(item.split()[20:] + ["so"] + item.split()[:20])), (62, "load \u2581\u2582 alpha12 beta7 gamma5"), (63, prose(97, 6000))]
    texts += [(70, None), (71, ""), (72, "12 34 !?"), (73, "\u0416\u0409\u0436 \u0444\u0431\u0446 " * 9)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    # the garbage text has no language, so that no profile is learned from it
    rows = [(i, t, None if i == 73 else lang, s, n) for i, t, lang, s, n in rows]
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t) and i != 73]
    # near copies
    sets, root = shingle_sets(left), list(range(len(left)))
    for _ in range(2):
        for a in range(len(left)):
            for b in range(len(left)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    first = {}
    for k, (i, t) in enumerate(left):
        first.setdefault(root[k], []).append(((i is None, i or 0), k))
    left = [left[k] for k in sorted(min(x)[1] for x in first.values())]
    # repeated passages
    words, kept = removed_by_hand(left, 35)
    left = [(i, t if len(k) == len(w) else " ".join(x.decode() for x in k)) for (i, t), w, k in zip(left, words, kept, strict=True) if k or not w]
    # leaks
    loose = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    own = loose(item)
    left = [(i, t) for i, t in left if len(t) > 20_000 or sum(n for *_, n in tiles_by_hand(own, loose(t), 4)) < 0.5 * len(own)]
    lib = sentencepiece_codec.Codec(sentencepiece_codec.default_model()).library
    want = collections.Counter((i, lib.decode(lib.encode(t)), lib.decode(lib.encode(t)) == t) for i, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.text, r.round_trip) for r in got) == want
    assert sum(r.doc_id is None for r in got) == 1 and {51, 52, 62, 63} <= {r.doc_id for r in got} and not {53, 60, 61, 73} & {r.doc_id for r in got}


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()
