"""Commits, strict records, page parsers, folding, ranks of any key, and upkeep of marts."""

import csv
import gzip
import io
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from provmart.functions import folding
from provmart.functions import text as T
from provmart.operators import classify as K
from provmart.operators import fit, latest
from provmart.operators.commits import Store
from provmart.operators.load import Refused
from provmart.plans import build, serve, warehouse
from provmart.plans import cost_model as M
from provmart.sources import amounts, artifacts, files, html_pages, records

# --- commits -------------------------------------------------------------------


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_is_visible_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (2, "c", 2)], "k long, v string, n int")
    with store.batch() as b:
        assert b.append("t", one, ["k"], "n") == 2 and b.replace("u", one.drop("n")) == 3
        assert store.counts() == {}  # nobody sees it yet
    assert rows_of(store.read("t")) == [(1, "a"), (2, "b")] and store.counts() == {"t": 2, "u": 3}
    with pytest.raises(KeyError), store.batch() as b:  # a job lost between two writes
        b.append("t", spark.createDataFrame([(9, "z", 0)], one.schema), ["k"], "n")
        b.replace("u", one.drop("n").limit(1))
        raise KeyError
    assert rows_of(store.read("t")) == [(1, "a"), (2, "b")] and store.counts() == {"t": 2, "u": 3}
    assert len(list((tmp_path / "store" / "t").iterdir())) == 1  # what the lost batch wrote is gone
    with pytest.raises(Refused, match="second fingerprint"), store.batch() as b:
        b.append("t", spark.createDataFrame([(3, "n", 0), (1, "other", 1)], one.schema), ["k"], "n", "v")
    for bad in ([(None, "x", 0)], [(4, "x", 0)]):
        kind = "k long, v string, n int" if bad[0][0] is None else "k long, v string, w int, n int"
        with pytest.raises(Refused), store.batch() as b:
            b.append("t", spark.createDataFrame([(*bad[0][:2], *([1] if "w" in kind else []), 0)], kind), ["k"], "n")
    with store.batch() as b:  # a table that reads itself
        b.replace("u", b.read("u").where("k = 2"))
    assert store.counts()["u"] == 2 and store.versions() == [1, 2] and len(rows_of(store.read("u", 1))) == 3
    assert store.vacuum(1) == 1 and store.versions() == [2] and len(rows_of(store.read("u"))) == 2
    with pytest.raises(Refused):
        store.read("none")


def test_of_two_writers_from_one_state_the_second_is_refused(spark, tmp_path):
    first, second = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    rows = spark.range(3).withColumn("n", F.col("id"))
    with pytest.raises(Refused, match="another batch"), first.batch() as a:
        a.append("t", rows, ["id"], "n")
        with second.batch() as b:
            b.append("t", rows, ["id"], "n")
    assert second.counts() == {"t": 3} and len(list((tmp_path / "s" / "t").iterdir())) == 1
    with second.batch() as b:
        b.append("t", rows.where("false"), ["id"], "n")
        b.append("e", rows.where("false"), ["id"], "n")
    assert second.counts() == {"e": 0, "t": 3} and not second.read("e").count()


def test_marts_kept_from_new_rows_equal_those_from_all(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(40), r.randrange(1000), i) for i in range(900)] + [(5, 2000, 900), (5, 2000, 901)]
    df = spark.createDataFrame(rows, "k int, at int, id int")
    order = [F.desc("at"), F.desc("id")]
    store = Store(spark, str(tmp_path / "s"))
    for epoch, part in enumerate((rows[:300], rows[600:], rows[300:600], rows[:10])):
        for _ in range(2):  # a batch that is tried again
            with store.batch("b", epoch) as b:
                b.keep_latest("m", spark.createDataFrame(part, df.schema), ["k"], order, 8)
    assert rows_of(store.read("m").select("k", "at", "id")) == rows_of(latest.latest_by(df, ["k"], order))
    before = set(map(str, store.state()["tables"]["m"]["buckets"].items()))
    with store.batch("b", 9) as b:
        assert b.keep_latest("m", spark.createDataFrame([(3, 9999, 1)], df.schema), ["k"], order, 8) == 1
    assert len(before - set(map(str, store.state()["tables"]["m"]["buckets"].items()))) == 1


def test_a_stream_and_a_batch_give_the_same_marts(spark, tmp_path):
    from provmart.streaming.append import keep_marts

    rows = spark.createDataFrame([(i % 5, i % 3, f"v{i}") for i in range(60)], "k long, at long, v string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    order, store = [F.desc("at"), F.desc("v")], Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        keep_marts(stream, str(tmp_path / "store"), str(tmp_path / "cp"), "s", "raw", ["k", "at", "v"], ["k"], order, buckets=4).awaitTermination(90)
    assert rows_of(store.read("raw")) == rows_of(rows) and rows_of(store.read("raw_latest").select("k", "at", "v")) == rows_of(latest.latest_by(rows, ["k"], order))
    # the checkpoint is lost: all batches come again and their numbers are known
    keep_marts(stream, str(tmp_path / "store"), str(tmp_path / "cp2"), "s", "raw", ["k", "at", "v"], ["k"], order, buckets=4).awaitTermination(90)
    assert store.read("raw").count() == 60


# --- strict records ------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write_csv(path, header, rows, end="\n", **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end, **options)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def test_quoted_records_are_whole_wherever_files_are_cut(spark, tmp_path, small_splits):
    """Cells longer than a split, line ends and quotes in cells, two files, both line ends."""
    r = random.Random(6)
    pieces = ['a "quoted" word', "line\nend", "x" * 90, '""', "\n\n", "é,;", "plain"]
    rows = [(str(k), " ".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))) for k in range(200)]
    rows.append(("200", "a cell over many splits\n" * 200))
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", ("id", "text"), rows[:90])
    write_csv(folder / "b.csv", ("id", "text"), rows[90:], end="\r\n")
    assert records._lines(spark, str(folder)).rdd.getNumPartitions() > 10
    got = records.read(spark, str(folder), ("id", "text"))
    assert sorted((x.id, x.text) for x in got.collect()) == sorted(rows)
    by_file = got.orderBy("ordinal").select("id").collect()
    assert [x.id for x in by_file] == [i for i, _ in rows]


def test_plain_files_take_one_pass_and_refusals_name_the_first_row(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "_careful", lambda *a: pytest.fail("a second pass"))
    rows = [(str(k), "v") for k in range(400)]
    path = write_csv(tmp_path / "x.csv", ("id", "v"), rows)
    odd = lambda df: (df, [("too large", F.col("id").cast("int") > 250, ("id",))])
    assert records.read(spark, path, ("id", "v")).count() == 400
    with pytest.raises(Refused, match="too large: id='251'"):
        records.read(spark, path, ("id", "v"), odd)
    for header, body, says in (("id,v", "1,2\n3\n", "number of cells"), ("id,v", "1,2,3\n", "number of cells"), ("v,id", "1,2\n", "header"), ("", "", "header")):
        (tmp_path / "bad.csv").write_text(f"{header}\n{body}" if header else "")
        with pytest.raises(Refused, match=says):
            records.read(spark, str(tmp_path / "bad.csv"), ("id", "v"))


def test_an_open_quote_and_another_header_are_refused(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,v\n1,"never ends\n2,x\n')
    with pytest.raises(Refused, match="does not end"):
        records.read(spark, str(tmp_path / "q.csv"), ("id", "v"))
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("﻿id,v\n1,2\n\n")
    (folder / "b.csv").write_text("id,w\n1,2\n")
    with pytest.raises(Refused, match="another header"):
        records.read(spark, str(folder), ("id", "v"))
    (folder / "b.csv").write_text("id,v\r\n3,\r\n")
    assert rows_of(records.read(spark, str(folder), ("id", "v")).drop("ordinal")) == [("1", "2"), ("3", None)]


def anchor(**more):
    given = dict(zip(files.ANCHORS, ("site-a", "main", "traditional", "solicited", "4.5", "10", "0.125", "", "3.5", "2026-01-15", "https://a.example/1", "page 3"), strict=True))
    return [(given | more)[c] for c in files.ANCHORS]


def test_anchors_are_strict(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", files.ANCHORS, [anchor(), anchor(profile="second", rating="")])
    read = lambda p: files.read_anchors(spark, str(p), ("digital-first", "traditional"), files.CHANNELS, published=True)
    got = {r.profile: (r.source, r.rating and float(r.rating), r.origin) for r in read(path).collect()}
    assert got == {"main": ("site-a", 4.5, "anchor"), "second": ("site-a", None, "anchor")}
    for field, value in (("platform", "No Slug"), ("segment", "other"), ("channel", ""), ("source_url", "http://a"), ("seeded_from", " "), ("captured_at", "2026-02-30"), ("rating", "5.1"), ("rating", "4.5000"), ("review_count", "-1"), ("one_star_share", "1.01")):
        write_csv(tmp_path / "bad.csv", files.ANCHORS, [anchor(), anchor(profile="p", **{field: value})])
        with pytest.raises(Refused, match=field):
            read(tmp_path / "bad.csv")


def test_star_export(spark, tmp_path):
    header = ("Id", "Name", "Date", "Stars", "Title", "Text")
    star = "https://cdn.example/x/stars-{}.svg"
    path = write_csv(tmp_path / "e.csv", header, [("1", "private", "March 5, 2026", star.format("4.5"), "t", ""), ("2", "p", "December 31, 2025", star.format(1), "", "body")])
    read = lambda p: files.read_star_export(spark, str(p), "Id", "Date", "Stars", "Title", "Text")
    got = read(path)
    assert "Name" not in got.columns and rows_of(got.select("external_id", "review_date", "rating", "body")) == [("1", "2026-03-05", "4.5", ""), ("2", "2025-12-31", "1", "body")]
    for bad in (("3", "p", "Febuary 3, 2026", star.format(3), "", ""), ("3", "p", "February 30, 2026", star.format(3), "", ""), ("3", "p", "May 3, 2026", star.format(6), "", ""), (" ", "p", "May 3, 2026", star.format(3), "", ""), ("3", "p", "May 3, 2026", "stars-3.svg", "", "")):
        with pytest.raises(Refused):
            read(write_csv(tmp_path / "bad.csv", header, [bad]))


def test_amounts_of_many_misnamed_files_in_one_plan(spark, tmp_path):
    """Gzip files named like plain ones and the other way round, ranges that cut lines, marks, empty files."""
    folder, want = tmp_path / "in", []
    folder.mkdir()
    r = random.Random(1)
    for k in range(60):
        values = [f"{r.randrange(1, 10**r.randrange(2, 8)) / 100:.2f}" for _ in range(r.randrange(1, 40) if k else 5000)]
        want += values
        text = ("﻿" if k % 3 == 0 else "") + "X;PRS_REM_MNT;PRS_REM_TYP" + ("\r\n" if k % 5 == 0 else "\n") + "".join(f"e;{v.replace('.', ',') if k % 2 else v};0\n" for v in values) + "e;5;9\ne;-4;0\ne;x;0\n"
        data = text.encode()
        (folder / (f"{k}.csv" if k % 4 else f"{k}.csv.gz")).write_bytes(gzip.compress(data) if k % 2 else data)
    (folder / "empty.csv").write_bytes(b"")
    for size in (1000, 64 << 20):
        rows = amounts.rows(spark, str(folder), "PRS_REM_MNT", "PRS_REM_TYP", range_bytes=size)
        assert rows.where("kind = '0' AND amount NOT IN ('-4', 'x')").count() == len(want) and rows.where("kind = '9'").count() == 60
    got = files.read_amounts(spark, str(folder))
    assert sorted(x.amount for x in got.collect()) == sorted(map(float, want)) and got.select("file", "at").distinct().count() == len(want)
    assert sorted(p.pieces for p in amounts._plan([("b", 10), ("a", 1), ("c", 4)], 5)) == [[("a", 0, 1), ("c", 0, 4)], [("b", 0, 5)], [("b", 5, 10)]]
    (folder / "bad.csv").write_text("PRS_REM_MNT;PRS_REM_TYP\n1;0;0\n")
    with pytest.raises(Exception, match="3 cells at byte 24"):
        files.read_amounts(spark, str(folder)).count()


# --- pages and robots ------------------------------------------------------------


def test_figures_of_listings_are_strict(spark):
    page = '<script type="application/ld+json">{}</script>'
    rating = '{{"aggregateRating": {{"ratingValue": {}, "ratingCount": {}}}}}'
    bad = [rating.format("true", 3), rating.format('"4"', '"x"'), rating.format("4.5", "null"), rating.format("NaN", 1), rating.format("5.1", 2), rating.format("1e0", 2), '{"aggregateRating": 4}', '{"aggregateRating": {"ratingValue": 4, "ratingCount": 1, "reviewCount": 1}}', "[]"]
    good = {rating.format("4.1235", 7): (4.124, 7), rating.format('"4"', '"12"'): (4.0, 12), '[{"@graph": [' + rating.format(3, 0) + "]}, 5]": (3.0, 0)}
    pages = spark.createDataFrame([(i, page.format(x)) for i, x in enumerate([*bad, *good])], "source_url int, body string")
    rows = {int(r.key): r for r in html_pages.parse_pages(pages, "jsonld").collect()}
    assert all(rows[i].kind == "refused" and rows[i].error for i in range(len(bad)))
    for i, want in enumerate(good.values(), len(bad)):
        assert rows[i].kind == "snapshot" and (float(rows[i].rating), rows[i].review_count) == want


def test_feeds_and_pages_that_cannot_be_read(spark):
    entry = {"id": {"label": "1"}, "title": {"label": "t"}, "content": {"label": "b"}, "im:rating": {"label": "4"}, "updated": {"label": "2026-01-02T23:00:00-07:00"}}
    bodies = [json.dumps({"feed": {"entry": [entry, entry | {"id": {"label": "2"}}]}}), '{"feed": {}}', '{"feed": {"entry": 5}}', '{"feed": {"entry": [1]}}', "[]", None, json.dumps({"feed": {"entry": [entry | {"im:rating": {"label": "4.0"}}]}})]
    got = html_pages.parse_pages(spark.createDataFrame(list(enumerate(bodies)), "source_url int, body string"), "feed").collect()
    kinds = sorted((int(r.key), r.kind) for r in got)
    assert kinds == [(0, "review"), (0, "review"), (2, "refused"), (3, "refused"), (4, "refused"), (5, "refused"), (6, "refused")]
    assert {(r.external_id, r.review_date, float(r.review_rating)) for r in got if r.kind == "review"} == {("1", "2026-01-02", 4.0), ("2", "2026-01-02", 4.0)}


def test_exports_keep_no_personal_column(spark):
    def sheet(*rows, header=html_pages.EXPORT):
        out = io.StringIO()
        csv.writer(out).writerows([header, *rows])
        return out.getvalue()

    def row(**more):
        given = dict.fromkeys(html_pages.EXPORT, "private") | {"headline": "t", "reviewbody": "", "data3": "March 5, 2026", "rating": "https://cdn.example/x/stars-4.svg"} | more
        return list(given.values())

    good = "\ufeff" + sheet(row(), row(reviewbody='two\nlines, "quoted"'))
    bad = [sheet(row(data3="Marsh 5, 2026")), sheet(row(data3="February 30, 2026")), sheet(row(rating="https://cdn.example/stars-6.svg")), sheet(row()[:-1]), sheet(row(), header=html_pages.EXPORT[:-1]), "", 'a"b"\n"']
    got = html_pages.parse_pages(spark.createDataFrame(list(enumerate([good, *bad])), "source_url int, body string"), "export").collect()
    assert sorted((int(r.key), r.kind) for r in got) == [(0, "review"), (0, "review"), *((i, "refused") for i in range(1, 8))]
    reviews = [r for r in got if r.kind == "review"]
    assert {(r.review_date, float(r.review_rating), r.title, r.body) for r in reviews} == {("2026-03-05", 4.0, "t", ""), ("2026-03-05", 4.0, "t", 'two\nlines, "quoted"')}
    assert len({r.external_id for r in reviews}) == 2 and not any("private" in str(r) for r in got)


def test_microdata_by_items():
    nested = '<div itemscope itemtype="x/Product"><div itemscope itemtype="x/AggregateRating"><meta itemprop=ratingValue content=4.1><b itemprop=ratingCount>12</b></div><div itemscope itemtype="x/Review"><p itemprop=reviewBody>one <em>two</em><br> three</p></section><i itemprop=datePublished>01/02/2026 le 03/01/2026</i><span itemprop=ratingValue>5</span></div></div>'
    (review,), total = html_pages.microdata(nested)
    assert (review["body"], review["review_date"], review["rating"], total["ratingCount"]) == ("one two three", "2026-02-01", "5", "12")
    stray = "<div>" * 4000 + "</b>" * 4000 + "</div>" * 9000  # end tags that close nothing cost nothing
    assert html_pages.microdata(stray * 5) == ([], None)


def test_a_line_between_user_agents_ends_their_run(spark):
    fused = "User-agent: *\nDisallow: /s\nUser-agent: *\nSitemap: https://x/y\nUser-agent: foreign\nAllow: /secret\n"
    assert not html_pages.robots_allows(fused, "https://x/secret", "provmart")
    assert not html_pages.robots_allows("User-agent: a\nUser-agent: provmart/2\nDisallow: /\n", "https://x/", "provmart")
    names = {"provmart": True, "PROVMART/1.0": True, "prov": True, "pr": False, "*": False, "": False, "other-bot": False, "x (provmart)": True}
    assert {k: html_pages.names_agent(k, "provmart/0.1") for k in names} == names
    robots = spark.createDataFrame([("a.example", fused), ("b.example", None), ("c.example", "User-agent: *\nDisallow: /p\nAllow: /p/q\n")], "host string, text string")
    urls = ["https://a.example/secret", "https://a.example/x", "http://B.example/secret", "https://u@c.example:80/p/q?x=1", "https://c.example/p", "https://d.example/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = dict(rows_of(html_pages.allowed_by_host(pages, html_pages.robots_rules(robots, "provmart"))))
    assert got == {0: False, 1: True, 2: True, 3: True, 4: False, 5: True, 6: None}


def test_lint_sees_through_strings_and_comments():
    hit = lambda t: bool(warehouse.lint(t))
    for text in ("-- don't\nSELECT now() FROM t -- won't", "SELECT today ()", "SELECT * FROM read_csv_auto('x')", "SELECT a ~ 'b'", "SELECT a FROM t GROUP  BY\nALL", "SELECT a GLOB 'x'", "SELECT a SIMILAR TO 'x'", "SELECT current_time", "SELECT '--' || now()", "SUMMARIZE t", "SELECT 1::int"):
        assert hit(text), text
    for text in ("SELECT 'now()' AS \"like\"", "SELECT unlike_count, nowhere FROM t -- now()", "/* a ~ b */ SELECT 1", "SELECT 'it''s today()'"):
        assert not hit(text), text
    assert warehouse.statements("SELECT ';' AS \"a;b\" /* ; */; -- x;\nSELECT 2") == ["SELECT ';' AS \"a;b\" /* ; */", "-- x;\nSELECT 2"]


# --- folding and classification --------------------------------------------------


def test_fold_equals_unicode_data_for_every_code_point(spark):
    points = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    texts = ["".join(points[i : i + 500]) for i in range(0, len(points), 500)] + ["plain ASCII Text", "", "Élan Straße … 한국어 ﬁne ﷺ", "ẞ\U0001d15e x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = dict(rows.select("i", folding.fold(F.col("t"))).collect())
    assert all(got[i] == folding.folded(t) for i, t in enumerate(texts))
    assert folding.folded("Ǆ") == "".join(c for c in unicodedata.normalize("NFKD", "Ǆ") if not unicodedata.combining(c)).casefold()


def test_literals_at_word_starts_by_one_trie(spark):
    r = random.Random(3)
    patterns = sorted({"".join(r.choice("ab c.") for _ in range(r.randrange(1, 6))).strip() or "a" for _ in range(300)} | {"a", "ab", "abc", "a.b", "(x", "b|c"})
    rules = {"one": patterns[::3], "two": patterns[1::3], "positive": patterns[2::3]}
    texts = ["".join(r.choice("abc .|(x") for _ in range(r.randrange(30))) for _ in range(400)] + [None, "", "xabc", "abc"]
    got = {}
    for i, t in K.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), rules).collect():
        got.setdefault(i, set()).add(t)
    word = lambda c: c.isalnum() or c == "_"
    starts = lambda t, p: any(t.startswith(p, i) and (word(t[i]) != (i > 0 and word(t[i - 1]))) for i in range(len(t)))
    for i, t in enumerate(texts):
        themes = {k for k in ("one", "two") if any(starts(t or "", p) for p in rules[k])}
        assert got[i] == (themes or ({"positive"} if any(starts(t or "", p) for p in rules["positive"]) else {"unclassified"})), (t, got[i])


def test_texts_are_folded_and_searched_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").repartition(2)
    cache = spark.createDataFrame([(1, "v", "m", "a")], "doc_id long, prompt_version string, model string, theme string")
    rules = {"a": ["x", "y"], "b": ["z"], "positive": ["q"]}
    for df in (K.classify(docs, rules), K.decided(docs, rules, cache, "v", "m"), K.theme_share(K.classified_once(docs, rules).withColumn("g", F.lit(1)), ["g"])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 3  # once for the rules, the other for rare characters


def test_a_decider_is_asked_once_for_each_open_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha"), (2, "open"), (3, None), (4, "open too"), (5, "known")], "doc_id long, text string")
    cache = spark.createDataFrame([(5, "v", "m", "b"), (2, "old", "m", "b")], "doc_id long, prompt_version string, model string, theme string")
    rules, store = {"a": ["alpha"], "b": ["beta"]}, Store(spark, str(tmp_path / "s"))
    decider = lambda ids, texts: [["b", "a", "odd"] if t == "open" else ["odd"] if t else None for t in texts]
    for run in range(2):
        with store.batch() as b:
            known = cache if b.read("d") is None else cache.unionByName(b.read("d"))
            answers = K.answered(docs, rules, known, "v", "m", decider, ["a", "b"], batch=2)
            assert answers.select("doc_id").distinct().count() == (3, 0)[run]
            b.append("d", answers.withColumn("n", F.lit(0)), ["doc_id", "prompt_version", "model", "theme"], "n")
    merged = K.decided(docs, rules, cache.unionByName(store.read("d")), "v", "m")
    assert rows_of(merged) == [(1, "a"), (2, "a"), (2, "b"), (3, "unclassified"), (4, "unclassified"), (5, "b")]
    share = K.decided_share(merged).first()
    assert (share.decided, share.texts, share.share) == (3, 5, 0.6)


def test_rule_files_are_read_as_yaml_says():
    read = lambda t: files.read_rules(t, ("a", "b-c", "positive"))
    text = "--- \n# rules\na:   # first\n  - plain word # said so\n  - 'it''s # here'\n- \"\\u00e9: x\"\nb-c: [one, 'two, three', \"four\"]\n'positive':\n  - un par un\n  - a#b\n"
    assert read(text) == {"a": ["plain word", "it's # here", "é: x"], "b-c": ["one", "two, three", "four"], "positive": ["un par un", "a#b"]}
    assert read('{"a": ["x"]}') == {"a": ["x"]}
    for bad in ("a:\n", "a:\n\t- x\n", "a:\n  - x\na:\n  - y\n", "a: &x\n", "a:\n  - k: v\n", "other:\n  - x\n", "- x\n", "a:\n  - [x]\n", "a: text\n", '{"a": [], "a": ["x"]}', '{"a": [1]}', '{"a": "x"}', "a:\n  - *x\n"):
        with pytest.raises(Refused):
            read(bad)


def test_parameters_have_a_source_if_and_only_if_they_say_so(spark, tmp_path):
    good = ("x", 1.0, "u", "sourced", 0.5, 2.0)
    M.check_parameter(good, "somewhere")
    for row, citation in ((good, ""), ((*good[:3], "unsourced", *good[4:]), "somewhere"), ((*good[:3], "guessed", *good[4:]), "x"), ((*good[:4], 1.5, 2.0), "x")):
        with pytest.raises(ValueError, match="x:"):
            M.check_parameter(row, citation)
    fitted = {"mu": 3.0, "sigma": 1.0, "n": 400, "emp_p50": 20.0, "emp_mean": 33.0}
    rows = {r[0]: r for r in M.from_artifacts(fitted, {"f": (1, 9, 0.1), "g": (3, 7, 0.3), "overall": (4, 16, 0.2)})}
    assert rows["mu"][1:] == (3.0, "log-euros", "sourced", 2.9, 3.1) and rows["extra_billing_share"][1:] == (0.2, "share of fees billed", "sourced", 0.1, 0.3)
    claims = spark.createDataFrame([(v,) for v in (0.0, 10.0, 42.67, 42.66, 500.0)], "amount_eur double")
    sim = M.holds_of(claims).where("scenario = 'hold_timer'").first()
    assert (sim.claims, sim.released) == (5, 3) and {r.timer_days: r.share_under for r in M.sla_of(claims).collect()}[14] == 0.6


# --- ranks, deciles, files -------------------------------------------------------


def test_a_sample_by_text_keys_with_nulls_and_ties(spark):
    keys = [None, None, "b", "b", "a", "é", "z", "c", None, "d"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, key string").repartition(3)
    got = [r.key for r in fit.systematic_sample(rows, F.lit(True), "key", 3).collect()]
    assert sorted(got, key=lambda k: (k is not None, k or "")) == [None, "a", "c"]
    assert fit.systematic_sample(rows, F.col("i") < 0, "key", 3).count() == 0
    with pytest.raises(Refused):
        fit.systematic_sample(rows, F.lit(True), "key", 0)


def test_deciles_of_large_and_odd_columns(spark, monkeypatch):
    r = random.Random(11)
    values = [r.lognormvariate(2, 1.5) for _ in range(30_000)] + [3.25] * 9000
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),), (float("inf"),), (float("-inf"),), (-1.0,), (0.0,), (None,)], "x double").repartition(5)
    monkeypatch.setattr(fit, "SORTED", 40)
    want, n = sorted(values), len(values)
    got = {d.pct: d.emp for d in fit.fit_deciles(df, "x").collect()}
    for k in range(1, 10):
        h = (n - 1) * k / 10
        assert abs(got[k * 10] - (want[int(h)] + (want[int(h) + 1] - want[int(h)]) * (h - int(h)))) < 1e-4
    assert not fit.fit_deciles(df.where("x = 0"), "x").count()
    wrong = fit.order_statistics(df.where("x > 0"), "x", [5], len(values), [(3.25, 3.25)])  # a bracket that missed
    assert wrong == {5: want[5]}


def test_sorted_files_are_joined_byte_by_byte(spark, tmp_path):
    rows = [(f"k{i % 7}", i, 'say "so", twice' if i % 5 == 0 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(6)
    out = []
    for k in range(2):
        artifacts.write_sorted(df.repartition(3 + k), str(tmp_path / f"{k}.csv"), ["k"])
        out.append((tmp_path / f"{k}.csv").read_bytes())
    with open(tmp_path / "0.csv", newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert out[0] == out[1] and got[0] == ["k", "i", "v"] and [r[0] for r in got[1:]] == sorted(r[0] for r in rows)
    assert {(a, int(b), c or None) for a, b, c in got[1:]} == set(rows) and len(got) == 501
    artifacts.write_sorted(df.where("false"), str(tmp_path / "0.csv"), ["k"])
    assert (tmp_path / "0.csv").read_bytes() == b"k,i,v\n" and not list(tmp_path.glob(".*.crc"))


def test_links_are_web_addresses_or_repository_files():
    for link in ("https://a.example/x?y=1", "http://a", "docs/plan.md", "a.csv"):
        assert serve.check_panel(serve.Panel("P", "line", "t", links=[link]))
    for link in ("javascript:alert(1)", "ftp://a", "/etc/passwd", "../x", "a/../b", "https://", 'https://a/"x', "a b", ""):
        with pytest.raises(Refused):
            serve.check_panel(serve.Panel("P", "line", "t", links=[link]))


# --- rebuild ---------------------------------------------------------------------


def project_of(folder):
    page = lambda name: f"https://{name}.example/1"
    declared = [{"source": n, "platform": n, "segment": "digital-first", "channel": "unsolicited" if n != "list" else "solicited", "profile": "main", "parser": p, "fetchable": p is not None, "pages": [page(n), page(n) + "2"]} for n, p in (("hand", None), ("list", "jsonld"), ("micro", "microdata"), ("feed", "feed"))]
    folder.mkdir()
    (folder / "sources.json").write_text(json.dumps(declared))
    write_csv(folder / "reviews.csv", files.REVIEWS, [("hand", "1", "u", "2026-01-01T00:00:00", "2026-01-01", "4", "slow", "answer\nis late")])
    write_csv(folder / "anchors.csv", files.ANCHORS, [anchor(platform="peer", segment="digital-first", channel="unsolicited")])
    write_csv(folder / "labels.csv", ("review_id", "label"), [(f"hand:{i}", "delay") for i in range(1, 20)])
    (folder / "rules.yaml").write_text("delay:\n  - LATÉ\npositive:\n  - fine\n")  # patterns are folded as texts are
    fit_rows = [("mu", "3.000000"), ("sigma", "1.000000"), ("n", "400"), ("emp_mean", "33.000000"), *((f"{s}_p{p}", "20.0000") for p in range(10, 100, 10) for s in ("emp", "fit"))]
    write_csv(folder / "fit.csv", ("name", "value"), fit_rows)
    fees = {"f": (1, 9), "g": (3, 7), "overall": (4, 16)}
    write_csv(folder / "fees.csv", ("name", "value"), [(f"{k}_{x}", v) for k, (e, t) in fees.items() for x, v in (("extra", e), ("tariff", t), ("share", f"{e / (e + t):.6f}"))])
    (folder / "families.json").write_text('["f", "g"]')
    entry = lambda i, text: {"id": {"label": i}, "title": {"label": "t"}, "content": {"label": text}, "im:rating": {"label": "5"}, "updated": {"label": "2026-02-03T10:00:00Z"}}
    micro = '<div itemscope itemtype="x/AggregateRating"><meta itemprop=ratingValue content="3.2"><meta itemprop=reviewCount content=9></div><div itemscope itemtype="x/Review"><p itemprop=reviewBody>too late</p><i itemprop=datePublished>05/01/2026</i><u itemprop=ratingValue>2.5</u></div>'
    capture(folder, "list", "c1", 1, '<script type="application/ld+json">{"aggregateRating": {"ratingValue": 4.1235, "ratingCount": 7}}</script>')
    capture(folder, "micro", "c1", 1, "<p>nothing</p>")
    capture(folder, "micro", "c1", 2, micro)
    capture(folder, "feed", "c1", 1, json.dumps({"feed": {"entry": [entry("7", "all fine"), entry("8", "x")]}}))
    capture(folder, "feed", "c1", 2, json.dumps({"feed": {"entry": [entry("8", "x")]}}))
    return folder


def capture(folder, source, name, page, body):
    at = folder / "captures" / source / name
    at.mkdir(parents=True, exist_ok=True)
    (at / f"page-{page}.html").write_text(body)
    (at / f"page-{page}.meta.json").write_text(json.dumps({"source_url": f"https://{source}.example/1" + ("2" if page == 2 else ""), "captured_at": "2026-03-01T00:00:00", "status": 200}))


def test_rebuild_with_anchors_captures_and_all_marts(spark, tmp_path):
    project, at = project_of(tmp_path / "p"), str(tmp_path / "store")
    build.idempotency_check(spark, str(project), at)
    store = Store(spark, at)
    reviews = rows_of(store.read("raw_reviews").select("source", "external_id", "review_date", F.col("rating").cast("double"), "body"))
    assert [r[:2] for r in reviews if r[0] != "micro"] == [("feed", "7"), ("feed", "8"), ("hand", "1")] and [r[2:] for r in reviews if r[0] == "micro"] == [("2026-01-05", 2.5, "too late")]
    shots = rows_of(store.read("raw_platform_snapshots").select("source", "origin", F.col("rating").cast("double"), "review_count", "source_url"))
    assert shots == [("list", "fetch", 4.124, 7, "https://list.example/1"), ("micro", "fetch", 3.2, 9, "https://micro.example/12"), ("peer", "anchor", 4.5, 10, "https://a.example/1")]
    assert rows_of(store.read("peer_ratings").select("source", "tag")) == [("micro", "Measured"), ("peer", "Documented")]
    counts = store.counts()
    assert counts["raw_source_pages"] == 8 and counts["classifier_quality"] in (0, 7) and counts["pipeline_row_counts"] == 3
    themes = {(r.source, r.external_id, r.theme) for r in store.read("stg_classified_reviews").collect() if r.source != "micro"}
    assert themes == {("hand", "1", "delay"), ("feed", "7", "positive"), ("feed", "8", "unclassified")}
    params = {r["name"]: r.default_value for r in store.read("cost_model_params").collect()}
    assert len(params) == 17 and (params["mu"], params["extra_billing_share"]) == (3.0, 0.2)
    html = build.report(spark, at, {"check-1": "counted"})
    panels = ["B1.1", "B1.2", "B1.3", "B1.4", "B2.1", "B2.2", "B2.3", "B2.4", "B2.5", "B3.1", "B3.2", "B3.3", "B3.4", "B4.1", "B4.2", "B4.3", "B4.4", "B5.1", "B5.2"]
    assert [p for p in panels if f'id="{p}"' not in html] == [] and "peer" in html and 'href="https://feed.example/1"' in html
    with pytest.raises(Refused, match="run ids"):
        build.report(spark, at, {"another": "counted"})
    before = store.versions()
    capture(project, "list", "c2", 1, "<p>no rating</p>")
    with pytest.raises(Refused, match="outside its shape"):
        build.rebuild(spark, str(project), at, "check-1")
    assert store.versions() == before and store.counts() == counts


def test_commands_that_sample_slice_and_split(spark, tmp_path):
    from provmart import __main__ as cli

    run = lambda *args: cli.run(spark, cli.parser().parse_args([str(a) for a in args]))
    folder = tmp_path / "amounts"
    folder.mkdir()
    (folder / "a.csv").write_text("PRS_REM_MNT;PRS_REM_TYP\n" + "".join(f"{k},5;0\n" for k in range(30)))
    (folder / "b.csv").write_bytes(gzip.compress(b"PRS_REM_TYP;PRS_REM_MNT\n" + b"".join(b"1;%d\n" % k for k in range(100, 130))))
    run("sample-amounts", folder, "6", tmp_path / "sample.csv")
    lines = (tmp_path / "sample.csv").read_text().splitlines()
    assert lines[0] == "file,at,amount" and [x.rsplit(",", 1)[1] for x in lines[1:]] == ["0.50", "10.50", "20.50", "100.00", "110.00", "120.00"]
    (tmp_path / "fees.csv").write_text("f;t;e\nx;3;1\ny;4;4\nz;1;1\nx;1;0\n")
    run("slice-fees", tmp_path / "fees.csv", "f", "t", "e", "x,y", tmp_path / "slice.csv")
    assert (tmp_path / "slice.csv").read_text() == "f,t,e\nx,1,0\nx,3,1\ny,4,4\n"
    for bad in (("sample-amounts", folder, "0", "x"), ("slice-fees", tmp_path / "fees.csv", "f", "t", "e", "x,none", tmp_path / "s"), ("split-fees", tmp_path / "fees.csv", "f", "t", "e", tmp_path / "s", "--families", "x,y")):
        with pytest.raises(Refused):
            run(*bad)
    run("split-fees", tmp_path / "fees.csv", "f", "t", "e", tmp_path / "split.csv", "--families", "x,y,z")
    assert files.read_fee_split(spark, str(tmp_path / "split.csv"), ("x", "y", "z"))["overall"][:2] == (6, 9)


def test_open_texts_are_folded_and_searched_once(spark, monkeypatch):
    monkeypatch.setattr(K.work, "stored", lambda df, name: df)
    docs = spark.createDataFrame([(1, "Délai"), (2, "nothing"), (3, "with"), (4, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, prompt_version string, model string, theme string")
    rules = {"delay": ["delai", "late"], "contact": ["with"], "refund": ["money"], "positive": ["good"]}
    got = K.answered(docs, rules, none, "v", "m", lambda ids, texts: [["refund"] if t else None for t in texts], ["refund"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=(") == 1  # the pattern of all rules
    assert sorted((r.doc_id, r.theme) for r in got.collect()) == [(2, "refund"), (4, "unclassified")]


def test_pages_are_parsed_by_batches(spark):
    one = {"label": "1"}
    entry = {k: one for k in ("id", "title", "content", "im:rating")} | {"updated": {"label": "2024-01-02T03:04:05-07:00"}}
    bodies = [json.dumps({"feed": {"entry": [entry] * n}}) for n in (0, 1, 3)]
    rows = [(i, "feed", b, i * 10) for i, b in enumerate(bodies)] + [(3, "feed", None, 30), (4, None, "x", 40)]
    got = html_pages.parsed(spark.createDataFrame(rows, "page long, parser string, body string, extra long"))
    assert "UDTF" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns[:3] == ["page", "parser", "extra"]
    kinds = sorted((r.page, r.extra, r.kind, r.review_date) for r in got.collect())
    assert kinds == [(1, 10, "review", "2024-01-02")] + [(2, 20, "review", "2024-01-02")] * 3 + [(3, 30, "refused", None), (4, 40, "refused", None)]
