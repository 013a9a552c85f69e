import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from provmart.functions import text as T
from provmart.operators import classify as K
from provmart.operators import latest, load
from provmart.operators.commits import Store
from provmart.plans import cost_model as M
from provmart.plans import serve
from provmart.sources import files, html_pages


def one(spark, kind, *exprs):
    rows = spark.createDataFrame([(x,) for x in kind], "x string").select("x", *[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    return {r.x: r.c0 if len(exprs) == 1 else tuple(r)[1:] for r in rows}


def test_half_steps_by_spelling(spark):
    got = one(spark, ["4", "4.5", "4.0", "5", "5.5", "0.5", "4\n"], T.half_step(F.col("x")))
    assert [k for k, v in got.items() if v is not None] == ["4", "4.5", "5"]


def test_amounts_counts_days(spark):
    assert one(spark, ["1,5", "-2", "0", "3e4", "12\n7"], T.amount(F.col("x"))) == {"1,5": 1.5, "-2": None, "0": None, "3e4": None, "12\n7": None}
    assert one(spark, ["2147483647", "2147483648", "01", "x"], T.count_value(F.col("x"))) == {"2147483647": 2147483647, "2147483648": None, "01": 1, "x": None}
    assert one(spark, ["2026-02-29", "2024-02-29", "2024-2-9"], T.real_day(F.col("x"))) == {"2026-02-29": None, "2024-02-29": "2024-02-29", "2024-2-9": None}
    assert one(spark, ["31/02/2026", "01/03/2026"], T.slashed_day(F.col("x"))) == {"31/02/2026": None, "01/03/2026": "2026-03-01"}


def test_page_rating_rounds_half_even(spark):
    got = one(spark, ["4.1235", "4.1225", "5.1", "123"], T.page_rating(F.col("x")).cast("string"))
    assert got == {"4.1235": "4.124", "4.1225": "4.122", "5.1": None, "123": None}


def test_canonical_and_fold(spark):
    d = spark.createDataFrame([("4.900",), ("100",), ("0.000",), ("10.000",), (None,)], "x string").select(T.canonical(F.col("x")).alias("c"))
    assert [r.c for r in d.collect()] == ["4.9", "100", "0", "10", ""]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    for t, got in one(spark, ["Élan Straße", "ÀÇÑü", "abc"], T.fold(F.col("x"))).items():
        assert got == plain(t)
    assert one(spark, ["Ǆ Ａ"], T.fold_any(F.col("x"))) == {"Ǆ Ａ": plain("Ǆ Ａ")}


def test_first_of_a_batch_wins_and_append_is_idempotent(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x")]
    batch = spark.createDataFrame([(k, v, h, i) for i, (k, v, h) in enumerate(rows)], "k string, v int, h string, n long")
    path = str(tmp_path / "raw")
    assert load.append(batch, path, ["k", "v"], "n") == 2
    assert load.append(batch, path, ["k", "v"], "n") == 0
    assert {(r.k, r.h) for r in spark.read.parquet(path).collect()} == {("a", "x"), ("b", "x")}
    with pytest.raises(load.Refused):
        load.append(batch, path, ["k", "v"], "n", "h")
    with pytest.raises(load.Refused):
        load.append(spark.createDataFrame([(" ", 1, "h", 0)], batch.schema), path, ["k", "v"], "n")


def test_latest_measure_does_not_blank_others(spark):
    rows = [("s", "p", "o", "2026-01-01", "u", 4.0, None), ("s", "p", "o", "2026-01-02", "u", None, 7.0)]
    raw = spark.createDataFrame([("g", "c", *r) for r in rows], "segment string, channel string, source string, profile string, origin string, captured_at string, source_url string, rating double, response_rate double")
    got = {r.stat: float(r.value) for r in latest.platform_stats(latest.stage_snapshots(raw), ["rating", "response_rate"]).collect()}
    assert got == {"rating": 4.0, "response_rate": 7.0}


def test_shares_count_a_text_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "Bêta"), (3, "nothing"), (4, "good"), (5, None)], "doc_id long, text string")
    c = K.classify(docs, {"a": ["alpha"], "b": ["beta"], "positive": ["good"]})
    assert sorted(tuple(r) for r in c.collect()) == [(1, "a"), (1, "b"), (2, "b"), (3, "unclassified"), (4, "positive"), (5, "unclassified")]
    share = {r.label: r.share for r in K.theme_share(c.withColumn("g", F.lit("x")), ["g"]).collect()}
    assert share == {"a": 0.2, "b": 0.4, "unclassified": 0.4, "positive": 0.2}
    asked = []
    decider = lambda ids: asked.extend(r.doc_id for r in ids.collect()) or ids.select("doc_id", F.lit("a").alias("theme"))
    cache = spark.createDataFrame([(3, "v", "m", "b")], "doc_id long, prompt_version string, model string, theme string")
    merged = {(r.doc_id, r.theme) for r in K.merge_decisions(c, cache, "v", "m", decider=decider).collect()}
    assert asked == [5] and {(3, "b"), (5, "a"), (1, "a")} <= merged


def test_model_pins(spark):
    out = {(r.scenario, r.name): r.value for r in M.cost_outputs(spark).collect()}
    base = {k: out["baseline", k] for k in ("mean_claim", "claims", "fraud_saved", "friction_cost", "net", "timer_amount_eur", "crossover_flag_rate", "marginal_crossover_flag_rate")}
    assert base == {"mean_claim": 494.45, "claims": 707858, "fraud_saved": 1318719.82, "friction_cost": 1132573.36, "net": 186146.45, "timer_amount_eur": 42.67, "crossover_flag_rate": 0.095, "marginal_crossover_flag_rate": 0.05}
    assert out["contacts_once", "crossover_flag_rate"] == 0.18 and out["both", "crossover_flag_rate"] is None and len(out) == 60
    a = {r.claim_rank: r.amount_eur for r in M.synthetic_claims(spark).collect()}
    assert (a[1], a[500], a[1000]) == (0.03, 45.02, 60441.06) or abs(a[500] - 45.02) < 0.2
    sla = [r for r in M.sla_threshold(spark).collect() if r.is_default]
    assert len(sla) == 1 and sla[0].share_under == 0.49


def test_html_readers():
    page = '<script type="application/ld+json">{"@graph":[{"aggregateRating":{"ratingValue":"4.12","ratingCount":7}}]}</script><script type="application/ld+json">{bad</script>'
    assert html_pages.aggregate_rating(page) == ("4.12", "7")
    with pytest.raises(ValueError):
        html_pages.aggregate_rating(page + page)
    review = '<div itemscope itemtype="http://schema.org/Review"><span itemprop="author" itemscope><b itemprop="reviewBody">never</b></span><p itemprop="reviewBody">Good &amp; quick</p><i itemprop="datePublished">le 02/01/2026</i><div itemprop="reviewRating" itemscope itemtype="x/Rating"><meta itemprop="ratingValue" content="4.5"><meta itemprop="worstRating" content="1"><meta itemprop="bestRating" content="5"></div></div>'
    (r,), total = html_pages.microdata(review)
    assert (r["rating"], r["review_date"], r["body"], total) == ("4.5", "2026-01-02", "Good & quick", None)


def test_robots():
    text = "User-agent: *\nDisallow: /a*b$\nDisallow: /x\nAllow: /x/y\n\nUser-agent: ours\nDisallow: /only\n"
    allowed = lambda u: html_pages.robots_allows(text, "https://h" + u, "ours-bot")
    assert [allowed(u) for u in ("/a-b", "/a-bc", "/x/z", "/x/y/z", "/only/1", "/")] == [False, True, False, True, False, True]
    assert not html_pages.rule_matches("/" + "*a" * 30 + "$", "/" + "b" * 300)


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("source,external_id,source_url,captured_at,review_date,rating,title,body\ns,1,u,2026-01-01T00:00:00,2026-01-01,4.5,t,b\n")
    assert files.read_reviews(spark, str(tmp_path / "r.csv")).first().rating == __import__("decimal").Decimal("4.5")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(load.Refused):
        files.read_csv(spark, str(tmp_path / "bad.csv"), ("a", "c"))
    (tmp_path / "f.json").write_text('{"feed":{"entry":[{"id":{"label":"7"},"title":{"label":"t"},"content":{"label":"c"},"im:rating":{"label":"4"},"updated":{"label":"2026-01-02T10:00:00-07:00"}}]}}')
    assert files.read_json_feed(spark, str(tmp_path / "f.json")).first().review_date == "2026-01-02"
    (tmp_path / "g.json").write_text('{"feed":{"entry":5}}')
    with pytest.raises(load.Refused):
        files.read_json_feed(spark, str(tmp_path / "g.json"))


def test_stream_append(spark, tmp_path):
    from provmart.streaming.append import append_stream

    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    append_stream(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "c")}


def test_panel_contract():
    ok = serve.Panel("P1", "line", "T & U", [serve.Point("a<b", 1.5), serve.Point("none", None, "Pending", "not yet")], [0.5], [0.5, 1.0])
    assert "a&lt;b" in serve.render([ok])
    for bad in (serve.Point("x", 1.0, "Guess"), serve.Point("x"), serve.Point("x", 1.0, "Pending")):
        with pytest.raises(load.Refused):
            serve.check_panel(serve.Panel("P", "k", "t", [bad]))
    assert datetime  # no clock is read on the data path


def test_display_forms(spark):
    d = spark.createDataFrame([(1234.5, 0.231, 4.13, 2.5)], "eur double, pct double, stars double, count double")
    row = d.select(*[T.displayed(u, F.col(c)).alias(c + u) for c, u in (("eur", "eur"), ("pct", "pct"), ("stars", "stars"), ("count", "count"), ("eur", "logeur"), ("eur", "days"), ("eur", ""))]).first()
    assert tuple(row) == ("€1,234.50", "23.1%", "4.1★", "2", "1234.500000 log-euros", "1234.5 days", "1234.50")
    with pytest.raises(ValueError):
        T.displayed("yen", F.col("eur"))


def test_measures_are_exact_and_in_range(spark):
    got = one(spark, ["4.123", "4.1234", "9.5", "-3", "5", "0.5", "", "12"], *[T.measure(n, F.col("x")).cast("string") for n in ("rating", "one_star_share", "response_delay_days")])
    assert got["4.123"] == ("4.123", None, None) and got["4.1234"] == got["-3"] == got[""] == (None, None, None)
    assert got["9.5"] == (None, None, "9.5") and got["5"] == ("5.000", None, "5.0") and got["0.5"] == ("0.500", "0.500", "0.5") and got["12"] == (None, None, "12.0")


def sheet(path, header, *rows):
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return str(path)


def test_snapshot_readers_refuse(spark, tmp_path):
    sources = spark.createDataFrame([("hand", None, False, ["https://a.example/1"]), ("page", "jsonld", True, ["https://b.example/1", "https://b.example/2"])], "source string, parser string, fetchable boolean, pages array<string>")
    manual, fetched, anchors = (",".join(x) for x in (files.MANUAL, files.FETCHED, files.ANCHORS))
    ok = files.read_manual(spark, sheet(tmp_path / "m.csv", manual, "hand,2026-01-01T00:00:00,4.5,10,0.125,,3.5,seen"), sources).first()
    assert (str(ok.rating), ok.review_count, ok.response_rate, str(ok.response_delay_days), ok.origin) == ("4.500", 10, None, "3.5", "manual")
    assert not files.read_manual(spark, str(tmp_path / "none.csv"), sources).count()
    for row in ("page,2026-01-01T00:00:00,4.5,10,,,,seen", "hand,2026-01-01T00:00:00,9.5,10,,,,seen", "hand,2026-01-01T00:00:00,4.12345,10,,,,seen", "hand,2026-01-01T00:00:00,4.5,10,5.5,,,seen", "hand,2026-01-01T00:00:00,4.5,10,,,-3,seen"):
        with pytest.raises(load.Refused):
            files.read_manual(spark, sheet(tmp_path / "bad.csv", manual, row), sources)
    got = files.read_fetched(spark, sheet(tmp_path / "f.csv", fetched, "page,2026-01-01T00:00:00,4.5,10,,,"), sources).first()
    assert (got.source_url, got.origin) == ("https://b.example/1", "fetch")
    with pytest.raises(load.Refused):
        files.read_fetched(spark, sheet(tmp_path / "g.csv", fetched, "hand,2026-01-01T00:00:00,4.5,10,,,"), sources)
    a = files.read_anchors(spark, sheet(tmp_path / "a.csv", anchors, "p,q,s,c,4.0,1,,,,2026-01-01T00:00:00,u,doc")).first()
    assert (a.source, a.origin, str(a.rating)) == ("p", "anchor", "4.000")


def test_every_file_of_a_folder_has_the_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sheet(folder / "a.csv", "name,value", "x,1")
    sheet(folder / "b.csv", "value,name", "2,y")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(folder), ("name", "value")).collect()


def test_amounts_by_content(spark, tmp_path):
    import gzip

    text = "PRS_REM_MNT;PRS_REM_TYP;X\n1,5;0;a\n-2;0;a\n7;1;a\n9;4;a\n"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "plain.csv").write_text(text)
    (folder / "wrong.csv").write_bytes(gzip.compress(text.encode()))
    (folder / "also.csv.gz").write_text(text)
    (folder / "right.csv.gz").write_bytes(gzip.compress(text.encode()))
    got = [r.amount for r in files.read_amounts(spark, str(folder), f"file://{tmp_path}/scratch").collect()]
    assert sorted(got) == [1.5] * 4 + [7.0] * 4


def test_captures_are_checked(spark, tmp_path):
    import json

    def capture(name, **meta):
        folder = tmp_path / name / "c1"
        folder.mkdir(parents=True)
        for n in (1, 2, 10):
            (folder / f"page-{n}.html").write_text(f"<p>{n}")
            (folder / f"page-{n}.meta.json").write_text(json.dumps({"source_url": "https://h.example/a", "captured_at": "2026-01-02T03:04:05", "status": 200} | meta))
        (folder / "page-3.refused.html").write_text("no")
        return files.read_captures(spark, str(tmp_path / name), ["https://h.example/a"], "h.example")

    got = capture("good").collect()
    assert sorted((r.page, r.body, r.capture) for r in got) == [(1, "<p>1", "c1"), (2, "<p>2", "c1"), (10, "<p>10", "c1")]
    assert [r.page for r in files.first_snapshot(capture("first")).collect()] == [1]
    for k, bad in enumerate(({"status": 404}, {"captured_at": "2026-02-30T00:00:00"}, {"source_url": "http://h.example/a"}, {"source_url": "https://x.example/a"}, {"source_url": "https://h.example/b"}, {"more": 1})):
        with pytest.raises(load.Refused):
            capture(f"bad{k}", **bad)


def test_microdata_refuses_nested_and_repeated():
    review = '<div itemscope itemtype="x/Review"><i itemprop="datePublished">01/02/2026</i><b itemprop="reviewRating" itemscope itemtype="x/Rating"><meta itemprop="ratingValue" content="4">{0}</b>{1}</div>'
    assert len(html_pages.microdata(review.format("", ""))[0]) == 1
    for bad in (review.format("", review.format("", "")), review.format('<meta itemprop="ratingValue" content="5">', "")):
        with pytest.raises(ValueError):
            html_pages.microdata(bad)
    html_pages.microdata("<div itemprop=a>" * 20_000)  # unclosed elements cost no more than closed ones


def test_robots_expression_equals_the_matcher(spark):
    text = "User-agent: *\nDisallow: /a*b$\nDisallow: /x\nAllow: /x/y\nDisallow: /*?q=\n\nUser-agent: ours\nDisallow: /only\nAllow: /only/*z$\n"
    urls = ["https://h" + p for p in ("/a-b", "/a-bc", "/aXbYb", "/x/z", "/x/y/z", "/only/1", "/only/1z", "/", "", "?q=1", "/p?q=2#f", "/p?")] + ["https://h/" + "a" * 300]
    got = one(spark, urls, html_pages.robots_allowed(F.col("x"), text + "Disallow: /" + "*a" * 30 + "x$\n", "ours-bot"))
    assert got == {u: html_pages.robots_allows(text, u, "ours-bot") for u in urls}


def test_artifacts(spark, tmp_path):
    from provmart.sources import artifacts

    fit = {"mu": 3.8, "sigma": 2.1, "n": 5000, "emp_mean": 847.5}
    artifacts.write_fit(str(tmp_path / "fit.csv"), fit, [{"pct": p, "emp": p / 10, "fit": p / 11} for p in range(10, 100, 10)])
    back = files.read_fit(spark, str(tmp_path / "fit.csv"))
    assert (back["mu"], back["n"], back["emp_p90"]) == (3.8, 5000, 9.0) and M.parameters(fit | {"emp_p50": back["emp_p50"]})
    sheet(tmp_path / "fit2.csv", "name,value", *(tmp_path / "fit.csv").read_text().splitlines()[1:], "mu,1")
    for bad in ("fit2.csv",):
        with pytest.raises(load.Refused):
            files.read_fit(spark, str(tmp_path / bad))
    rows = [{"family": "b", "extra": 1, "tariff": 3}, {"family": "overall", "extra": 3, "tariff": 9}, {"family": "a", "extra": 2, "tariff": 6}]
    artifacts.write_fee_split(str(tmp_path / "fee.csv"), rows)
    assert files.read_fee_split(spark, str(tmp_path / "fee.csv"), ("a", "b"))["overall"] == (3, 9, 0.25)
    artifacts.write_fee_split(str(tmp_path / "fee2.csv"), rows[:1] + rows[2:] + [{"family": "overall", "extra": 4, "tariff": 9}])
    with pytest.raises(load.Refused):
        files.read_fee_split(spark, str(tmp_path / "fee2.csv"), ("a", "b"))
    old, new = (spark.createDataFrame(x, "source string, captured_at string, rating string") for x in ([("s", "2026-01-01", "4")], [("s", "2026-01-01", "4"), ("s", "2026-01-08", "5")]))
    path = str(tmp_path / "series.csv")
    assert artifacts.record_series(path, old, new, ["source", "captured_at"]) == 1
    first = (tmp_path / "series.csv").read_bytes()
    assert artifacts.record_series(path, new, new, ["source", "captured_at"]) == 0 and (tmp_path / "series.csv").read_bytes() == first
    artifacts.write_fixture(str(tmp_path / "fx"), {"a.csv": (["h"], [["1"]])})
    artifacts.check_fixture(str(tmp_path / "fx"))
    (tmp_path / "fx" / "a.csv").write_text("h\n2\n")
    with pytest.raises(load.Refused):
        artifacts.check_fixture(str(tmp_path / "fx"))
    (tmp_path / "fees.csv").write_text("\ufeff\ufeffyear;extra\n2024;5\n", encoding="utf-8")
    assert tuple(files.read_fee_table(spark, str(tmp_path / "fees.csv"), ("year", "extra")).first()) == ("2024", "5")
    key = sheet(tmp_path / "key.csv", "review_id,label", "r1,delay")
    assert files.read_answer_key(spark, key, ("delay",)).count() == 1
    decisions = spark.createDataFrame([("r2", "v", "m", "delay"), ("r1", "v", "m", "delay")], "review_id string, prompt_version string, model string, theme string")
    artifacts.write_decisions(str(tmp_path / "d.csv"), decisions)
    assert [r.review_id for r in files.read_decisions(spark, str(tmp_path / "d.csv"), ("delay",)).collect()] == ["r1", "r2"]
    for read, name, line in ((files.read_answer_key, "review_id,label", "r1,other"), (files.read_decisions, "review_id,prompt_version,model,theme", "r1,v,m,other")):
        with pytest.raises(load.Refused):
            read(spark, sheet(tmp_path / "bad.csv", name, line), ("delay",))


def test_segments_and_families_are_closed(spark):
    from provmart.sources import artifacts

    reviews = spark.createDataFrame([(1, "a")], "id int, source string")
    declared = lambda *rows: spark.createDataFrame(rows, "platform string, segment string")
    assert artifacts.with_segment(reviews, declared(("a", "x"), ("b", "y"))).first().segment == "x"
    for rows in ([("b", "y")], [("a", "x"), ("a", "y")]):
        with pytest.raises(load.Refused):
            artifacts.with_segment(reviews, declared(*rows)).collect()
    split = spark.createDataFrame([("a", 1.0, 3.0, 0.25), ("b", 1.0, 1.0, 0.5), ("overall", 2.0, 4.0, 0.33)], "family string, extra double, tariff double, share double")
    assert {(r.lowest, r.highest) for r in artifacts.closed_families(split, ["a", "b"]).collect()} == {(0.25, 0.5)}
    with pytest.raises(load.Refused):
        artifacts.closed_families(split, ["a", "c"])


def test_serving_guards(spark, tmp_path):
    import sqlite3

    df = spark.createDataFrame([("run-1", "t", 1.50)], "run_id string, label string, share double").withColumn("share", F.col("share").cast("decimal(4,2)"))
    assert serve.corpus_gate(df, {"run-1": "counted"}) == "counted" and serve.corpus_gate(df.where("false"), {}) == "no data"
    for bad in ({}, {"run-2": "x"}):
        with pytest.raises(load.Refused):
            serve.corpus_gate(df, bad)
    assert len(serve.served(df, {"run_id", "label", "share"})) == 1
    with pytest.raises(load.Refused):
        serve.served(df, {"label"})
    serve.export_sqlite({"m": df}, str(tmp_path / "x.db"), {"body"})
    db = sqlite3.connect(tmp_path / "x.db")
    assert db.execute("SELECT share FROM m").fetchall() == [("1.50",)]
    with pytest.raises(load.Refused):
        serve.export_sqlite({"m": df}, str(tmp_path / "x.db"), {"label"})
    serve.write_csv(df, str(tmp_path / "x.csv"), ["label"])
    assert (tmp_path / "x.csv").read_text() == "run_id,label,share\nrun-1,t,1.50\n"


def test_decided_equals_merged(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "none"), (4, "good"), (5, None)], "doc_id long, text string")
    rules = {"a": ["alpha"], "b": ["beta"], "positive": ["good"]}
    cache = spark.createDataFrame([(3, "v", "m", "b"), (3, "v", "m", "a"), (3, "w", "m", "c"), (1, "v", "m", "b")], "doc_id long, prompt_version string, model string, theme string")
    want = {tuple(r) for r in K.merge_decisions(K.classify(docs, rules), cache, "v", "m").collect()}
    got = K.decided(docs, rules, cache, "v", "m").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_reply_tokens_and_texts(spark):
    assert one(spark, ["Delay, re-fund!", "-delay-", "delayed"], T.reply_labels(F.col("x"), ["delay", "re-fund"])) == {"Delay, re-fund!": ["delay", "re-fund"], "-delay-": ["delay"], "delayed": []}
    d = spark.createDataFrame([(" t ", "b\n"), (None, "b"), ("t", " "), (None, None)], "t string, b string")
    assert [r.x for r in d.select(T.joined_text(F.col("t"), F.col("b")).alias("x")).collect()] == ["t\nb", "b", "t", ""]
    assert one(spark, ["1234.0", "0.034"], T.rounded_up(F.col("x").cast("double"))) == {"1234.0": 2000.0, "0.034": pytest.approx(0.04)}


def test_order_statistics_equal_sorting(spark, monkeypatch):
    import random

    from provmart.operators import fit as fitting

    r = random.Random(5)
    values = [r.lognormvariate(3, 2) for _ in range(6000)] + [7.5] * 4000 + [0.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    want = sorted(values)
    ranks = [0, 1, 2500, 5000, 5001, 9999, len(values) - 1]
    for most in (50_000, 300):
        monkeypatch.setattr(fitting, "SORTED", most)
        assert fitting.order_statistics(df, "x", ranks) == {k: want[k] for k in ranks}
    assert fitting.order_statistics(df.where("false"), "x", [0]) == {}


def test_sql_files(spark):
    from provmart.plans import warehouse

    text = "-- now; it begins\nSELECT 1 AS a, 'x;now()' AS b;\nSELECT 2 AS c -- like this\n;"
    assert [df.columns for df in warehouse.run_sql(spark, text)] == [["a", "b"], ["c"]] and not warehouse.lint(text)
    assert len(warehouse.lint("SELECT now() FROM t WHERE a LIKE 'b' QUALIFY 1 = 1")) == 3
    spark.range(3).createOrReplaceTempView("three")
    assert "three" in warehouse.tables(spark) and warehouse.columns(spark, "three") == [("id", "bigint")]
    with pytest.raises(load.Refused):
        warehouse.columns(spark, "none")


def test_commands(spark, tmp_path, capsys):
    import json

    from provmart import __main__ as cli

    project, store = tmp_path / "project", str(tmp_path / "store")
    project.mkdir()
    source = {"source": "a", "platform": "a", "segment": "digital", "channel": "open", "profile": "p", "parser": None, "fetchable": False, "pages": ["https://a.example/1", "https://a.example/2"]}
    (project / "sources.json").write_text(json.dumps([source]))
    review = "a,{0},u,2026-01-0{0}T00:00:00,2026-01-0{0},4,{1},{2}"
    sheet(project / "reviews.csv", ",".join(files.REVIEWS), review.format(1, "slow", "answer is late"), review.format(2, "good", "fine"), review.format(3, "x", "nothing"), review.format(3, "x", "nothing"))
    sheet(project / "manual.csv", ",".join(files.MANUAL), "a,2026-01-01T00:00:00,4.5,10,0.125,,3.5,seen")
    (project / "rules.yaml").write_text("delay:\n  - late\npositive:\n  - fine\n")
    sheet(project / "decisions.csv", "review_id,prompt_version,model,theme", "a:3,v1,none,refund")
    assert cli.run(spark, cli.parser().parse_args(["idempotency-check", str(project), store])) is None
    spark.catalog.clearCache()
    at = Store(spark, store)
    themes = {(r.review_id, r.theme) for r in at.read("stg_classified_reviews").collect()}
    assert themes == {("a:1", "delay"), ("a:2", "positive"), ("a:3", "refund")}
    assert at.read("rating_trend").count() == 1 and at.read("raw_reviews").count() == 3
    key = sheet(tmp_path / "key.csv", "review_id,label", "a:1,delay")
    (tmp_path / "fees.csv").write_text("f;t;e\nx;3;1\ny;4;4\n")
    (tmp_path / "amounts.csv").write_text("PRS_REM_MNT;PRS_REM_TYP\n" + "".join(f"{k};0\n" for k in range(1, 40)))
    for args in (
        ["label-sample", store, "2", str(tmp_path / "sheet.csv")], ["classify-eval", store, key], ["report", store, str(tmp_path / "r.html"), "--run", "check-1"], ["export", store, str(tmp_path / "x.db")],
        ["split-fees", str(tmp_path / "fees.csv"), "f", "t", "e", str(tmp_path / "split.csv")], ["fit-amounts", str(tmp_path / "amounts.csv"), str(tmp_path / "scratch"), str(tmp_path / "fit.csv")], ["simulate"],
    ):
        cli.run(spark, cli.parser().parse_args(args))
    assert len((tmp_path / "sheet.csv").read_text().splitlines()) == 3 and "digital delay" in (tmp_path / "r.html").read_text()
    assert files.read_fee_split(spark, str(tmp_path / "split.csv"), ("x", "y"))["overall"][:2] == (5, 7) and files.read_fit(spark, str(tmp_path / "fit.csv"))["emp_p50"] == 20.0
    for bad in (["rebuild", str(project), store, "--stage", "all"], ["reset", store], ["label-sample", store, "0", "x"]):
        with pytest.raises(load.Refused):
            cli.run(spark, cli.parser().parse_args(bad))
    cli.run(spark, cli.parser().parse_args(["reset", store, "--confirm", "store"]))
    assert "deleted" in capsys.readouterr().out
