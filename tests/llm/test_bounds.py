"""Steps that must stay small whatever the input: samples, frequent words, repairs of pages; and odd types."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from provmart.llm import common as C
from provmart.llm import decontaminate, html_wrapper, language_id, lm_score, nearest, ngram_jaccard, sentencepiece_codec, warc_index


def test_samples_are_the_rows_of_least_hash(spark):
    rows = spark.range(5000).withColumnRenamed("id", "id").repartition(7)
    for n, seed in ((64, 1), (300, None), (6000, None)):
        h = F.xxhash64("id") if seed is None else F.xxhash64("id", F.lit(seed))
        want = [r.id for r in rows.orderBy(h, "id").limit(n).collect()]
        few = nearest.drawn(rows, n, seed, 5000)
        assert [r.id for r in few.collect()] == want
    assert not nearest.drawn(rows.where("false"), 10, 1, 0).count()


def test_frequent_words_are_those_of_greatest_count(spark):
    r = random.Random(2)
    counts = [1] * 4000 + [2] * 900 + [r.randrange(3, 5000) for _ in range(300)] + [10**6, 10**6 + 1, 1 << 40]
    words = spark.createDataFrame([(r.getrandbits(64) - (1 << 63), i % 5, c) for i, c in enumerate(counts)], "h long, cls int, n long").repartition(5)
    for most in (1, 2, 100, 303, 500, 2500, 5203, 9000):
        want = [tuple(x) for x in words.orderBy(F.desc("n"), "h").limit(most).collect()]
        assert [tuple(x) for x in lm_score.most_frequent(words, most).collect()] == want
    assert not lm_score.most_frequent(words.where("false"), 5).count()


def test_queries_of_another_length_take_no_part(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist()) for i in range(60)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = spark.createDataFrame([(1000 + i, [1.0, 2.0]) for i in range(5)] + [(2000, rows[7][1])], index.schema)
    got = nearest.search(index, asks, k=3).orderBy("query_id", "rank").collect()
    want = sorted(((-float(np.dot(v, rows[7][1])), i) for i, v in rows))[:3]
    assert [(x.query_id, x.rank, x.vec_id) for x in got] == [(2000, k + 1, i) for k, (_, i) in enumerate(want)]


def test_benchmark_items_may_have_ids_of_any_type(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    docs = spark.createDataFrame([("d1", f"x {item} y", 1.0), ("d2", "nothing of it", 2.0)], "doc_id string, text string, coverage double")
    bench = spark.createDataFrame([("item-a", item), (None, None)], "item_id string, text string")
    found = decontaminate.tiled(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [("d1", "item-a")]


def test_pages_of_open_elements_and_stray_ends_are_read_in_linear_time():
    began = time.time()
    html_wrapper.parse("<div>" * 40_000 + "</b>" * 40_000 + "<p>x" * 40_000 + "</td>" * 40_000)
    assert time.time() - began < 20
    tree = html_wrapper.parse("<article><p>a<p>b</section></i><div>c</article>d</p>e")
    kinds = [c.tag for c in tree.children[0].children]
    assert kinds == ["p", "p"] or kinds == ["p", "p", "div"]


def test_one_stretch_of_several_megabytes_encodes_as_the_library_does():
    """No space anywhere, so nothing of it can be cut off or remembered."""
    codec, r = sentencepiece_codec.Codec(sentencepiece_codec.default_model()), random.Random(1)
    text = "".join(r.choice(["a", "b", "th", "é", "中", "1"]) for _ in range(1_500_000))
    assert len(text.encode()) > 2_000_000
    (ids,) = codec.encode_all([text])
    want = [codec.library.bos_id(), *codec.library.encode(text), codec.library.eos_id()]
    assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids) == codec.library.decode(want)


def test_repeated_rows_are_predicted_alike_and_train_like_so_many_rows(spark):
    rows = [(i, lang, text) for i in range(40) for lang, text in (("en", "the house and the garden with this tree"), ("de", "der hund und die katze nicht mit dem baum"))]
    df = spark.createDataFrame([*rows, *rows[:6], *rows[:6]], "doc_id long, lang string, text string")
    once, twice = (language_id.train(language_id.training_rows(d)) for d in (df, df.union(df)))
    assert {k: list(v) for k, v in once.items()} == {k: list(v) for k, v in twice.items()}
    got = language_id.predict(df, once).collect()
    assert len(got) == len(rows) + 12 and all(r.lang_pred == r.lang for r in got) and len({(r.lang, r.score) for r in got}) == 2


def test_a_page_of_several_megabytes_is_archived_whole(spark):
    long = "é<p>" * 1_500_000
    pages = spark.createDataFrame([(1, "http://h.example/1", long), (2, "http://h.example/2", "short"), (3, "http://h.example/3", long)], "page_id long, url string, html string")
    path = C.new_path(spark, "warc")
    warc_index.write(pages, path, file_bytes=1 << 20)
    got = warc_index.merged_index(C.materialize(warc_index.read(spark, path), "runs")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert [tuple(r) for r in got] == [(1, 7_500_000, "revisit", 3), (2, 5, "response", None), (3, 7_500_000, "response", None)]


def test_scores_depend_neither_on_files_nor_on_tasks(spark, tmp_path):
    """The same rows as 1, 4 and 32 files, learnt in one piece and in several."""
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(r.choices(words, range(300, 0, -1), k=r.randrange(5, 120)))) for i in range(400)] + [(i, "the same text again and again") for i in range(400, 440)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece, least in ((lm_score.PIECE, 1), (6000, 3)):
        found = []
        for n in (1, 4, 32):
            path = f"{tmp_path}/{piece}-{n}"
            df.repartition(n).write.parquet(path)
            docs = lm_score.training_rows(spark.read.parquet(path))
            trained = lm_score.train(docs, epochs=2, piece=piece)
            assert lm_score.pieces(docs, "text", "doc_id", trained[1].total, piece).rdd.getNumPartitions() >= least
            found.append({x.doc_id: x.score for x in lm_score.score(df, *trained).collect()})
        assert all(abs(found[0][i] - other[i]) <= 1e-6 * abs(found[0][i]) for other in found[1:] for i in found[0])


def test_probing_holds_few_queries_at_once_and_keeps_the_order_of_one_queue():
    import heapq
    import tracemalloc

    r = np.random.default_rng(5)
    v = r.normal(size=(3000, 8))
    forest = nearest.Forest(v, float(np.sqrt((v * v).sum(1).max())), 6, 8)
    size = np.bincount(forest.place(v).ravel(), minlength=forest.leaves + 1)
    tracemalloc.start()
    got = [(leaves, held[-1]) for leaves, held in forest.probe(v, size, 200)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3000 and peak < 3000 * len(forest.normals) * 8 / 4  # margins of all queries would be four times that
    for k in range(0, 3000, 300):
        q = np.append(v[k], 0) / np.sqrt(v[k] @ v[k]) * forest.most
        margin = forest.normals @ q - forest.offsets
        queue, leaves, total = [(-np.inf, x) for x in forest.roots], [], 0
        heapq.heapify(queue)
        while total < 200:
            far, node = heapq.heappop(queue)
            while node >= 0:
                up = int(margin[node] > 0)
                heapq.heappush(queue, (max(far, abs(margin[node])), int(forest.children[node, 1 - up])))
                node = int(forest.children[node, up])
            if size[-node]:
                leaves.append(-node)
                total += size[-node]
        worst = lambda found: len(set(found) ^ set(leaves))  # noqa: E731  # where places tie, either may come first
        assert total >= 200 and got[k][1] >= 200 and worst(got[k][0].tolist()) <= 6


def test_segments_of_sets_in_no_pair_are_not_shuffled(spark, monkeypatch):
    """Only the sets that pairs name, and of folded sets one row, go on; beyond the bound all go to the join, with the same links."""
    grams = {k: [*range(100 * (k // 2), 100 * (k // 2) + 8 + k % 2)] for k in range(40)}  # 2k and 2k + 1 overlap in 8 of 9
    sets = C.materialize(spark.createDataFrame([(k, [(0, g)]) for k, g in grams.items()], "row long, segments array<struct<frag:int,grams:array<bigint>>>"), "sets")
    pairs = C.materialize(spark.createDataFrame([(0, 8, 1, 9), (6, 8, 7, 9), (6, 8, 9, 9)], "a long, na int, b long, nb int"), "pairs")
    ends = lambda: [sorted(r.row for r in ngram_jaccard.of_pairs(sets, pairs, side).collect()) for side in "ab"]
    found = lambda: sorted(tuple(r) for r in ngram_jaccard._verified(pairs, sets, 75).collect())
    assert ends() == [[0, 6], [1, 7, 9]] and found() == [(0, 1), (6, 7)]
    monkeypatch.setattr(ngram_jaccard, "ENDS_BYTES", 16)
    assert ends() == [[*range(40)]] * 2 and found() == [(0, 1), (6, 7)]
    for several in (2, 10):  # most rows alone, or most rows folded
        member = C.materialize(spark.range(40).selectExpr("id AS row", f"id - IF(id < 20, id % {several}, 0) AS rep" if several == 2 else f"id - id % {several} AS rep"), "member")
        kept = ngram_jaccard.folded(sets, member)
        assert sorted(r.row for r in kept.collect()) == sorted({r.rep for r in member.collect()})
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
