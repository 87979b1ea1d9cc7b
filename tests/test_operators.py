"""Duplicates, splits, metrics, crawl steps and streams on small tables, some against plain Python."""

import hashlib
import inspect
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumetra.functions import text
from lumetra.operators import crawl, dedup, linkage, metrics, ml, split
from lumetra.plans import linkage_queries
from lumetra.sources import tables
from lumetra.streaming import jobs


def brute_cosine(rows, least):
    n = len(rows)
    df = {}
    for _, ws in rows:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    vec = {}
    for i, ws in rows:
        v = {w: ws.count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in set(ws) if df[w] >= 2 and df[w] <= 0.9 * n}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec[i] = {w: x / norm for w, x in v.items()}
    return {(i, j) for i in vec for j in vec if i < j and round(sum(x * vec[j].get(w, 0) for w, x in vec[i].items()), 9) >= least}


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 4)) for _ in range(12)] for _ in range(12)]
    rows = []
    for i in range(60):
        ws = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            ws[r.randrange(len(ws))] = "z" + str(r.randint(0, 5))
        rows.append((i, ws))
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id long, text string")
    vectors = dedup.tfidf(dedup.postings(df, F.split("text", " ")), 60)
    pairs = dedup.cosine_pairs(vectors, 0.9)
    want = brute_cosine(rows, 0.9)
    assert {(p.i, p.j) for p in pairs.collect()} == want and want
    earlier = {r.id for r in dedup.any_earlier(pairs).collect()}
    assert earlier == {j for _, j in want}
    kept, removed = set(), set()
    for i in range(60):
        (removed if any((k, i) in want for k in kept) else kept).add(i)
    greedy = {r.id for r in dedup.greedy_leader(pairs).collect()}
    assert greedy == removed and greedy <= earlier


def test_blocks_find_all_alike_vectors_and_write_no_others(spark):
    """All vectors share terms: a join by term wrote a row for each two of them."""
    import numpy as np

    from lumetra.operators import similar

    r = np.random.default_rng(3)
    dense = np.zeros((300, 60))
    for i in range(300):
        dense[i] = dense[r.integers(0, i)] + 0.1 * r.random(60) if i % 3 == 2 else r.random(60) ** 4 * (r.random(60) < 0.5)
        dense[i, 0] = 0.2
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(i, [int(t) for t in np.flatnonzero(v)], [float(x) for x in v[v > 0]]) for i, v in enumerate(dense)] + [(300, [], [])]
    df = spark.createDataFrame(rows, "id long, terms array<int>, ws array<double>")
    cos = np.round(dense @ dense.T, 9)
    for least in (0.9, 0.6):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cos[i, j] >= least}
        assert {(x.i, x.j) for x in similar.pairs(df, least).collect()} == want and want
        assert similar.near(df, least, block=50).count() <= len(want) + 5
        sides = similar.pairs(df.where("id < 200"), least, df.where("id >= 200")).collect()
        assert {(x.i, x.j) for x in sides} == {(i, j) for i, j in want if i < 200 <= j}


def test_greedy_leader_decides_long_chains(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {x.id for x in dedup.greedy_leader(chain).collect()} == set(range(2, 301, 2))
    r = random.Random(11)
    edges = {(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(60)) if a < b} | {(k, k + 1) for k in range(100, 112)}
    removed = set()
    for j in range(120):
        if any(b == j and a not in removed for a, b in edges):
            removed.add(j)
    for at_once in (0, 9, 1000):
        got = dedup.greedy_leader(spark.createDataFrame(sorted(edges), "i long, j long"), at_once=at_once)
        assert {x.id for x in got.collect()} == removed
    assert dedup.greedy_leader(spark.createDataFrame([], "i long, j long")).count() == 0


def test_greedy_query_tells_word_orders_apart(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    other = r.sample(words, len(words))
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words)), (4, " ".join(other))] + [(i, f"other{i % 2} text{i % 3}") for i in range(5, 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.id for x in linkage_queries.near_dup_greedy(spark, str(tmp_path)).collect()}
    assert got & {1, 2, 3, 4} == {3, 4}
    grams = spark.createDataFrame([("A b, c",), ("one",), ("",), (None,)], "t string").select(text.word_grams(F.col("t")).alias("g")).collect()
    assert [x.g for x in grams] == [["a", "b", "c", "a b", "b c"], ["one"], [], []]


def test_models_run_the_surveyed_grids(spark):
    points = lambda kind: sorted(tuple(sorted((p.name, v) for p, v in m.items())) for m in ml.estimator(kind, 100)[1])
    assert points("rf") == sorted((("maxDepth", d), ("numTrees", n)) for d in (20, 30) for n in (100, 200))
    assert points("gbt") == sorted((("maxDepth", d), ("stepSize", s)) for d in (4, 6, 8) for s in (0.05, 0.1))
    assert ml.estimator("gbt", 100)[0].getMaxIter() == 100 and ml.TextFeatures().counts.getVocabSize() == 10_000
    defaults = lambda f, name: inspect.signature(f).parameters[name].default
    assert (defaults(ml.select_model, "folds"), defaults(ml.kmeans, "restarts")) == (5, 10)


def test_keep_first_and_empty_keys(spark):
    df = spark.createDataFrame([(1, ""), (2, ""), (3, "a"), (4, "a"), (5, None)], "id long, link string")
    assert {r.id for r in dedup.keep_first(df, F.col("link"), "id").collect()} == {1, 3, 5}
    assert {r.id for r in dedup.keep_first(df, F.col("link"), "id", keep_empty=True).collect()} == {1, 2, 3, 5}


def test_split_is_disjoint_exhaustive_and_stratified(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = split.stratified_split(rows, "label", "doc_id", [("train", 0.64), ("dev", 0.16), ("test", 0.2)]).collect()
    assert len(got) == 500 and len({r.doc_id for r in got}) == 500
    assert sum(r.split == "train" and r.label == 1 for r in got) == 32


def test_metrics(spark):
    cells = [(1, 1)] * 153 + [(0, 0)] * 25 + [(0, 1)] * 15 + [(1, 0)] * 3
    m = metrics.confusion(spark.createDataFrame(cells, "y int, p int"), F.col("y"), F.col("p")).first()
    assert [round(x, 4) for x in (m.accuracy, m.precision, m.recall, m.f1)] == [0.9082, 0.9107, 0.9808, 0.9444]
    ranks = spark.createDataFrame([(1,), (4,), (None,)], "rank int")
    got = metrics.retrieval(ranks).first()
    assert (got.recall_1, got.recall_5, got.lost) == (0.333333, 0.666667, 0.333333)
    assert got.recall_1 <= got.recall_5 <= got.recall_10 <= got.recall_50


def test_idf(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, text string")
    idf = linkage.idf_model(linkage.postings(df, "id", F.array("text")), 3)
    assert round(idf.where("term = 'a'").first().idf, 4) == 1.6931


def test_numbering_runs_and_shift(spark):
    pages = spark.createDataFrame([(x,) for x in (3, 4, 5, 9, 11, 12)], "page long")
    assert {(r.first_page, r.last_page, r.pages) for r in crawl.contiguous_runs(pages, "page").collect()} == {(3, 5, 3), (9, 9, 1), (11, 12, 2)}
    assert [r.n for r in crawl.numbered(pages, "page", "n").orderBy("page").collect()] == [1, 2, 3, 4, 5, 6]


def test_reranker(spark):
    cache = spark.createDataFrame([(1, "a b", ["a", "a b"]), (2, "x", ["only"]), (3, "x", []), (4, "x", ["p", "q"])], "query_id long, query string, candidates array<string>")
    got = {r.query_id: (r.choice, r.outcome) for r in linkage.rerank(cache, linkage.LexicalReranker()).collect()}
    assert got == {1: (2, "chosen"), 2: (1, "chosen"), 3: (0, "abstain"), 4: (0, "abstain")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('[{"url": "u1"}, {"url": "u2"}]')
    (tmp_path / "in/b.json").write_text('{"url": "u3"}')
    (tmp_path / "in/c.json").write_text("{broken")
    got = tables.read_json_folder(spark, str(tmp_path / "in"), "url string")
    assert {r.url for r in got.collect()} == {"u1", "u2", "u3"}
    df = spark.createDataFrame([("1", 'a "q"\nline'), ("2", " none "), ("3", None)], "id string, descricao string")
    tables.write_csv(df, str(tmp_path / "csv"))
    rows = tables.read_csv_rows(spark, str(tmp_path / "csv"), ["id", "descricao"], "descricao")
    assert [r.id for r in rows.collect()] == ["1"]
    assert tables.write_parquet_checked(df, str(tmp_path / "pq")) == 3
    assert tables.ordered_by_suffix(["a_x", "b", "a_y", "c_x"], ["_y", "_x"]) == ["b", "a_y", "a_x", "c_x"]


def test_stream_dedup(spark, tmp_path):
    (tmp_path / "src").mkdir()
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, key string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "src/t"))
    s = spark.readStream.schema("n int, key string, ts timestamp").parquet(str(tmp_path / "src/t"))
    assert jobs.run_once(jobs.first_of_key(s, "key"), f"file://{tmp_path}/out").count() == 2


def test_trigger_messages(spark):
    m = spark.createDataFrame([('{"url": "https://x", "start_date": "2024-01-02", "parameters": {"portal": "p"}}',), ('{"url": "bucket/prefix"}',)], "value string")
    assert {r.route for r in jobs.route(jobs.parse_triggers(m)).collect()} == {"dated", "folder"}


def test_ranks_by_label_and_running_totals_cross_partitions(spark):
    rows = spark.createDataFrame([(k if k else None, k % 3 if k % 3 else None, k % 7) for k in range(400)], "k long, y long, extra long").repartition(16)
    got = split.stratified_folds(rows, "y", "k", folds=4, seed=3).collect()
    assert rows.columns + ["fold"] == list(got[0].asDict()) and len(got) == 400
    for y in (None, 1, 2):
        own = sorted((r for r in got if r.y == y), key=lambda r: "" if r.k is None else hashlib.md5(f"3:{r.k}".encode()).hexdigest())
        assert [r.fold for r in own] == [i % 4 for i in range(len(own))]
    data = [(i % 2, (i * 37) % 101 / 100) for i in range(500)]
    scored = spark.createDataFrame(data, "y long, s double").repartition(16)
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(scored, "y", "s").first()[0] == pytest.approx(wins, abs=1e-6)
    assert metrics.roc_auc(scored.limit(0), "y", "s").first()[0] is None


# blocks of descriptions


def blocks_of_copies(spark):
    """Two blocks: 40 queries of 2 texts, and 90 rows of 3 texts, ids dealt among the copies."""
    q = spark.createDataFrame([(i, "ab"[i % 2] if i < 38 else None, f"red bolt {i % 2}") for i in range(40)], "query_id long, block string, q string")
    b = spark.createDataFrame([(100 + i, "ab"[i % 2], [f"red bolt {i % 2}", "blue ring", None][i % 3]) for i in range(90)], "doc_id long, block string, b string")
    return q, b


@pytest.mark.parametrize("method", ["jaccard", "levenshtein"])
def test_copies_of_a_text_are_compared_once(spark, method):
    """F6, F11 to F16: each pair of rows of a block was worked out, in as few tasks as the inputs were small."""
    q, b = blocks_of_copies(spark)
    scores = linkage.class_scores(linkage.described(q, "query_id", "q")[0], linkage.described(b, "doc_id", "b")[0], method)
    assert scores.count() == 6  # 1,710 pairs of rows
    of, compare = linkage.METHODS[method]
    plain = q.join(b, "block").select("query_id", "doc_id", F.round(compare(of(F.col("q")), of(F.col("b"))), 6).alias("score"))
    every = sorted(map(tuple, linkage.every_score(q, b, method).collect()), key=str)
    assert every == sorted(map(tuple, plain.collect()), key=str) and len(every) == 38 * 45
    rows = lambda x: sorted(map(tuple, x.select("query_id", "doc_id", "score", "rank").collect()), key=str)
    for k in (1, 20, 44):
        assert rows(linkage.retrieval_top_k(q, b, method, k)) == rows(linkage.top_k(plain, k))


def test_pairs_are_dealt_by_what_they_make(spark):
    left, right = (spark.range(300).select(F.lit("x").alias("block"), F.col("id").alias(n)) for n in "ab")
    made = linkage.dealt_pairs(left, right, "block", 10_000)
    assert made.select(F.countDistinct("a", "b")).first()[0] == 90_000 == made.count()
    assert max(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()) < 60_000


def test_block_tournament_is_the_tournament_of_each_block(spark):
    """every query ranked all rows of its block itself."""
    q, b = blocks_of_copies(spark)
    choice = lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(7))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    plain = linkage.tournament(q.join(b, "block").select("query_id", "doc_id").withColumn("rank", rank).withColumn("choice", choice(F.col("query_id"), F.col("doc_id"))))
    assert sorted(map(tuple, linkage.block_tournament(q, b, choice).collect())) == sorted(map(tuple, plain.collect()))


def test_bm25_lists_only_terms_of_queries(spark, monkeypatch):
    """postings of every term were shuffled and written."""
    seen = []
    monkeypatch.setattr(linkage, "materialised", lambda df: seen.append(df) or df)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(50)) + " bid" * (i % 3)) for i in range(20)] + [(20, ""), (21, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in linkage.bm25(spark.createDataFrame([(1, "Bid bid opened")], "query_id long, text string"), rows).collect()}
    size = {i: 50 + i % 3 for i in range(20)}
    mean, df = sum(size.values()) / 20, sum(i % 3 > 0 for i in range(20))
    idf = math.log((20 - df + 0.5) / (df + 0.5) + 1)
    assert got == {(1, i): pytest.approx(idf * (i % 3) * 2.5 / (i % 3 + 1.5 * (0.25 + 0.75 * size[i] / mean)), abs=2e-6) for i in range(20) if i % 3}
    assert max(df.count() for df in seen) <= 20


@pytest.mark.parametrize("common", [200_000, 5])
def test_linkage_shuffles_no_postings(spark, monkeypatch, common):
    """all postings were shuffled by document and by term, several times."""
    monkeypatch.setattr(linkage, "COMMON_TERMS", common)
    r = random.Random(5)
    docs = [(i // 2, "ab"[i // 2 % 2], " ".join(r.choice("one two three four five six seven eight nine ten".split()) for _ in range(12))) for i in range(60)] + [(40, "a", ""), (41, "b", None)]
    asked = [(i, "ab"[i % 2], f"one {'two' * (i % 3)} seven new") for i in range(6)]
    rows, q = spark.createDataFrame(docs, "doc_id long, block string, text string"), spark.createDataFrame(asked, "query_id long, block string, text string")
    assert "Exchange" not in linkage.term_rows(rows.dropDuplicates(["doc_id"]).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    words = {}
    for i, _, t in docs:
        words.setdefault(i, []).extend((t or "").split())
    idf = lambda w: math.log((len(docs) + 1) / (sum(w in x for x in words.values()) + 1)) + 1 if any(w in x for x in words.values()) else 1.0

    def vector(ws):
        raw = {w: ws.count(w) / max(ws.count(x) for x in ws) * idf(w) for w in ws}
        return {w: x / math.sqrt(sum(y * y for y in raw.values())) for w, x in raw.items()}

    got = linkage.tfidf_top_k(q, rows, 4).collect()
    want = {}
    for i, _, t in asked:
        own = vector(t.split())
        scores = sorted((-round(sum(x * vector(ws).get(w, 0) for w, x in own.items()), 6) if ws else 0.0, d) for d, ws in words.items())
        want |= {(i, n): (d, -s) for n, (s, d) in enumerate(scores[:4], 1)}
    assert {(x.query_id, x["rank"]): x.doc_id for x in got} == {k: v[0] for k, v in want.items()}
    assert all(x.score == pytest.approx(want[x.query_id, x["rank"]][1], abs=2e-6) for x in got)
    blocked = linkage.tfidf_top_k(q, rows.dropDuplicates(["doc_id"]), 40, ["block"]).collect()
    assert len(blocked) == 6 * 16 and all(x.doc_id % 2 == x.query_id % 2 for x in blocked)


@pytest.mark.parametrize("method", ["jaccard", "dice", "overlap"])
def test_best_by_sets_gives_the_scores_of_all_pairs(spark, method):
    r = random.Random(3)
    words = lambda: " ".join(r.choice("abcdefghijklmnopqrst") * 2 for _ in range(r.randint(0, 9)))
    q = spark.createDataFrame([(i, f"b{i % 3}", words()) for i in range(40)], "query_id long, block string, q string")
    b = spark.createDataFrame([(i, f"b{i % 3}", words()) for i in range(200)], "doc_id long, block string, b string")
    asked, texts = linkage.described(q, "query_id", "q")[0], linkage.described(b, "doc_id", "b")[0]
    rows = lambda df: sorted(map(tuple, df.select("block", "query_lead", "lead", "score").collect()))
    want = rows(linkage.top_k(linkage.class_scores(asked, texts, method), 10, "query_lead", "lead"))
    assert rows(linkage.best_by_sets(asked, texts, method, 10)) == want
    assert rows(linkage.best_by_sets(asked, texts, method, 10, at_once=7, rows=31)) == want


def test_gold_documents_are_found_without_shuffling_texts(spark, tmp_path):
    passages = ["a b c d e f", "x", "x y", "b c", "p q r", "zz b c d yy", "no such run is there", ""]
    texts = ["1 a b c d e f 2", "a b c d e fog", "xx yy", "x y", "wp q rs", "zzz b c d yyy", "zz b c d", None, "", "a b c d e f"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gold = linkage_queries._gold(spark, str(tmp_path))
        assert {tuple(r) for r in gold.collect()} == {(i, j) for i, p in enumerate(passages) for j, t in enumerate(texts) if t is not None and p in t}
        assert "SortMergeJoin" not in gold._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_json_records_are_written_by_all_cores(spark, tmp_path):
    """A table of one row group was written by one task, a file after another."""
    rows = [(i, f"https://h/{i % 7}", f"t{i % 7}") for i in range(40)]
    tables.write_json_records(spark.createDataFrame(rows, "page_id long, url string, tail string").coalesce(1), str(tmp_path), "tail", "page_id")
    back = tables.read_json_records(spark, str(tmp_path), "page_id long, url string, tail string").collect()
    assert sorted((r.page_id, r.url, r.tail) for r in back) == rows and len({r.file for r in back}) == 40
    assert len({r.file.rsplit("/part-", 1)[1][:5] for r in back}) == spark.sparkContext.defaultParallelism


def test_names_are_found_without_carrying_texts(spark):
    """Every word of a document carried its text to a join with all names of that first word."""
    import re

    from lumetra.operators import gazetteer

    names = ["ana lima", "ana", "são joão", "x-ray", "ana  lima", "o'neil da silva", "(ana)", "lima da", "...", "a_1 b"]
    texts = ["Ana Lima", "Mariana Lima", "ana  lima", "Ana, Lima", "SÃO JOÃO; x-ray!", "x-rays", "O'Neil da Silva", "o'neil da silvas", "(Ana) lima da", None, "", "a_1 b", "ba_1 b", " ana lima da\n"]
    got = gazetteer.whole_word_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = {(i, n) for i, t in enumerate(texts) if t for n in names if n != "..." and re.search(rf"(^|\W){re.escape(n)}($|\W)", t.lower())}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    two = gazetteer.whole_word_matches(spark.createDataFrame([(1, "Ana Lima")], "doc_id long, text string"), spark.createDataFrame([("ana lima",)], "name string"))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan[: plan.index("Generate")] and {tuple(r) for r in two.collect()} == {(1, "ana lima")}


def test_one_task_solves_small_problems_by_the_same_steps(spark, monkeypatch):
    from lumetra.operators import svm

    r = random.Random(12)
    rows = [(sorted(r.sample(range(20), 5)), [r.random() for _ in range(5)], int(i % 3 == 0), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, label int, weight double")
    jobs, sums = [], svm._sums
    monkeypatch.setattr(svm, "_sums", lambda *a: jobs.append(1) or sums(*a))
    one = svm.fit(df, 20)
    assert not jobs and one.newton_steps > 1
    monkeypatch.setattr(svm, "ONE_TASK", 10)
    many = svm.fit(df, 20)
    assert jobs and abs(one.loss - many.loss) < 1e-9 and max(abs(one.weights - many.weights)) < 1e-6 and abs(one.intercept - many.intercept) < 1e-6
    none = svm.fit(df.limit(0), 20)
    assert not none.weights.any() and none.intercept == 0
