import math
from datetime import UTC, datetime

import pytest
from helpers import frame, photo, post
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import bm25, dense, entities, graph, posts, ranking, search

NOW = datetime(2026, 1, 1, tzinfo=UTC)
QUERIES = "query_id bigint, query_text string, year_filter int, month_start string, month_end string"


def model(docs, query, k1=1.5, b=0.75, eps=0.25):
    """Okapi scores, in plain Python."""
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    avg = sum(raw.values()) / len(raw)
    idf = {t: eps * avg if v < 0 else v for t, v in raw.items()}
    return {i: sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in query if t in d) for i, d in docs.items()}


def test_bm25_equals_model(spark):
    texts = {"1": "the cat sat", "2": "the dog sat on the cat", "3": "a bird", "4": "the the the", "5": "", "6": "cat cat dog"}
    df = frame(spark, *[post(i, t) for i, t in texts.items()])
    index = bm25.build(df)
    for parts in (1, 7):
        q = spark.createDataFrame([(1, "cat cat dog?", None, None, None), (2, "!!", None, None, None)], QUERIES).repartition(parts)
        got = {r.id: r.score for r in bm25.search(index, q).collect()}
        want = model({i: t.split() for i, t in texts.items()}, ["cat", "cat", "dog"])
        assert got == {i: pytest.approx(s, abs=1e-9) for i, s in want.items() if {"cat", "dog"} & set(texts[i].split())}


def test_bm25_empty(spark):
    index = bm25.build(frame(spark))
    assert bm25.search(index, spark.createDataFrame([(1, "x", None, None, None)], QUERIES)).count() == 0


def test_best_in_cells_equals_all_scores(spark, monkeypatch):
    """Queries and texts that meet in cells rank as all their pairs do, with ties at the cut, and have no row for each pair."""
    import random

    random.seed(3)
    words = ["a", "b", "c", "d", "e", "ö", "й"]
    df = frame(spark, *[post(str(i), " ".join(random.choices(words, k=random.randrange(4))), created=random.choice(["bad", "Sun Nov 09 11:05:17 +0000 2025", "Sat Mar 01 00:00:00 +0000 2025"])) for i in range(120)])
    q = spark.createDataFrame([(i, " ".join(random.choices([*words, "none"], k=random.randrange(4))), *random.choice([(None, None, None), (2025, "03", None), (2025, "01", "12"), (2025, "05", "04")])) for i in range(40)], QUERIES)
    index = bm25.build(df)
    terms = bm25.query_terms(q).join(search.spans(q), "query_id")
    want = {top: rows(bm25.ranked(bm25.scores(index, terms), top)) for top in (3, 500)}
    for block, part in ((8, 50), (1000, 1000)):
        for name, value in (("FEW", 0), ("BLOCK", block), ("PART", part)):
            monkeypatch.setattr(bm25, name, value)
        for top in (3, 500):
            found = search.lexical(index, q, top)
            assert rows(found) == want[top] and len(want[top]) > 50
            assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_filters(spark):
    df = frame(spark, post("1", "cat"), post("2", "cat", created="bad"), post("3", "cat", created="Sat Mar 01 00:00:00 +0000 2025"))
    q = spark.createDataFrame([(1, "cat", None, None, None), (2, "cat", 2025, None, None), (3, "cat", 2025, "03", None), (4, "cat", 2025, "05", "04"), (5, "cat", None, "03", None)], QUERIES)
    got = rows(search.lexical(bm25.build(df), q), "query_id", "id")
    assert got == [(1, "1"), (1, "2"), (1, "3"), (2, "1"), (2, "3"), (3, "3")]


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 2.0]), ("d", [2.0, 0.0])], "id string, v array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, v array<double>")
    for block in (100, 1):  # sent to the tasks, and as blocks that meet the rows' parts
        check_dense(spark, q, v, block)


def check_dense(spark, q, v, block):
    got = rows(dense.top_k(q, v.repartition(3), 2, block), "query_id", "rnk", "id", "score")
    assert [(a, b, c, round(d, 6)) for a, b, c, d in got] == [(1, 1, "a", 1.0), (1, 2, "d", 1.0), (2, 1, "c", 1.0), (2, 2, "b", 0.8)]
    scoped = spark.createDataFrame([(1, [2.0, 0.0], 1, 1), (2, [0.0, 1.0], None, None), (3, [1.0, 0.0], 1, 0)], "query_id bigint, v array<double>, first int, last int")
    dated = v.selectExpr("id", "v", "CASE id WHEN 'b' THEN 1 WHEN 'c' THEN NULL ELSE 2 END AS month")
    assert rows(dense.top_k(scoped, dated, 2, block), "query_id", "id") == [(1, "b"), (2, "b"), (2, "c")]
    assert rows(dense.top_k(scoped.where("query_id = 3"), dated, 2, block)) == []
    assert dense.top_k(q.limit(0), v).count() == 0


def test_dense_cells_rank_as_all_pairs_do(spark, monkeypatch):
    """More than FEW queries send on k rows of each from few cells, not from every task; ties at the cut go to the smaller id."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, (300, 3)) + np.array([0.0, 0.0, 0.5])
    month = [None if i % 7 == 0 else i % 5 for i in range(300)]
    q = rng.integers(-1, 2, (90, 3)) + np.array([0.5, 0.0, 0.0])
    span = [(None, None) if i % 3 else (1, 2 if i % 2 else 0) for i in range(90)]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(v).T, 9)
    want = []
    for i, (a, b) in enumerate(span):
        inside = [j for j in range(300) if a is None or month[j] is not None and a <= month[j] <= b]
        want += [(i, n, str(j)) for n, j in enumerate(sorted(inside, key=lambda j: (-sims[i, j], str(j)))[:20], 1)]
    given = spark.createDataFrame([(str(j), x.tolist(), m) for j, (x, m) in enumerate(zip(v, month, strict=True))], "id string, v array<double>, month int").repartition(40)
    asked = spark.createDataFrame([(i, x.tolist(), *s) for i, (x, s) in enumerate(zip(q, span, strict=True))], "query_id bigint, v array<double>, first int, last int")
    for block, step, some in ((1000, 512, 8192), (30, 16, 50)):
        monkeypatch.setattr(dense, "STEP", step)
        monkeypatch.setattr(dense, "ROWS", some)
        found = dense.top_k(asked, given, 20, block)
        assert rows(found, "query_id", "rnk", "id") == sorted(want, key=repr)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_usable_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [nan, 0.0]), ("b", 1, [0.0, 0.0]), ("c", 1, None), ("d", 1, [1.0]), ("e", 1, [1.0, 2.0]), (None, 1, [1.0, 2.0])], "id string, n bigint, v array<float>")
    assert rows(dense.usable(df, "id", "v", 2, "n"), "id") == [("e",)]


def test_embed_batches(spark):
    def call(texts):
        return [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([("1", "ab"), ("2", None), ("3", " ")], "id string, text string").coalesce(1)
    got = {r.id: list(r.v) for r in dense.embed(df, "id", "text", call, batch=2).collect()}
    assert got["1"] == pytest.approx([2 / 8**0.5, 2 / 8**0.5])
    assert got["3"] == pytest.approx([1 / 2**0.5, 1 / 2**0.5])


def test_fuse(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id bigint, id string, rnk int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id bigint, id string, rnk int")
    got = [(r.id, r.fused) for r in ranking.fuse([a, b]).orderBy("rnk").collect()]
    assert got == [("y", pytest.approx(2 / 62)), ("x", pytest.approx(1 / 61)), ("z", pytest.approx(1 / 61))]
    with pytest.raises(ValueError):
        ranking.fuse([a], k=0)


def test_fused_lists_keep_a_score(spark):
    a = spark.createDataFrame([(1, "x", 1, 0.5), (1, "y", 2, 0.25)], "query_id bigint, id string, rnk int, cos double")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id bigint, id string, rnk int")
    assert rows(ranking.fuse([a, b], keep="cos"), "id", "rnk", "cos") == [("x", 2, 0.5), ("y", 1, 0.25), ("z", 3, None)]


def test_ranking_moves_no_words_by_query(spark):
    """Arrays of posts' words and maps of features are in no exchange by query: they would be moved once for each hit."""
    df = frame(spark, post("1", "cat"), post("2", "dog"))
    words = spark.createDataFrame([(1, "cat", 1)], "query_id bigint, term string, qtf int")
    terms = spark.createDataFrame([("cat", 2.0)], "term string, idf double")
    ranked = ranking.rank(hits(spark, (1, "1", 0.5), (1, "2", 0.5)), df, posts.author_affinity(df), F.lit(NOW), words, terms, bm25.build(df).words, top=5)
    assert [(r.id, r.feature_breakdown["coverage"]) for r in ranked.orderBy("rnk").collect()] == [("1", 0.0), ("2", -10.0)]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("map(relevance") < plan.index("Window")  # above the window, so behind its exchange


def hits(spark, *h):
    return spark.createDataFrame(list(h), "query_id bigint, id string, relevance double")


def test_rank_features(spark):
    df = frame(spark, post("1", "cat", fav=9, verified=True, media=[photo()]), post("2", "dog", created="bad"), post("3", "cat dog", handle=""))
    terms = spark.createDataFrame([("cat", 2.0), ("dog", -1.0)], "term string, idf double")
    words = spark.createDataFrame([(1, "cat", 2), (1, "dog", 1), (1, "new", 1)], "query_id bigint, term string, qtf int")
    got = {r.id: r for r in ranking.rank(hits(spark, (1, "1", 0.5), (1, "2", 0.5), (1, "3", 0.0), (1, "9", 1.0)), df, posts.author_affinity(df), F.lit(NOW), words, terms).collect()}
    assert set(got) == {"1", "2", "3"}
    one = got["1"].feature_breakdown
    assert one["favorite"] == pytest.approx(math.log(10) * 0.5, abs=1e-6)
    assert one["affinity"] == pytest.approx(math.log(3), abs=1e-6)
    assert (one["verified"], one["media"], one["coverage"]) == (0.5, 0.3, -5.0)  # dog's negative idf adds nothing, new counts 1
    assert got["2"].feature_breakdown["recency"] == 0.0
    assert got["2"].feature_breakdown["coverage"] == -15.0
    assert got["3"].feature_breakdown["affinity"] == 0.0
    for r in got.values():
        assert r.score == pytest.approx(sum(r.feature_breakdown.values()), abs=1e-5)


def test_rank_ties(spark):
    df = frame(spark, post("2", "a"), post("10", "a"))
    got = [r.id for r in ranking.rank(hits(spark, (1, "2", 0.0), (1, "10", 0.0)), df, posts.author_affinity(df), F.lit(NOW)).orderBy("rnk").collect()]
    assert got == ["10", "2"]


def test_search_without_vectors(spark):
    df = frame(spark, post("1", "cat"), post("2", "dog"))
    q = spark.createDataFrame([(1, "cat", None, None, None)], QUERIES)
    got = search.search(q, df, bm25.build(df), posts.author_affinity(df), NOW)
    assert [r.id for r in got.collect()] == ["1"]
    shown = search.shaped(got, df).first()
    assert (shown.tweet_id, shown.year_month, shown.snippet, shown.tweet_url) == ("1", "2025-11", "cat", "https://x.com/ann/status/1")


def test_shaped_fallbacks(spark):
    h = spark.createDataFrame([(1, "7", 1.0, 1.5, {"x": 1.0}, 1), (1, "8", 1.0, -1.0, {"x": 1.0}, 2)], "query_id bigint, id string, score double, walker_relevance double, feature_breakdown map<string,double>, rnk int")
    tree = spark.createDataFrame([("7", "2024-01", "bob", "body")], "tweet_id string, year_month string, handle string, text string")
    got = {r.tweet_id: r for r in search.shaped(h, frame(spark), tree).collect()}
    assert (got["7"].year_month, got["7"].handle, got["7"].snippet, got["7"].walker_relevance) == ("2024-01", "bob", "body", 1.0)
    assert (got["8"].year_month, got["8"].handle, got["8"].walker_relevance) == ("unknown", "", 0.0)


def test_entities(spark):
    df = frame(spark, post("1", "Hi @Bob_1 #AI https://www.A.example:8/x Quick AI Pentesting"), post("2", "The Big Cat " + "x " * 40), post("3", None))
    got = rows(entities.extract(df), "id", "kind", "value", "weight")
    assert ("1", "handle", "bob_1", 1.0) in got
    assert ("1", "hashtag", "ai", 1.0) in got
    assert ("1", "domain", "a.example:8", 1.0) in got
    long = rows(entities.extract(frame(spark, post("1", "Big Cat and Big Cat. Small Dog. " + "x " * 40))), "value", "weight")
    assert long == [("big", 2.0), ("big_cat", 2.0), ("cat", 2.0)]
    assert [r for r in got if r[0] in ("2", "3")] == []
    short = rows(entities.extract(frame(spark, post("1", "Quick AI Pentesting and The"))), "value")
    assert short == [("ai",), ("ai_pentesting",), ("pentesting",), ("quick",), ("quick_ai",), ("quick_ai_pentesting",)]


def test_graph(spark):
    df = frame(spark, post("1", "@ann #x #X", handle="Ann"), post("2", "#x", handle="bob"))
    q = spark.createDataFrame([(1, "q", None, None, None)], QUERIES)
    h = spark.createDataFrame([(1, "1", 1), (1, "2", 2)], "query_id bigint, id string, rnk int")
    g = graph.build(q, h, df)
    nodes = {r.id: (r.kind, r.label, r.weight) for r in g.nodes.collect()}
    assert nodes["handle:ann"] == ("handle", "Ann", 2.0)
    assert nodes["hashtag:x"] == ("hashtag", "x", 3.0)
    assert nodes["query:root"] == ("query", "q", 1.0)
    edges = rows(g.edges, "src", "dst", "kind")
    assert ("tweet:1", "handle:ann", "authored_by") in edges and ("tweet:1", "handle:ann", "mentions") in edges
    assert len(edges) == len(set(edges)) == 7
    assert rows(graph.neighbors(g, "tweet:2"), "id") == [("handle:bob",), ("hashtag:x",)]
    assert rows(graph.neighbors(g, "hashtag:x", reverse=True), "id") == [("tweet:1",), ("tweet:2",)]
    assert [(r.id, r.boosted) for r in graph.seeds(g.nodes, 2).orderBy("place").collect()] == [("hashtag:x", pytest.approx(2.1)), ("handle:ann", 2.0)]
    some = graph.kept(g, spark.createDataFrame([(1, "tweet:1"), (1, "hashtag:x")], "query_id bigint, id string"))
    assert rows(some.edges, "src", "dst") == [("tweet:1", "hashtag:x")]
    assert '"nodes":[{"id":"handle:ann"' in graph.as_json(g).first().graph


def test_components(spark):
    import random

    random.seed(4)
    pairs = [(f"{a:03d}", f"{b:03d}") for a, b in ((random.randrange(300), random.randrange(300)) for _ in range(200))] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)]
    df = spark.createDataFrame([*pairs, ("x", "x"), (None, "y")], "a string, b string")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((x, find(x)) for x in {z for p in pairs if p[0] != p[1] for z in p})
    assert rows(graph.connected_components(df, "a", "b")) == want


def test_second_round(spark):
    df = frame(spark, post("1", "cat #dog"), post("2", "dog"), post("3", "bird"))
    q = spark.createDataFrame([(1, "cat", None, None, None)], QUERIES)
    index = bm25.build(df)
    first = search.lexical(index, q).select("query_id", "id", "rnk")
    both = search.second_round(first, q, graph.build(q, first, df).nodes, lambda x: search.lexical(index, x))
    got = {r.id: r["round"] for r in both.collect()}
    assert got["1"] == 1 and got["2"] == 2 and "3" not in got


def test_second_round_searches_a_kept_table_of_seeds(spark):
    df = frame(spark, post("1", "cat #dog"), post("2", "dog"))
    q = spark.createDataFrame([(1, "cat", None, None, None)], QUERIES)
    index, asked = bm25.build(df), []
    first = search.lexical(index, q).select("query_id", "id", "rnk")
    search.second_round(first, q, graph.build(q, first, df).nodes, lambda x: asked.append(x) or search.lexical(index, x))
    assert len(asked[0].inputFiles()) and "Window" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_kept_index_finds_the_same(spark, tmp_path):
    df = frame(spark, post("1", "cat dog"), post("2", "cat"), post("3", "bird"))
    q = spark.createDataFrame([(1, "cat dog", None, None, None), (2, "bird", 2025, "11", None)], QUERIES)
    index = bm25.build(df)
    want = rows(search.lexical(index, q))
    bm25.save(index, str(tmp_path / "index"))
    assert len(want) == 3 and rows(search.lexical(bm25.load(spark, str(tmp_path / "index")), q)) == want


def test_pieces_number_a_group_as_one(spark):
    from tidemark.operators import ordering

    data = [(k, i) for k in ("a", "b", None) for i in range(500 if k == "a" else 3)]
    df = spark.createDataFrame(data, "k string, n int").repartition(5)
    got = rows(ordering.numbered(df, ["k"], ["n"]))
    assert got == sorted(((k, n, n + 1) for k, n in data), key=repr)
    assert rows(ordering.numbered(df, ["k"], ["n"], "total", F.col("n"))) == sorted(((k, n, n * (n + 1) // 2) for k, n in data), key=repr)
    assert rows(ordering.word_budget(spark.createDataFrame([("q", 1, "a b"), ("q", 2, " c "), ("q", 3, "d e f"), ("q", 4, "g")], "q string, r int, t string"), ["q"], ["r"], "t", 5), "r", "words") == [(1, 2), (2, 3)]
