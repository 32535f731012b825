from collections import Counter

import pytest

from conftest import rows
from tidemark.llm import capping

NAN, INF = float("nan"), float("inf")
SCHEMA = "q bigint, a string, id string, score double, race string"


def test_best_are_kept(spark):
    df = spark.createDataFrame([(1, "x", "1", 5.0, ""), (1, "x", "2", None, ""), (1, "x", "3", NAN, ""), (1, "x", "4", -9.0, ""), (1, "x", "5", 5.0, ""), (1, "y", "6", 1.0, ""), (2, "x", "7", 1.0, ""), (1, None, "8", 1.0, ""), (1, None, "9", 2.0, "")], SCHEMA).drop("race")
    kept = rows(capping.reservoir(df, ["q", "a"], "id", "score", 2), "id")
    assert kept == [("1",), ("5",), ("6",), ("7",), ("8",), ("9",)]
    assert rows(capping.left_out(df, ["q", "a"], "id", "score", 2), "id") == [("2",), ("3",), ("4",)]
    assert rows(capping.left_out(df, ["q", "a"], "id", "score", 1), "id") == [("2",), ("3",), ("4",), ("5",), ("8",)]


def test_out_is_the_rest_of_a_hot_contributor(spark):
    df = spark.range(3000).selectExpr("1 AS q", "if(id % 3 = 0, 'hot', concat('c', id % 97)) AS a", "cast(id AS string) AS id", "cast(id % 11 AS double) AS score")
    for t in (0.0, 2.0):
        kept = capping.reservoir(df, ["q", "a"], "id", "score", 5, t, 1)
        out = capping.left_out(df, ["q", "a"], "id", "score", 5, t, 1)
        assert kept.join(out, "id").count() == 0
        assert kept.count() + out.count() == 3000
        assert max(Counter(r.a for r in kept.select("a").collect()).values()) == 5


def test_repeated_rows_and_null_idents_are_kept_or_out(spark):
    df = spark.createDataFrame([("x", "1", 1.0)] * 5 + [("y", None, 1.0)] * 4 + [("y", "2", 1.0), ("z", "3", 2.0), ("z", "4", 1.0), ("z", "4", 1.0), ("z", "4", 1.0), ("z", "5", 0.0)], "a string, id string, score double")
    kept = Counter((r.a, r.id) for r in capping.reservoir(df, ["a"], "id", "score", 3).collect())
    out = Counter((r.a, r.id) for r in capping.left_out(df, ["a"], "id", "score", 3).collect())
    assert out == {("x", "1"): 2, ("y", None): 1, ("y", "2"): 1, ("z", "4"): 1, ("z", "5"): 1}
    assert kept + out == Counter((r.a, r.id) for r in df.collect())


def test_draws_follow_weights(spark):
    df = spark.range(3).selectExpr("1 AS q", "'x' AS a", "cast(id AS string) AS id", "ln(cast(id + 1 AS double)) AS score")
    won = Counter()
    for seed in range(150):
        won[capping.reservoir(df, ["q", "a"], "id", "score", 1, 1.0, seed).first().id] += 1
    assert won["2"] > won["1"] > won["0"] > 0
    assert abs(won["2"] / 150 - 0.5) < 0.15  # weights 1, 2, 3
    again = rows(capping.reservoir(df, ["q", "a"], "id", "score", 2, 1.0, 5).repartition(3), "id")
    assert again == rows(capping.reservoir(df.repartition(7), ["q", "a"], "id", "score", 2, 1.0, 5), "id")


def test_share(spark):
    df = spark.createDataFrame([(1, "x", str(i), float(i % 4)) for i in range(18)] + [(1, "y", "y", 1.0), (2, "x", "z", None)], "q bigint, a string, id string, score double")
    got = rows(capping.cap_by_share(df, ["q"], ["a"], "id", "score", 0.25), "q", "a", "id", "race_rank")
    assert [r[2] for r in got if r[:2] == (1, "x")] == ["10", "11", "15", "3", "7"]
    assert sorted(r[3] for r in got if r[:2] == (1, "x")) == [1, 2, 3, 4, 5]
    assert ("y",) in [r[2:3] for r in got] and ("z",) in [r[2:3] for r in got]


def test_arguments(spark):
    df = spark.createDataFrame([], "q bigint, a string, id string, score double")
    assert capping.left_out(df, ["q", "a"], "id", "score", 1).count() == 0
    assert capping.cap_by_share(df, ["q"], ["a"], "id", "score", 0.5).count() == 0
    with pytest.raises(ValueError):
        capping.reservoir(df, ["q"], "id", "score", 0)
    with pytest.raises(ValueError):
        capping.cap_by_share(df, ["q"], ["a"], "id", "score", 0)


def test_hits(spark):
    hits = spark.createDataFrame([(1, "1", 2.0), (1, "1", None), (1, "1", NAN), (1, "2", None), (1, "3", 1.0), (1, "9", 1.0), (1, None, 1.0)], "query_id bigint, tweet_id string, score double")
    tweets = spark.createDataFrame([("1", ("a",)), ("1", ("a",)), ("2", ("a",)), ("3", ("",)), ("3", None), (None, ("a",))], "id string, author struct<id:string>")
    assert rows(capping.hits_of_authors(hits, tweets)) == [("1", 1, 2.0, "a"), ("2", 1, -INF, "a")]


def test_best_scored_by_drawing(spark):
    """A cold draw with its exact check keeps what sorting keeps, with near and equal scores, ties and nulls."""
    import random

    random.seed(5)
    data = [(random.choice("abc"), f"{i:03d}", random.choice([None, float("nan"), 1.0, 1.0 + 1e-7, 2.0, random.random(), 1e12])) for i in range(300)]
    df = spark.createDataFrame(data, "who string, id string, score double")
    low = lambda s: float("-inf") if s is None or s != s else s
    want = {w: [i for _, i in sorted((-low(s), i) for x, i, s in data if x == w)[:4]] for w in "abc"}
    got = capping.best(df, ["who"], "id", "score", 4).collect()
    assert {w: [r.id for r in sorted(got, key=lambda r: r.race_rank) if r.who == w] for w in "abc"} == want
    out = rows(capping.left_out(df, ["who"], "id", "score", 4, capping.COLD, exact=True), "who", "id")
    assert out == sorted((w, i) for w, i, _ in data if i not in want[w])
