import math

import pytest

from conftest import rows
from tidemark.llm import mixing

T = "source string, target_share double, max_repeats int"


def sizes(spark, **sources):
    out = [(f"{s}{i:05d}", s, n) for s, ns in sources.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(out, "id string, source string, tokens bigint")


def test_shares(spark):
    df = sizes(spark, a=[5 + i % 90 for i in range(900)], b=[3 + i % 40 for i in range(100)], c=[20] * 400, other=[9] * 50)
    t = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.3, 4), ("c", 0.19, 2), ("gone", 0.01, 2)], T)
    mixed, wanted = mixing.mix(df, t)
    got = {r.source: r for r in mixing.shares(mixed, t).collect()}
    assert got["gone"].tokens == 0 and got["gone"].share == 0.0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.19)):
        assert got[s].share == pytest.approx(share / 0.99, abs=0.002)
    copies = {r.id: r.copies for r in mixed.collect()}
    assert max(v for k, v in copies.items() if k[0] == "b") == 4 and max(v for k, v in copies.items() if k[0] == "a") == 1
    assert not any(k.startswith("other") for k in copies)
    assert got["b"].copies == 400  # the binding source is repeated as often as allowed


def test_solution_is_exponential_and_meets_its_constraint(spark):
    df = sizes(spark, a=[1 + i % 50 for i in range(500)], b=[10] * 10)
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], T)
    _, w = mixing.mix(df, t, total=12_000)
    a = w["a"]
    rate = lambda n: min(3.0, math.exp(a.tilt * n / a.mean))
    assert sum(rate(1 + i % 50) * (1 + i % 50) for i in range(500)) == pytest.approx(a.want, rel=1e-6)
    assert a.want == 6000 and w["b"].want == 100 and math.isinf(w["b"].tilt)


def test_small_total(spark):
    df = sizes(spark, a=[10] * 1000, b=[7] * 1000)
    t = spark.createDataFrame([("a", 0.4, 5), ("b", 0.6, 5)], T)
    mixed, _ = mixing.mix(df, t, total=1000)
    per = {r.source: r.tokens for r in mixing.shares(mixed, t).collect()}
    assert abs(per["a"] - 400) <= 10 and abs(per["b"] - 600) <= 7
    assert rows(mixed) == rows(mixing.mix(df.repartition(7), t, total=1000)[0])


def test_dirty(spark):
    df = spark.createDataFrame([("1", " A", 5), ("2", None, 5), ("3", "a", 0), ("4", "a", None), ("5", "", 5)], "id string, source string, tokens bigint")
    t = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1), ("z", None, 1), ("a", 2.0, 9)], T)
    assert rows(mixing.mix(df, t)[0]) == [("1", "a", 5, 1)]
    assert mixing.mix(df.limit(0), t)[0].count() == 0
    assert mixing.mix(df, t.limit(0))[0].count() == 0
    assert mixing.shares(mixing.mix(df.limit(0), t)[0], t).where("share > 0").count() == 0
