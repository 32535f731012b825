import os
from collections import defaultdict

import numpy as np
import pytest

from conftest import rows
from tidemark.llm import packing, tokens


def best_padding(lengths, counts, buckets):
    """Least padding by trying every split."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, k):
        if i == len(lengths):
            return 0
        if k == 0:
            return float("inf")
        return min(sum(counts[m] * (lengths[j] - lengths[m]) for m in range(i, j + 1)) + go(j + 1, k - 1) for j in range(i, len(lengths)))

    return go(0, buckets)


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 40])
def test_bounds_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 200), 12, replace=False))
        counts = rng.integers(1, 50, 12)
        b = packing.bucket_bounds(lengths, counts, buckets)
        assert len(b) <= buckets and b[-1] == lengths[-1]
        padding = sum(n * (b[np.searchsorted(b, x)] - x) for x, n in zip(lengths, counts, strict=True))
        assert padding == best_padding(tuple(lengths.tolist()), tuple(counts.tolist()), buckets)


def check(packed, sizes, capacity):
    load, of, pieces = defaultdict(int), defaultdict(list), defaultdict(int)
    for _, i, piece, n, c in packed:
        if c is not None:
            load[c] += n
            of[i].append((piece, n))
        pieces[i] += n
    assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
    assert dict(pieces) == sizes
    for i, p in of.items():
        p.sort()
        assert [k for k, _ in p] == list(range(len(p)))
        assert len(p) == max(1, -(-sizes[i] // capacity))
        assert all(n == capacity for _, n in p[:-1])
    return sum(load.values()) / (len(load) * capacity)


@pytest.mark.parametrize("buckets", [4, 128])
def test_pack(spark, buckets):
    rng = np.random.default_rng(1)
    sizes = {f"{i:04d}": int(n) for i, n in enumerate(np.concatenate((rng.lognormal(3.5, 1.0, 900), np.full(500, 33), [0, 1, 100, 101, 950])))}
    df = spark.createDataFrame(list(sizes.items()), "id string, tokens bigint")
    caps = spark.createDataFrame([("s", 100), ("l", 1000), (None, 5), ("bad", 0), ("l", 2000)], "size_name string, capacity_tokens int")
    packed = packing.pack(df.repartition(5), caps, buckets)
    got = defaultdict(list)
    for r in packed.collect():
        got[r.size_name].append(tuple(r))
    assert set(got) == {"s", "l"}
    assert check(got["s"], sizes, 100) > (0.9 if buckets > 4 else 0.5)
    assert check(got["l"], sizes, 1000) > (0.95 if buckets > 4 else 0.6)
    fill = packing.fills(packed, caps).where("size_name = 's'").collect()
    assert len(fill) == len({r[4] for r in got["s"] if r[4] is not None}) and max(r.fill for r in fill) <= 1.0


def test_edges(spark):
    caps = spark.createDataFrame([("s", 10)], "size_name string, capacity_tokens int")
    empty = spark.createDataFrame([], "id string, tokens bigint")
    assert packing.pack(empty, caps).count() == 0
    assert packing.pack(empty, caps.limit(0)).count() == 0
    df = spark.createDataFrame([("a", None, 1), ("b", 0, 1), ("c", 10, 1), ("d", 25, 1)], "id string, tokens bigint, bucket int")
    assert rows(packing.pack(df, caps), "id", "piece", "tokens") == [("a", 0, 0), ("b", 0, 0), ("c", 0, 10), ("d", 0, 10), ("d", 1, 10), ("d", 2, 5)]


def test_equal_items_fill_whole_containers(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS id", "25L AS tokens")
    caps = spark.createDataFrame([("s", 100)], "size_name string, capacity_tokens int")
    assert packing.pack(df, caps).select("container").distinct().count() == 250


def test_spread_rank(spark):
    df = spark.range(2000).selectExpr("cast(id AS string) AS id", "if(id % 3 = 0, 'hot', cast(id % 50 AS string)) AS k", "1 AS rank0")
    got = defaultdict(list)
    for r in tokens.spread_rank(df.repartition(6), ["k"], "id").collect():
        got[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="needs the vocabulary")
def test_token_counts(spark):
    df = spark.createDataFrame([("1", "hello world"), ("2", ""), ("3", None), ("4", "<|endoftext|> é" * 1000)], "id string, text string")
    got = {r.id: r.tokens for r in tokens.token_counts(df, "id", "text").collect()}
    enc = tokens._encoding(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN)
    assert got == {"1": len(enc.encode_ordinary("hello world")), "2": 0, "3": 0, "4": len(enc.encode_ordinary("<|endoftext|> é" * 1000))}
    assert enc.decode(enc.encode_ordinary("Ünï — 12")) == "Ünï — 12"
