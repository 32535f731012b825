"""Problem 7: filling containers of fixed capacity with items of varying length.

Method: optimal length buckets.  A dynamic programme over the global histogram
of lengths chooses the bucket bounds that minimise padding (the tokens between an
item and its bucket's bound); token-budget batches are then formed from the
buckets: a container takes as many items of the longest bucket with items left
as its budget allows, then of the longest that still fits the rest, and so on.
Containers filled alike are one pattern; there are at most a few for each bucket.

The driver sees the histogram (at most capacity rows) and the patterns, never
items.  An item learns its container from its bucket and its rank in it.

An item longer than the capacity is cut into pieces of the capacity and a rest;
no other item is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import spread_rank
from tidemark.storage import materialize

#: Length buckets for each capacity.
BUCKETS = 128


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """The at most ``buckets`` upper bounds (rising, the last one the greatest length) that minimise total padding.

    cost(i, j) = u_j (N_j - N_i) - (T_j - T_i) for a bucket of the lengths after
    i up to j, with N and T running sums of counts and of tokens: for a fixed
    number of buckets the best i for each j lies on the lower hull of lines with
    slopes -N_i, which is walked once because u rises.
    """
    s = len(lengths)
    if s <= buckets:
        return lengths.copy()
    n = np.concatenate(([0], np.cumsum(counts))).astype(float).tolist()
    t = np.concatenate(([0], np.cumsum(counts * lengths))).astype(float).tolist()
    u = [0.0, *map(float, lengths)]
    best = [0.0] + [u[j] * n[j] - t[j] for j in range(1, s + 1)]
    choice: list[list[int]] = [[0] * (s + 1)]
    for k in range(2, buckets + 1):
        new, via = [float("inf")] * (s + 1), [0] * (s + 1)
        hull: list[tuple[float, float, int]] = []  # slope, height, i
        at = 0
        for j in range(k, s + 1):
            i = j - 1
            slope, height = -n[i], best[i] + t[i]
            while len(hull) >= 2:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (b2 - b1) * (m1 - slope) >= (height - b1) * (m1 - m2):
                    hull.pop()
                else:
                    break
            hull.append((slope, height, i))
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * u[j] + hull[at + 1][1] <= hull[at][0] * u[j] + hull[at][1]:
                at += 1
            new[j] = u[j] * n[j] - t[j] + hull[at][0] * u[j] + hull[at][1]
            via[j] = hull[at][2]
        best = new
        choice.append(via)
    out, j = [], s
    for via in reversed(choice):
        out.append(lengths[j - 1])
        j = via[j]
        if j == 0:
            break
    return np.array(out[::-1], dtype=lengths.dtype)


@dataclass
class Plan:
    """How the buckets of one capacity go into containers."""

    bounds: np.ndarray  # of buckets
    start: np.ndarray  # bucket << 40 | first rank of a run of items, rising
    each: np.ndarray  # items of the run in one container
    container: np.ndarray  # the run's first container
    containers: int

    def place(self, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.start, bucket.astype(np.int64) << 40 | rank, side="right") - 1
        return self.container[run] + (rank - (self.start[run] & ((1 << 40) - 1))) // self.each[run]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS, top_up: bool = True) -> Plan:
    """The plan for a histogram of lengths of at most capacity; without top_up, batches keep inside their bucket."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    bounds = bucket_bounds(lengths, counts, buckets)
    left = np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds)).astype(np.int64)
    used = np.zeros(len(bounds), np.int64)
    runs: list[tuple[int, int, int]] = []
    done, top = 0, len(bounds) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            break
        budget, take = capacity, []
        b = top
        while b >= 0 and budget > 0:
            b = min(b, int(np.searchsorted(bounds, budget, side="right")) - 1)
            while b >= 0 and left[b] == 0:
                b -= 1
            if b < 0:
                break
            k = int(min(budget // bounds[b], left[b]))
            take.append((b, k))
            budget -= k * int(bounds[b])
            b = b - 1 if top_up else -1
        repeat = min(int(left[b]) // k for b, k in take)
        for b, k in take:
            runs.append((b << 40 | int(used[b]), k, done))
            used[b] += k * repeat
            left[b] -= k * repeat
        done += repeat
    runs.sort()
    start, each, first = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
    return Plan(bounds, start, each, first, done)


def pack(sizes: DataFrame, capacities: DataFrame, buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """(size_name, id, piece, tokens, container) for (id, tokens) and (size_name, capacity_tokens).

    A container's rest is filled from shorter buckets unless top_up is false.
    Pieces are numbered from 0; only items longer than the capacity have more
    than one.  Items of 0 tokens take no space: they have one row with piece 0
    and no container.  Null sizes count as 0; capacities that are null or below
    1 are left out, and the first of repeated names counts; containers are
    numbered from 0 for each name.
    """
    spark = sizes.sparkSession
    # a table of a few named capacities; what is collected below has at most their sum of rows
    named: dict[str, int] = {}
    for r in capacities.where("size_name IS NOT NULL AND capacity_tokens >= 1").select("size_name", "capacity_tokens").orderBy("size_name", "capacity_tokens").collect():
        named.setdefault(r.size_name, int(r.capacity_tokens))
    empty = "size_name string, id string, piece int, tokens bigint, container bigint"
    if not named:
        return spark.createDataFrame([], empty)
    names = sorted(named)
    sizes = sizes.select("id", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(named[x]).cast("bigint").alias("cap")) for i, x in enumerate(names)]))
    whole = sizes.select("id", "tokens", every.alias("s")).select("id", "tokens", "s.c", "s.cap")
    last = F.ceil(F.col("tokens") / F.col("cap")) - 1
    items = whole.where("tokens > 0").select("c", "id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.least(F.col("cap"), F.col("tokens") - i * F.col("cap")))).alias("piece", "tokens"))
    items = items.select("c", "id", "piece", F.col("tokens").cast("bigint").alias("tokens"))
    hist = items.groupBy("c", "tokens").agg(F.count("*").alias("n")).toArrow()
    hc, ht, hn = (np.asarray(hist[x]) for x in ("c", "tokens", "n"))
    plans = [plan(ht[hc == i], hn[hc == i], named[x], buckets, top_up) for i, x in enumerate(names)]
    shared = spark.sparkContext.broadcast(plans)

    def bucket(batches):
        for b in batches:
            c, t = np.asarray(b.column(0)), np.asarray(b.column(3))
            out = np.zeros(len(c), np.int32)
            for i, p in enumerate(shared.value):
                own = c == i
                out[own] = np.searchsorted(p.bounds, t[own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "bucket"])

    kind = items.schema["id"].dataType.simpleString()
    placed = items.mapInArrow(bucket, f"c int, id {kind}, piece int, tokens bigint, bucket int")
    placed = spread_rank(placed.withColumn("_key", F.concat_ws("/", F.col("id").cast("string"), "piece")), ["c", "bucket"], "_key")

    def container(batches):
        for b in batches:
            c, k, r = (np.asarray(b.column(i)) for i in (0, 4, 5))
            out = np.zeros(len(c), np.int64)
            for i, p in enumerate(shared.value):
                own = np.flatnonzero(c == i)
                if len(own):
                    out[own] = p.place(k[own], r[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=object)[c], pa.string()), *b.columns[1:4], pa.array(out)], ["size_name", "id", "piece", "tokens", "container"])

    done = placed.select("c", "id", "piece", "tokens", "bucket", "rank").mapInArrow(container, f"size_name string, id {kind}, piece int, tokens bigint, container bigint")
    nothing = whole.where("tokens = 0").select(F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1).alias("size_name"), "id", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("bigint").alias("container"))
    return done.unionByName(nothing)


def fills(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(size_name, container, pieces, tokens, fill) of every container."""
    cap = F.broadcast(capacities.groupBy("size_name").agg(F.min("capacity_tokens").alias("cap")))  # a few named capacities
    per = packed.where("container IS NOT NULL").groupBy("size_name", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return per.join(cap, "size_name").select("size_name", "container", "pieces", "tokens", F.round(F.col("tokens") / F.col("cap"), 6).alias("fill"))


def sized(df: DataFrame, ident: str, text: str, **kwargs) -> DataFrame:
    """(id, tokens), computed once and kept in the shared folder."""
    from tidemark.llm.tokens import token_counts

    return materialize(token_counts(df, ident, text, **kwargs), "tokens")
