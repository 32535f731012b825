"""The best rows of many queries: a block of queries meets a part of the rows in a cell, which sends on k rows of each query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("score", pa.float64())])


def grid(df: DataFrame, queries: int, block: int, size: int, part: int) -> tuple[int, int]:
    """Blocks of queries and parts of rows, so that a cell has about ``block`` queries and at most about ``part`` of ``size``.

    What is shuffled is each row once for a block and k rows of each query once
    for a part; so there are more parts only to keep all cores busy.
    """
    blocks = max(1, -(-queries // block))
    spread = min(-(-df.sparkSession.sparkContext.defaultParallelism // blocks), -(-32 * size // part))
    return blocks, max(1, spread, -(-size // part))


def meet(queries: DataFrame, rows: DataFrame, blocks: int, parts: int, found: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """(query_id, id, score) that ``found`` has in each cell, of queries (query_id, ...) and rows (id, ...)."""
    left = queries.withColumn("_g", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(_, q: pa.Table, x: pa.Table) -> pa.Table:
        return found(q, x) if q.num_rows and x.num_rows else HITS.empty_table()

    return left.groupBy("_g", "_p").cogroup(right.groupBy("_g", "_p")).applyInArrow(cell, "query_id bigint, id string, score double")


def hits(ids: pa.Array, queries: np.ndarray, at: np.ndarray, scores: np.ndarray) -> pa.Table:
    """A table of HITS; at: positions in ids."""
    return pa.table([pa.array(queries, pa.int64()), ids.take(pa.array(at)).cast(pa.string()), pa.array(scores, pa.float64())], schema=HITS)


def largest(at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k positions (in rising order) of largest score, and their scores; of equal scores the smaller positions."""
    if len(at) <= k:
        return at, scores
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    kept = scores > edge
    kept[np.flatnonzero(scores == edge)[: k - np.count_nonzero(kept)]] = True
    return at[kept], scores[kept]
