"""Dense search: cosine of query vectors with all rows, for many queries in one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cells
from tidemark.operators.bm25 import TOP, ranked

#: Query vectors up to which they are sent to all tasks; query vectors of a block, and rows of a part, that meet in a cell beyond that.
FEW, BLOCK, PART = 64, 8192, 131_072
#: Query vectors and rows that are multiplied at once.
STEP, ROWS = 512, 8192


def usable(rows: DataFrame, ident: str, vector: str, dims: int, newest: str) -> DataFrame:
    """(id, v): of each id the row with the largest ``newest``, if its vector has dims finite numbers, not all zero."""
    best = rows.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(F.max_by(vector, newest).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return best.where((F.size("v") == dims) & finite & F.exists("v", lambda x: x != 0))


def _matrix(arr: pa.Array) -> np.ndarray:
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    return np.asarray(arr.flatten(), np.float64).reshape(len(arr), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query: by score, ties by smaller id."""
    order = table.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])
    first = np.asarray(order["query_id"])
    return order.filter(pa.array(np.arange(len(first)) - np.searchsorted(first, first) < k))


def _numbers(arr, empty: int) -> np.ndarray:
    return np.asarray(pc.fill_null(arr, empty)).astype(np.int64)


class _Block:
    """Unit vectors of some queries, with their spans of months."""

    def __init__(self, table: pa.Table):
        self.ids = np.asarray(table["query_id"]).astype(np.int64)
        self.unit = _unit(_matrix(table["v"].combine_chunks()))
        self.open = np.asarray(pc.is_null(table["first"])) if "first" in table.column_names else np.ones(len(self.ids), bool)
        self.first = _numbers(table["first"], 0) if "first" in table.column_names else None
        self.last = _numbers(table["last"], 0) if "first" in table.column_names else None

    def against(self, ids: pa.Array, x: np.ndarray, months: np.ndarray | None, k: int) -> pa.Table:
        """The k best of some rows for each query; rows outside a query's months are masked before they are chosen."""
        sims = np.round(_unit(x) @ self.unit.T, 9)
        if not self.open.all():
            m = months[:, None]
            sims[~(self.open | (m >= self.first) & (m <= self.last))] = -np.inf
        edge = -np.partition(-sims, min(k, len(x)) - 1, axis=0)[min(k, len(x)) - 1]
        r, c = np.nonzero((sims >= edge[None, :]) & (sims > -np.inf))
        return pa.table({"query_id": pa.array(self.ids[c]), "id": ids.take(pa.array(r)).cast(pa.string()), "score": pa.array(sims[r, c])})


def _best_of_cell(q: pa.Table, x: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query in a cell; ties by smaller id."""
    ids = x["id"].combine_chunks().cast(pa.string())
    order = pc.sort_indices(ids)
    ids, x = ids.take(order), x.take(order)
    months = _numbers(x["month"], -1) if "month" in x.column_names else None
    out = []
    for i in range(0, q.num_rows, STEP):
        own = _Block(q.slice(i, STEP))
        query, at, score = (np.zeros(0, t) for t in (np.int32, np.int32, np.float64))
        edge = np.full(len(own.ids), -np.inf)  # the k-th best score so far, rounded
        for j in range(0, x.num_rows, ROWS):
            part = x.slice(j, ROWS)
            sims = own.unit @ _unit(_matrix(part["v"])).T
            if not own.open.all():
                m = months[None, j : j + ROWS]
                sims[~(own.open[:, None] | (m >= own.first[:, None]) & (m <= own.last[:, None]))] = -np.inf
            least = edge
            if part.num_rows > k and not np.isfinite(edge).all():
                least = np.maximum(edge, np.partition(sims, part.num_rows - k, axis=1)[:, part.num_rows - k])
            # a little less, since scores are compared when they are rounded
            c, r = np.nonzero((sims >= least[:, None] - 1e-8) & (sims > -np.inf))
            query, at, score = np.concatenate((query, c.astype(np.int32))), np.concatenate((at, (r + j).astype(np.int32))), np.concatenate((score, np.round(sims[c, r], 9)))
            best = np.lexsort((at, -score, query))
            query, at, score = query[best], at[best], score[best]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            full = place == k - 1
            edge[query[full]] = score[full]
            query, at, score = query[place < k], at[place < k], score[place < k]
        out.append(cells.hits(ids, own.ids[query], at, score))
    return pa.concat_tables(out)


def top_k(queries: DataFrame, rows: DataFrame, k: int = TOP, block: int = BLOCK, size: int | None = None) -> DataFrame:
    """(query_id, id, score, rnk): of each (query_id, v) the k rows (id, v) of largest cosine; ties by smaller id.

    Up to FEW queries (a checked number) are sent to all tasks, and rows stay
    where they are; more meet the rows in cells, as tables, without passing
    through the driver.  A task or cell sends on the k best of each query, so
    many queries must not meet as many small parts as there are tasks.  Where
    queries have columns (first, last) that are not null, only rows with a
    ``month`` between them are ranked.  size: the number of rows, if known.
    """
    spark = rows.sparkSession
    scoped = "first" in queries.columns
    asked = queries.select("query_id", "v", *(["first", "last"] if scoped else []))
    given = rows.select("id", "v", *(["month"] if scoped else []))
    few = asked.limit(min(block, FEW) + 1).toArrow()  # at most FEW + 1 vectors
    if few.num_rows == 0:
        return ranked(spark.createDataFrame([], "query_id bigint, id string, score double"), k)
    if few.num_rows <= min(block, FEW):
        shared = spark.sparkContext.broadcast(_Block(few))

        def run(batches):
            own, kept, n = shared.value, [], 0
            for b in batches:
                if b.num_rows:
                    kept.append(own.against(b.column(0), _matrix(b.column(1)), _numbers(b.column(2), -1) if scoped else None, k))
                    n += kept[-1].num_rows
                    if n > 4 * k * len(own.ids) + 100_000:
                        kept = [_best(pa.concat_tables(kept), k)]
                        n = kept[0].num_rows
            if kept:
                yield from _best(pa.concat_tables(kept), k).to_batches()

        return ranked(given.mapInArrow(run, "query_id bigint, id string, score double"), k)
    blocks, parts = cells.grid(rows, asked.count(), block, rows.count() if size is None else size, PART)
    return ranked(cells.meet(asked, given, blocks, parts, lambda q, x: _best_of_cell(q, x, k)), k)


def embed(df: DataFrame, ident: str, text: str, call: Callable[[list[str]], list[list[float]]], batch: int = 32, placeholder: str = " ") -> DataFrame:
    """(id, v) from a call that embeds a list of texts: batches of a given size, a placeholder for blank texts, unit length.

    The call must return one vector for each text.
    """
    rows = df.select(F.col(ident).cast("string").alias("id"), F.coalesce(F.when(F.trim(F.col(text)) != "", F.col(text)), F.lit(placeholder)).alias("t"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = call(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
                v = _unit(np.asarray(got, np.float64)).astype(np.float32)
                flat = pa.array(v.ravel())
                yield pa.RecordBatch.from_arrays([ids.slice(i, batch), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), flat)], ["id", "v"])

    return rows.mapInArrow(run, "id string, v array<float>")
