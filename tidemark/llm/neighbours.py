"""Problem 6: the k most similar vectors of every vector.

Method: multi-probe hashing with p-stable (Gaussian) projections.  In each of a
few tables a vector falls into the bucket of its rounded projections; besides
its own bucket it visits those reached by the perturbations most likely to hold
near vectors, in estimated order of success (expected distances of projections
to bucket borders give the order of perturbation sets, each vector's own borders
say which projections they mean).  Every vector is both stored and a query, so a
visit serves both sides.  Candidates of all tables are merged by exact cosine.

Vectors of a bucket meet in block products.  A bucket with more residents or
members than a block is cut into a grid of cells, each resident block against
each visitor block, so no pair is lost and no task grows with a bucket.

Vectors travel few times: once to find each id's row, and once into each bucket.
All else is small: rows are numbered in the order of their ids, equal vectors
are found by a 128-bit hash and hashed and compared as one, with their k + 1
smallest ids, and a cell sends on one packed list of each vector it ranked.
Products are in single precision; whatever lies within its error of the k-th is
compared in double precision and then by id, however much that is.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize

#: Hash tables; perturbed buckets a vector visits in each; width of a bucket in standard deviations of unit vectors' projections.
TABLES, PROBES, WIDTH = 2, 2, 2.0
#: Most members of a role in one cell of a bucket; products held at once.
BLOCK, PRODUCTS = 32768, 1 << 22
#: Rows of the table of crowded buckets up to which it is broadcast (24 bytes each).
BROADCAST_ROWS = 200_000
_EXTRA = 3  # candidates kept beyond k in single precision before the exact cosine


def hashes_for(rows: int) -> int:
    """Projections per table: grows with the logarithm of the rows, so that buckets stay about as full."""
    return max(2, round(0.6 * (math.log2(max(rows, 2)) - 9.6)))


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first perturbation sets by expected score, as ranks of border distances (0-based, of 2 x hashes)."""
    m = 2 * hashes

    def expected(j: int) -> float:
        if j <= hashes:
            return j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
        i = m + 1 - j
        return 1 - i / (hashes + 1) + i * (i + 1) / (4 * (hashes + 1) * (hashes + 2))

    cost = [expected(j) for j in range(1, m + 1)]
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if not any(m - 1 - j in s for j in s):  # not both borders of one projection
            out.append(s)
        last = s[-1]
        if last + 1 < m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*s, last + 1)))
    return out


def bucket_keys(x: np.ndarray, hashes: int, tables: int, probes: int, width: float, seed: int = 11) -> np.ndarray:
    """(rows, tables, 1 + probes) 64-bit keys of the own and the visited buckets of unit vectors."""
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    sets = perturbations(hashes, probes)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, hashes, x.shape[1]])
        a, b = rng.normal(size=(x.shape[1], hashes)), rng.uniform(0, 1, hashes)
        mixer = rng.integers(-(2**62), 2**62, hashes)
        # each row alone: a product of the whole batch could round differently in another batch
        p = np.einsum("ij,jk->ik", x.astype(np.float64), a) / width + b
        h = np.floor(p).astype(np.int64)
        f = p - h
        order = np.argsort(np.concatenate((f**2, (1 - f) ** 2), axis=1), axis=1, kind="stable")
        with np.errstate(over="ignore"):
            move = np.concatenate((-mixer, mixer))
            out[:, t, 0] = (h * mixer).sum(axis=1) + rng.integers(-(2**62), 2**62)
            for k, s in enumerate(sets):
                out[:, t, 1 + k] = out[:, t, 0] + move[order[:, list(s)]].sum(axis=1)
    return out


def usable(df: DataFrame, ident: str, vector: str, dims: int, newest: str | None = None) -> DataFrame:
    """(id, v) with one row for each id: its vector of dims finite numbers, not all zero.

    Where ``newest`` names a column, only the id's row with the largest value
    counts, and the id is left out if that row's vector is not usable; else the
    row with the greatest vector.  Null ids, null and short vectors, NaN and
    infinite numbers are left out.
    """
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"), (F.col(newest) if newest else F.lit(0)).alias("r")).where("id IS NOT NULL")
    best = rows.groupBy("id").agg(F.max_by("v", F.struct("r", "v")).alias("v"))
    # NaN is greater than every number
    end = F.lit(float("inf"))
    finite = (F.size(F.array_compact("v")) == dims) & (F.array_max("v") < end) & (F.array_min("v") > -end)
    return best.where((F.size("v") == dims) & finite & ((F.array_max("v") != 0) | (F.array_min("v") != 0)))


def _packed(x: np.ndarray) -> pa.Array:
    width = 4 * x.shape[1]
    ends = np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, "<f4").view(np.uint8).ravel())])


def _matrix(arr: pa.Array, dims: int) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_binary(arr.type):
        return np.asarray(arr.flatten(), np.float32).reshape(-1, dims)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], "<f4", count=(off[-1] - off[0]) // 4, offset=int(off[0])).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _top(s: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, others, cosine): the k largest of each row of s, cosines of rows q and o of x, by cosine in double precision and then by ids.

    Every column within the error of s of the row's k-th is compared.
    """
    margin = 2 * (x.shape[1] + 4) * float(np.finfo(s.dtype).eps) + 2e-12  # of two products of unit vectors, and of rounding
    top = _best(s, k + _EXTRA)
    values = np.take_along_axis(s, top, axis=1)
    edge = np.full(len(s), -1.5) if top.shape[1] <= k else np.maximum(np.partition(values, -k, axis=1)[:, -k] - margin, -1.5)
    wide = (values.min(axis=1) >= edge) & (top.shape[1] < s.shape[1])  # more than the kept ones may count
    row, col = np.nonzero((values >= edge[:, None]) & ~wide[:, None])
    parts = [(row, top[row, col])]
    wide = np.flatnonzero(wide)
    step = max(1, 50_000 // max(s.shape[1], 1))
    for i in range(0, len(wide), step):
        some = wide[i : i + step]
        row, col = np.nonzero(s[some] >= edge[some, None])
        parts.append((some[row], col))
    out = []
    for row, col in parts:
        qq, oo = q[row], o[col]
        exact = np.round(np.einsum("ij,ij->i", x[qq], x[oo]), 12)
        order = np.lexsort((ids[oo], -exact, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        keep = order[place < k]
        out.append((qq[keep], oo[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _compare(x: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, both: bool = True, precision: type = np.float32) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, others, cosine): the k nearest of rows a among rows b of x, and (both) of b among a; ids are numbers in the ids' order."""
    xp = x.astype(precision)
    sims = xp[a] @ xp[b].T
    sims[ids[a][:, None] == ids[b][None, :]] = -2
    return [_top(s, x, ids, q, o, k) for s, q, o in ((sims, a, b), (sims.T, b, a))[: 1 + both]]


def _numbers(ids: pa.Array) -> np.ndarray:
    """A number of each id, in the ids' order."""
    d = ids.dictionary_encode()
    place = np.empty(len(d.dictionary), np.int64)
    place[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(place))
    return place[d.indices.to_numpy()]


def _members(near: DataFrame, groups: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """(id, other, similarity, place) of all ids, from the k nearest of the first id of each group of equal vectors.

    groups: (id, rep) of all ids, rep being the first id of the group; copies: (id, first) of the groups of more than one,
    with up to k + 1 smallest ids.
    """
    ids = F.coalesce(F.slice("first", 1, k), F.array("other"))
    others = near.join(copies.select(F.col("id").alias("other"), "first"), "other", "left").select("id", "similarity", F.explode(ids).alias("other"))
    own = copies.select("id", F.lit(1.0).alias("similarity"), F.explode("first").alias("other"))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), F.asc("other"))
    ranked = others.unionByName(own).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    best = ranked.groupBy(F.col("id").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("place", "other", "similarity"))).alias("best"))
    got = groups.join(best, "rep").select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, k)).alias("at", "b"))
    return got.select("id", F.col("b.other").alias("other"), F.col("b.similarity").alias("similarity"), (F.col("at") + 1).alias("place"))


def _bounds(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A number along an axis that at least k of s reach: the k-th of the maxima of parts."""
    n = s.shape[axis]
    if n < k:
        return np.full(s.shape[1 - axis], -1.5, s.dtype)
    size = max(1, min(n // (4 * k), 32))
    cut = s[: n - n % size] if axis == 0 else s[:, : n - n % size]
    tops = cut.reshape(size, n // size, -1).max(axis=0) if axis == 0 else cut.reshape(len(s), size, n // size).max(axis=1)
    return np.partition(tops, -k, axis=axis).take(-k, axis=axis)


def _cell(x: np.ndarray, code: np.ndarray, residents: int, k: int, mutual: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, others, cosine) of one cell's unit vectors x, the first ``residents`` being residents, the rest visitors.

    Residents are ranked against visitors and, if mutual, each other; visitors
    against residents.  Each gets its k best by cosine in double precision,
    then by code.
    """
    x32 = x.astype(np.float32)
    n = len(x)
    margin = np.float32(2 * (x.shape[1] + 4) * float(np.finfo(np.float32).eps) + 2e-12)
    lo = 0 if mutual else residents
    step = max(1, PRODUCTS // max(n - lo, 1))
    twin = {int(c): residents + i for i, c in enumerate(code[residents:].tolist())} if not mutual else {}
    edge = np.full(n - residents, -1.5, np.float32)
    qs, os, ss = [], [], []
    for i in range(0, residents, step):
        m = min(step, residents - i)
        s = x32[i : i + m] @ x32[lo:].T
        if mutual:
            s[np.arange(m), i + np.arange(m)] = -2
        for r, c in enumerate(code[i : i + m].tolist() if twin else ()):  # of a crowded bucket: residents may visit it too
            if c in twin:
                s[r, twin[c] - lo] = -2
        r, c = np.nonzero(s >= np.maximum(_bounds(s, k, 1) - margin, -1.5)[:, None])
        qs.append(i + r)
        os.append(lo + c)
        ss.append(s[r, c])
        if n > residents:
            v = s[:, residents - lo :]
            edge = np.maximum(edge, np.maximum(_bounds(v, k, 0) - margin, -1.5))
            r, c = np.nonzero(v >= edge)
            qs.append(residents + c)
            os.append(i + r)
            ss.append(v[r, c])
    q, o, s = np.concatenate(qs), np.concatenate(os), np.concatenate(ss)
    # of what passed the bounds, what is within the error of the k-th
    order = np.lexsort((-s, q))
    q, o, s = q[order], o[order], s[order]
    first = np.searchsorted(q, q)
    kth = np.minimum(first + k, np.searchsorted(q, q, side="right")) - 1
    near = s >= s[kth] - margin
    q, o = q[near], o[near]
    exact = np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 65536]], x[o[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
    exact = np.round(exact, 12)
    order = np.lexsort((code[o], -exact, q))
    q, o, exact = q[order], o[order], exact[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], o[keep], exact[keep]


_PAIR = np.dtype([("o", "<i8"), ("s", "<f8")])


def _lists(q: np.ndarray, o: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct queries of rows that stand together, and each one's packed list."""
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    pairs = np.empty(len(q), _PAIR)
    pairs["o"], pairs["s"] = o, s
    ends = np.concatenate((start, [len(q)])).astype(np.int32) * _PAIR.itemsize
    return q[start], pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(pairs.view(np.uint8))])


def nearest(vectors: DataFrame, dims: int, k: int = 5, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(id, other, similarity, place): each id's k most similar other ids by cosine, from (id, v) of :func:`usable`.

    Cosines are in double precision, rounded to 12 places; ties go to the
    smaller id.  Ids without a near vector in a visited bucket get fewer rows;
    an empty table gives none.
    """
    spark = vectors.sparkSession
    marked = materialize(vectors.select("id", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")), "marked")
    at = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    first = marked.withColumn("at", at).where(F.col("at") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("first"))
    numbered = first.select(F.col("first")[0].alias("id"), "h1", "h2", "first").orderBy("id").withColumn("code", F.monotonically_increasing_id())
    groups = materialize(numbered, "groups")  # in the order of ids, without vectors
    reps = materialize(vectors.join(groups.select("id", "code"), "id").select("code", "v"), "vectors")
    hashes = hashes_for(groups.count())

    def keys(batches):
        for b in batches:
            got = bucket_keys(_unit(_matrix(b.column(0), dims)), hashes, tables, probes, width)
            own = np.zeros(got.shape, bool)
            own[:, :, 0] = True
            yield pa.RecordBatch.from_arrays([pa.array(got.ravel()), pa.array(own.ravel().astype(np.int32))], ["key", "own"])

    counts = reps.select("v").mapInArrow(keys, "key bigint, own int").groupBy("key").agg(F.sum("own").alias("residents"), F.count("*").alias("members"))
    used = counts.where((F.col("residents") > 0) & (F.col("members") > block))
    crowded = materialize(used.select("key", F.ceil(F.col("residents") / block).cast("int").alias("nr"), F.ceil(F.col("members") / block).cast("int").alias("nv")), "crowded")
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)

    def entries(batches):
        step = max(1, 20_000 // (tables * (1 + probes)))
        for b in batches:
            x = _matrix(b.column(1), dims)
            for i in range(0, len(x), step):
                part = x[i : i + step]
                got = bucket_keys(_unit(part), hashes, tables, probes, width)
                n = got.shape[1] * got.shape[2]
                own = np.zeros(got.shape, bool)
                own[:, :, 0] = True
                at = np.repeat(np.arange(len(part)), n)
                yield pa.RecordBatch.from_arrays([pa.array(got.ravel()), pa.array(own.ravel()), b.column(0).slice(i, step).take(pa.array(at)), _packed(part[at])], ["key", "own", "code", "v"])

    all_entries = reps.mapInArrow(entries, "key bigint, own boolean, code bigint, v binary").join(crowded, "key", "left")
    salt = F.xxhash64("code")
    plain = F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("own").alias("own")))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.struct(r.alias("r"), F.pmod(salt, F.col("nv")).cast("int").alias("c"), F.lit(False).alias("own")))
    as_resident = F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda c: F.struct(F.pmod(salt, F.col("nr")).cast("int").alias("r"), c.alias("c"), F.lit(True).alias("own")))
    cells = F.when(F.col("nr").isNull(), plain).when(F.col("own"), F.concat(as_resident, as_visitor)).otherwise(as_visitor)
    placed = all_entries.select("key", "code", "v", F.col("nr").isNotNull().alias("grid"), F.explode(cells).alias("at")).select(F.xxhash64("key", "at.r", "at.c").alias("cell"), F.col("at.own").alias("own"), "grid", "code", "v")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = placed.repartition(parts, "cell").sortWithinPartitions("cell")

    def meet(batches):
        rest: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            cell, own, grid, code = (np.asarray(table[c]) for c in ("cell", "own", "grid", "code"))
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            ends = np.concatenate((starts[1:], [len(cell)]))
            residents = np.add.reduceat(own.astype(np.int64), starts)
            raw = table["v"].combine_chunks()
            for g in np.flatnonzero((residents > 0) & (ends - starts > 1)).tolist():
                lo, n = int(starts[g]), int(ends[g] - starts[g])
                order = np.argsort(~own[lo : lo + n], kind="stable")
                x, c = _unit(_matrix(raw.slice(lo, n), dims)[order]), code[lo : lo + n][order]
                q, o, s = _cell(x, c, int(residents[g]), k, not grid[lo])
                if len(q):
                    at, lists = _lists(q, c[o], s)
                    yield pa.RecordBatch.from_arrays([pa.array(c[at]), lists], ["q", "found"])

        for b in batches:
            if b.num_rows == 0:
                continue
            cell = np.asarray(b.column(0))
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut == 0 and (not rest or rest[-1].column(0)[-1].as_py() == cell[0]):
                rest.append(b)
                continue
            yield from flush(pa.Table.from_batches([*rest, b.slice(0, cut)]))
            rest = [b.slice(cut)]
        if rest:
            yield from flush(pa.Table.from_batches(rest))

    lists = placed.select("cell", "own", "grid", "code", "v").mapInArrow(meet, "q bigint, found binary")

    def merge(batches):
        for b in batches:
            found = b.column(1)
            size = np.asarray(found.value_lengths()).astype(np.int64)
            flat = found.flatten()
            pairs = np.frombuffer(b"".join(flat.to_pylist()), _PAIR)
            per = np.asarray(pc.binary_length(flat)).astype(np.int64) // _PAIR.itemsize
            q = np.repeat(np.repeat(np.arange(len(size)), size), per)
            order = np.lexsort((pairs["o"], -pairs["s"], q))
            q, o, s = q[order], pairs["o"][order], pairs["s"][order]
            new = np.ones(len(q), bool)  # a pair met in several tables has one cosine
            new[1:] = (q[1:] != q[:-1]) | (o[1:] != o[:-1])
            q, o, s = q[new], o[new], s[new]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q[keep])), pa.array(o[keep]), pa.array(s[keep]), pa.array((place[keep] + 1).astype(np.int32))], ["q", "o", "similarity", "place"])

    # a vector has one list of each of its buckets
    best = lists.groupBy("q").agg(F.collect_list("found").alias("found")).mapInArrow(merge, "q bigint, o bigint, similarity double, place int")
    names = groups.select("code", "id")
    near = best.join(names.withColumnRenamed("code", "q"), "q").join(names.select(F.col("code").alias("o"), F.col("id").alias("other")), "o").select("id", "other", "similarity", "place")
    copies = groups.where(F.size("first") > 1)
    if copies.isEmpty():
        return near
    in_group = marked.join(groups.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("id", "rep")
    return _members(near, in_group, copies.select("id", "first"), k)


def exact_nearest(queries: DataFrame, vectors: DataFrame, dims: int, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The same for a stated set of queries against all rows, by block products: the measure of recall.

    Queries are sent in numbered blocks to the partitions of vectors; each task
    keeps k candidates of each query.
    """
    groups = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    packed = numbered.groupBy("g").agg(F.collect_list("id").alias("qid"), F.collect_list("v").alias("qv"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = vectors.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = packed.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        qid, qv = left["qid"].combine_chunks().flatten(), left["qv"].combine_chunks().flatten()
        out = []
        for i in range(0, right.num_rows, block):
            part = right.slice(i, block)
            ids = pa.concat_arrays([qid, part["id"].combine_chunks()])
            x = _unit(np.concatenate((_matrix(qv, dims), _matrix(part["v"].combine_chunks(), dims))))
            code = _numbers(ids)
            q, o, s = _compare(x, code, np.arange(len(qid)), len(qid) + np.arange(part.num_rows), k, both=False, precision=np.float64)[0]
            out.append(pa.table({"id": ids.take(pa.array(q)), "other": ids.take(pa.array(o)), "similarity": pa.array(s)}))
        return pa.concat_tables(out) if out else empty

    got = spread.groupBy("g", "p").cogroup(cells.groupBy("g", "p")).applyInArrow(run, "id string, other string, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), F.asc("other"))
    return got.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
