"""Problem 2: texts that share most of their words, among all texts.

Method: filtering by prefixes under several global orders of the words.  Two
word sets whose Jaccard similarity is at least t share a word in their prefixes
under *every* order of the words.  The first order (rare words first) finds the
candidates by an equi-join on prefix words; prefixes under two further orders
(hashes of the words) are intersected by bit masks during that join; exact
similarity is computed for what is left.

The join is between two roles.  Where the partner is no smaller, the smaller set
needs only its first ``n - ceil(2t / (1 + t) n) + 1`` words, the larger one its
first ``n - ceil(t n) + 1``; so words that every text of a kind has stay out of
the smaller role and no word gathers a quadratic number of candidates.

Equal word sets are one class: classes are numbered and joined, ids only belong
to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import discard, materialize

#: Buckets of the table of word frequencies that orders the words: the size of what is broadcast (8 bytes each).
BUCKETS = 1 << 18
#: Bytes kept of a word's hash in a class's packed set.
WIDTH = 6


def _packed(values: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = raw.reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the rows that end at these byte offsets (first one 0)."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _sets_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and row offsets of a column of packed sets."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    buf = arr.buffers()
    off = np.frombuffer(buf[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    return _unpacked(raw), (off - off[0]) // WIDTH


def word_sets(df: DataFrame, ident: str, text: str, min_words: int) -> DataFrame:
    """(id, c1, c2, words) of rows with an id and at least min_words distinct words.

    words packs the distinct words in rising order of their hashes; (c1, c2) is
    a 128-bit hash of it and names its class.
    """

    def run(batches):
        from tidemark.llm import textform, words as w

        for b in (part for whole in batches for part in textform.portions(whole, 1)):
            v, rows = w.word_sets(b.column(1))
            v, rows = w.distinct_sorted(v & np.uint64((1 << 8 * WIDTH) - 1), rows)
            keep = np.flatnonzero(np.diff(rows) >= min_words)
            if len(keep) == 0:
                continue
            size = np.diff(rows)[keep]
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(rows[keep] - ends[:-1], size) + np.arange(ends[-1])
            v = v[at]
            with np.errstate(over="ignore"):
                c1 = w.mix(np.add.reduceat(w.mix(v + np.uint64(1)), ends[:-1]) + size.astype(np.uint64))
                c2 = w.mix(np.add.reduceat(w.mix(v ^ np.uint64(0x5BD1E995DEADBEEF)), ends[:-1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), _binary(_packed(v).ravel(), ends * WIDTH)], ["id", "c1", "c2", "words"]
            )

    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "id string, c1 bigint, c2 bigint, words binary")


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (k, c1, c2, words) of the classes, numbered, and (id, k) of their distinct members; sets is discarded."""
    classes = materialize(sets.select("c1", "c2", "words").dropDuplicates(["c1", "c2"]).withColumn("k", F.monotonically_increasing_id()), "classes")
    members = materialize(sets.select("id", "c1", "c2").distinct().join(classes.select("c1", "c2", "k"), ["c1", "c2"]).select("id", "k"), "members")
    discard(sets)
    return classes, members


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often words of each bucket occur, over all rows; BUCKETS numbers."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            v, _ = _sets_of(b.column(0))
            total += np.bincount((v % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    got = sets.select("words").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(got["bucket"])] = np.asarray(got["n"])
    return out


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _prefix_rows(classes: DataFrame, frequency, t: float, smaller: bool) -> DataFrame:
    """(word, k, n, pos, b, c) for each prefix word under the first order, in one of the two roles.

    b and c are masks of the class's prefix words under the two other orders.
    """

    def run(batches):
        from tidemark.llm import words as w

        freq = frequency.value
        for batch in batches:
            v, rows = _sets_of(batch.column(1))
            if len(v) == 0:
                continue
            n = np.diff(rows)
            row = np.repeat(np.arange(len(n)), n)
            prefix = n - _ceil((2 * t / (1 + t) if smaller else t) * n) + 1
            with np.errstate(over="ignore"):
                hashes = [w.mix(v), w.mix(v ^ np.uint64(0xA5A5A5A5A5A5)), w.mix(v ^ np.uint64(0x3C3C3C3C3C3C))]
            place = np.arange(len(v)) - np.repeat(rows[:-1], n)
            masks = []
            for h in hashes[1:]:
                first = place < prefix[row]
                sel = np.lexsort((h, row))[first]
                bit = np.uint64(1) << (v[sel] % np.uint64(61))
                masks.append(np.bitwise_or.reduceat(bit, np.concatenate(([0], np.cumsum(prefix)[:-1]))).view(np.int64))
            order = np.lexsort((hashes[0], freq[(v % np.uint64(BUCKETS)).astype(np.int64)], row))
            first = place < prefix[row]
            sel, r, p = order[first], row[first], place[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[sel].view(np.int64)), pa.array(np.asarray(batch.column(0))[r]), pa.array(n[r].astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(masks[0][r]), pa.array(masks[1][r])],
                ["word", "k", "n", "pos", "b", "c"],
            )

    return classes.select("k", "words").mapInArrow(run, "word bigint, k bigint, n int, pos int, b bigint, c bigint")


def candidates(classes: DataFrame, t: float) -> DataFrame:
    """Distinct (x, y): class pairs, the first no smaller, that pass the filters under all orders."""
    freq = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))
    large, small = _prefix_rows(classes, freq, t, smaller=False), _prefix_rows(classes, freq, t, smaller=True)
    x = large.select("word", F.col("k").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("b").alias("xb"), F.col("c").alias("xc"))
    y = small.select("word", F.col("k").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("b").alias("yb"), F.col("c").alias("yc"))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("xn") + F.col("yn")) - 1e-9)
    once = (F.col("xn") > F.col("yn")) | (F.col("x") > F.col("y"))
    size = (F.col("xn") >= F.col("yn")) & (F.col("yn") >= F.col("xn") * t - 1e-9)
    place = (F.col("xp") <= F.col("xn") - need) & (F.col("yp") <= F.col("yn") - need)
    masks = (F.col("xb").bitwiseAND(F.col("yb")) != 0) & (F.col("xc").bitwiseAND(F.col("yc")) != 0)
    return x.join(y, "word").where((F.col("x") != F.col("y")) & once & size & masks & place).select("x", "y").distinct()


def _similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarity of each row's two packed sets."""
    va, ra = _sets_of(a)
    vb, rb = _sets_of(b)
    na, nb = np.diff(ra), np.diff(rb)
    v = np.concatenate((va, vb))
    r = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)))
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    same = np.flatnonzero((v[1:] == v[:-1]) & (r[1:] == r[:-1]))
    shared = np.bincount(r[same], minlength=len(na))
    return shared / np.maximum(na + nb - shared, 1)


def class_links(classes: DataFrame, t: float = 0.7) -> DataFrame:
    """(x, y, similarity): the pairs of different classes (k, words) with similarity >= t."""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_similarity(a, b))

    x = classes.select(F.col("k").alias("x"), F.col("words").alias("xw"))
    y = classes.select(F.col("k").alias("y"), F.col("words").alias("yw"))
    pairs = candidates(classes, t).join(x, "x").join(y, "y")
    return pairs.withColumn("similarity", jaccard("xw", "yw")).where(F.col("similarity") >= t - 1e-12).select("x", "y", "similarity")


def near_duplicate_pairs(df: DataFrame, ident: str, text: str, t: float = 0.7, min_words: int = 8) -> DataFrame:
    """Distinct pairs (id_a < id_b as text) of different ids with nearly the same words, ids of equal sets included.

    Null ids and null, empty or short texts are in no pair; a repeated row
    counts once; an id with several texts has each of them; an empty table
    gives no row.  Every pair of the similarity asked for is found.
    """
    if not 0 < t <= 1 or min_words < 1:
        raise ValueError("0 < t <= 1 and min_words >= 1")
    classes, members = classes_of(materialize(word_sets(df, ident, text, min_words), "wordsets"))
    a = members.select(F.col("id").alias("a"), F.col("k").alias("x"))
    b = members.select(F.col("id").alias("b"), F.col("k").alias("y"))
    across = class_links(classes, t).join(a, "x").join(b, "y").select("a", "b")
    inside = a.join(b, F.col("x") == F.col("y")).where("a < b").select("a", "b")
    both = across.where("a <> b").unionByName(inside)
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, ident: str, text: str, t: float = 0.7, min_words: int = 8) -> DataFrame:
    """(id, class, group, links): one row for each id and word set, with its class, its group and its class's links.

    A class holds equal word sets; links counts the other classes it is near
    to; a group is what links connect, named after its smallest class.
    """
    from tidemark.operators.graph import connected_components

    classes, members = classes_of(materialize(word_sets(df, ident, text, min_words), "wordsets"))
    links = materialize(class_links(classes, t).select("x", "y"), "links")
    count = links.select(F.explode(F.array("x", "y")).alias("k")).groupBy("k").agg(F.count("*").alias("links"))
    name = F.concat(F.hex("c1"), F.lit("-"), F.hex("c2"))
    named = classes.select("k", name.alias("class")).join(connected_components(links, "x", "y").select(F.col("node").alias("k"), "component"), "k", "left")
    first = named.where("component IS NOT NULL").groupBy("component").agg(F.min("class").alias("group"))
    out = members.join(named.join(first, "component", "left"), "k").join(count, "k", "left")
    return out.select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
