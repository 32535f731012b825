"""Lexical search: an inverted index as tables, and BM25 for many queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import cells
from tidemark.storage import materialize

#: Defaults of the Okapi form: saturation, length weight, and the floor of negative idf as a share of the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP = 200
#: Words up to which a search names them to the scan of postings.
FEW = 64
#: Queries of a block (of TOP hits each; more of fewer), and words of a part's texts, that meet in a cell.
BLOCK, PART = 8192, 8_000_000


@dataclass
class Index:
    """words (id, w, dl), postings (id, term, tf, dl, month), terms (term, df, idf), and the corpus size and mean length.

    The statistics are of all posts, whatever a query's filter; month is the
    number of the post's month, null where its date can't be read.  The postings
    of an index that was not kept are made where they are asked for: only a
    search of few words does.
    """

    words: DataFrame
    postings: DataFrame
    terms: DataFrame
    docs: int
    mean_length: float


def build(posts: DataFrame, ident: str = "id", body: str = "text", urls: str | None = "urls") -> Index:
    """The index of posts with ids of their own; texts without a word count as documents of length 0.

    Texts are cut into words once; the table of words serves the statistics, the
    postings, and the ranker's check of what a post lacks.
    """
    whole = text.index_text(F.col(body), F.col(urls)) if urls else F.coalesce(F.col(body), F.lit(""))
    month = dates.month_number(dates.month_key(F.col("created_at"))) if "created_at" in posts.columns else F.lit(None).cast("int")
    words = posts.select(F.col(ident).cast("string").alias("id"), text.tokens(whole).alias("w"), month.alias("month")).withColumn("dl", F.size("w"))
    words = materialize(words, "words")
    size = words.agg(F.count("*").alias("n"), F.sum("dl").alias("t")).first()
    n, total = int(size.n), int(size.t or 0)
    postings = words.select("id", "dl", "month", F.explode("w").alias("term")).groupBy("id", "dl", "month", "term").agg(F.count("*").alias("tf"))
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # each text names its own words once, so the table of single words is never shuffled
    df = materialize(words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms").withColumn("raw", raw)
    floor = df.agg(F.avg("raw")).first()[0] if n else 0.0
    terms = df.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * float(floor or 0.0))).otherwise(F.col("raw")).alias("idf"))
    return Index(words, postings, terms, n, total / n if n else 0.0)


def save(index: Index, path: str) -> None:
    """Keeps an index below a path; postings are sorted by term, so that a search of few words reads few of them."""
    index.words.write.mode("overwrite").parquet(f"{path}/words")
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.words.sparkSession.createDataFrame([(index.docs, index.mean_length)], "docs bigint, mean_length double").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def load(spark, path: str) -> Index:
    """The index that :func:`save` kept."""
    size = spark.read.parquet(f"{path}/size").first()
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("words", "postings", "terms")), size.docs, size.mean_length)


def query_terms(queries: DataFrame, query: str = "query_text", key: str = "query_id") -> DataFrame:
    """(query_id, term, qtf): words of each query, and how often it repeats them."""
    return queries.select(F.col(key).alias("query_id"), F.explode(text.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Index, terms: DataFrame, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of posts that share a word with the query.

    terms (query_id, term, qtf[, first, last]): a query with a span of months
    only meets postings of these, before anything is scored or summed; one whose
    span is empty meets none.  Postings are weighed once for each term that any
    query has.  allowed (query_id, id) restricts the same way.
    """
    wanted = terms.select("term").distinct()
    some = wanted.limit(FEW + 1).collect()  # at most FEW + 1 words
    if len(some) <= FEW:  # the scan skips what other words have
        near = F.col("term").isin([r.term for r in some])
        used, postings = index.terms.where(near), index.postings.where(near)
    else:
        used, postings = wanted.join(index.terms, "term"), index.postings
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("idf") * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.lit(max(index.mean_length, 1e-12))))
    weighed = postings.join(used.select("term", "idf"), "term").select("id", "term", "month", part.alias("part"))
    met = weighed.join(terms, "term")
    if "first" in terms.columns:
        met = met.where(F.col("first").isNull() | F.col("month").between(F.col("first"), F.col("last")))
    return restrict(met, allowed).groupBy("query_id", "id").agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))


def restrict(found: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return found if allowed is None else found.join(allowed, ["query_id", "id"], "left_semi")


def ranked(found: DataFrame, top: int = TOP, digits: int = 9) -> DataFrame:
    """The best posts of each query with ``rnk`` from 1; scores rounded so that the order of sums does not decide, ties by smaller id."""
    rounded = found.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rounded.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= top)


def best(index: Index, terms: DataFrame, top: int = TOP, k1: float = K1, b: float = B) -> DataFrame:
    """What ``ranked(scores(index, terms), top)`` is, without a row for each query and post that share a word.

    These pairs grow with the posts times the queries.  Beyond FEW words of all
    queries together, texts' words and queries' terms meet in cells; a cell adds
    up the scores of one query at a time and sends on the best of each.
    """
    if terms.limit(FEW + 1).count() <= FEW:
        return ranked(scores(index, terms, k1=k1, b=b), top)
    spark = terms.sparkSession
    scoped = ["first", "last"] if "first" in terms.columns else []
    asked = terms.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight"), *scoped)
    blocks, parts = cells.grid(index.words, terms.select("query_id").distinct().count(), max(1, BLOCK * TOP // top), int(index.docs * index.mean_length), PART)
    # no word holds a blank
    texts = index.words.where("dl > 0").select("id", "dl", *(["month"] if scoped else []), F.array_join("w", " ").alias("w"))
    mean = max(index.mean_length, 1e-12)
    found = cells.meet(asked, texts, blocks, parts, lambda q, x: _best(q, x, top, mean, k1, b))
    return ranked(found, top)


def _postings(x: pa.Table, vocabulary: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, tf) in rising order: key is the number of a word x texts + the rank of a text."""
    keys, counts, done = [], [], 0
    for batch in x.select(["w"]).to_batches():
        words = pc.split_pattern(batch.column(0), " ")
        at = pc.index_in(words.flatten(), vocabulary)
        text_of = np.repeat(rank[done : done + len(words)], pc.list_value_length(words).to_numpy())
        met = at.is_valid().to_numpy(zero_copy_only=False)
        key, n = np.unique(at.drop_null().to_numpy().astype(np.int64) * len(rank) + text_of[met], return_counts=True)
        keys.append(key)
        counts.append(n)
        done += len(words)
    key = np.concatenate(keys)
    order = np.argsort(key)  # a text lies in one batch
    return key[order], np.concatenate(counts)[order]


def _best(q: pa.Table, x: pa.Table, k: int, mean: float, k1: float, b: float) -> pa.Table:
    """The k best texts of each query in a cell; scores are rounded before they are compared, ties go to the smaller id."""
    n = x.num_rows
    ids = x["id"].combine_chunks()
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ids = ids.take(pa.array(order))
    vocabulary = pc.unique(q["term"])
    key, tf = _postings(x, vocabulary, rank)
    length = x["dl"].to_numpy()[order].astype(np.float64)
    text_of = (key % n).astype(np.int32)
    part = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length[text_of] / mean))
    start = np.searchsorted(key, np.arange(len(vocabulary) + 1) * n)
    del key, tf
    scoped = "first" in q.column_names
    month = np.asarray(pc.fill_null(x["month"], -1))[order] if scoped else None
    q = q.sort_by([("query_id", "ascending"), ("term", "ascending")])
    query, term, weight = q["query_id"].to_numpy(), pc.index_in(q["term"], vocabulary).to_numpy(), q["weight"].to_numpy()
    first, last = (q["first"].to_pylist(), q["last"].to_pylist()) if scoped else (None, None)
    score, seen = np.zeros(n), np.zeros(n, bool)
    known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # equal queries are answered once
    out_query, out_at, out_score = [], [], []
    ends = np.append(np.flatnonzero(np.diff(query)) + 1, len(query))
    begin = 0
    for end in ends.tolist():
        span = (first[begin], last[begin]) if scoped else (None, None)
        same = (span, tuple(term[begin:end].tolist()), tuple(weight[begin:end].tolist()))
        if same not in known:
            for t, w in zip(term[begin:end].tolist(), weight[begin:end].tolist(), strict=True):
                has = slice(start[t], start[t + 1])
                score[text_of[has]] += w * part[has]
                seen[text_of[has]] = True
            at = np.flatnonzero(seen)
            s = score[at]
            score[at], seen[at] = 0.0, False
            if span[0] is not None:
                inside = (month[at] >= span[0]) & (month[at] <= span[1])
                at, s = at[inside], s[inside]
            known[same] = cells.largest(at.astype(np.int32), np.round(s, 9), k)
        at, s = known[same]
        out_query.append(np.full(len(at), query[begin]))
        out_at.append(at)
        out_score.append(s)
        begin = end
    del text_of, part, known
    return cells.hits(ids, np.concatenate(out_query), np.concatenate(out_at), np.concatenate(out_score))


def search(index: Index, queries: DataFrame, allowed: DataFrame | None = None, top: int = TOP, query: str = "query_text") -> DataFrame:
    """(query_id, id, score, rnk) of each query."""
    terms = query_terms(queries, query)
    return best(index, terms, top) if allowed is None else ranked(scores(index, terms, allowed), top)
