"""Hybrid search: lexical and dense candidates, fused and re-ranked, for many queries in one plan."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import bm25, dense, posts as P, ranking
from tidemark.storage import materialize

TOP = 50
SNIPPET = 240


def spans(queries: DataFrame) -> DataFrame:
    """(query_id, first, last): the month numbers each query's filter means; null without a filter, an empty span (1, 0) for one that makes no sense."""
    year, start, end = F.col("year_filter"), F.col("month_start").try_cast("int"), F.col("month_end").try_cast("int")
    bare = F.col("year_filter").isNull() & F.col("month_start").isNull() & F.col("month_end").isNull()
    lo = F.when(F.col("month_start").isNull(), F.lit(1)).otherwise(start)
    hi = F.when(F.col("month_start").isNull(), F.when(F.col("month_end").isNull(), F.lit(12))).otherwise(F.when(F.col("month_end").isNull(), start).otherwise(end))
    good = F.coalesce(year.isNotNull() & lo.between(1, 12) & hi.between(1, 12) & (lo <= hi), F.lit(False))
    at = lambda m, empty: F.when(bare, F.lit(None).cast("int")).when(good, year * 12 + m - 1).otherwise(empty).cast("int")
    return queries.select("query_id", at(lo, 1).alias("first"), at(hi, 0).alias("last"))


def filters(queries: DataFrame) -> DataFrame:
    """(query_id, year_month) of the queries with a filter that makes sense, one row for each month meant."""
    some = spans(queries).where("first <= last")
    return some.select("query_id", F.explode(F.sequence("first", "last")).alias("n")).select("query_id", F.format_string("%d-%02d", F.floor(F.col("n") / 12).cast("int"), F.col("n") % 12 + 1).alias("year_month"))


def anchors(queries: DataFrame, now: datetime) -> DataFrame:
    """queries with ``anchor``: the end of a query's filter, else now."""
    month = F.coalesce(F.col("month_end"), F.col("month_start")).try_cast("int")
    last = F.coalesce(month, F.lit(12))
    december = F.make_timestamp(F.col("year_filter"), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59))
    following = F.make_timestamp(F.col("year_filter"), last + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.when(last == 12, december).otherwise(following - F.expr("INTERVAL '0.000001' SECOND"))
    return queries.withColumn("anchor", F.when(F.col("year_filter").isNull(), F.lit(now)).otherwise(end))


def lexical(index: bm25.Index, queries: DataFrame, top: int = bm25.TOP) -> DataFrame:
    """(query_id, id, score, rnk) by BM25, filters first."""
    terms = bm25.query_terms(queries).join(spans(queries), "query_id")
    return bm25.best(index, terms, top)


def dense_hits(query_vectors: DataFrame, rows: DataFrame, queries: DataFrame, posts: DataFrame, top: int = bm25.TOP) -> DataFrame:
    """(query_id, id, score, rnk) by cosine, filters first: queries without one rank all rows, the others their months' rows."""
    month = dates.month_number(dates.month_key(F.col("created_at")))
    return dense.top_k(query_vectors.join(spans(queries), "query_id"), rows.join(posts.select("id", month.alias("month")), "id", "left"), top, size=rows.count())


def search(queries: DataFrame, posts: DataFrame, index: bm25.Index, affinity: DataFrame, now: datetime, query_vectors: DataFrame | None = None, rows: DataFrame | None = None, top: int = TOP, weights: ranking.Weights = ranking.Weights()) -> DataFrame:
    """(query_id, id, score, walker_relevance, feature_breakdown, rnk): the best posts of each query.

    queries has (query_id, query_text, year_filter, month_start, month_end).  The
    relevance feature is the cosine, 0 for posts only found by words.  Queries
    without a vector are searched by words alone, and without words by vector.
    """
    by_words = lexical(index, queries)
    if query_vectors is not None:
        near = dense_hits(query_vectors, rows, queries, posts).withColumnRenamed("score", "cos")
        fused = ranking.fuse([near, by_words], keep="cos")
    else:
        fused = ranking.fuse([by_words]).withColumn("cos", F.lit(None).cast("double"))
    hits = fused.select("query_id", "id", F.coalesce("cos", F.lit(0.0)).alias("relevance")).join(anchors(queries, now).select("query_id", "anchor"), "query_id")
    return ranking.rank(hits, posts, affinity, F.col("anchor"), bm25.query_terms(queries), index.terms, index.words, weights, top).drop("anchor")


def shaped(ranked: DataFrame, posts: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Hits as they are shown: (query_id, rnk, tweet_id, year_month, handle, tweet_url, snippet, urls, score, walker_relevance, why, feature_breakdown).

    Posts missing from the archive fall back to their Markdown section (tree:
    tweet_id, year_month, handle, text), else to empty fields; the month falls
    back to the section's, else to ``unknown``.
    """
    slim = posts.select("id", F.col("text").alias("_text"), F.col("author.screen_name").alias("_handle"), F.col("urls").alias("_urls"), dates.month_key(F.col("created_at")).alias("_month"), F.lit(True).alias("_known"))
    full = ranked.join(slim, "id", "left")
    if tree is not None:
        t = tree.select(F.col("tweet_id").alias("id"), F.col("year_month").alias("_tmonth"), F.col("handle").alias("_thandle"), F.col("text").alias("_ttext")).dropDuplicates(["id"])
        full = full.join(t, "id", "left")
    else:
        full = full.select("*", *[F.lit(None).cast("string").alias(c) for c in ("_tmonth", "_thandle", "_ttext")])
    pick = lambda a, b: F.coalesce(F.when(F.col("_known"), F.col(a)).otherwise(F.col(b)), F.lit(""))
    handle = text.sanitized(pick("_handle", "_thandle"))
    marks = F.split(F.coalesce(text.sanitized(F.array_join("_urls", "\n")), F.lit("")), "\n")
    safe = F.filter(F.transform(marks, F.trim), lambda u: F.lower(u).rlike("^https?://"))
    begin, end = text.FENCES["url"]
    return full.select(
        "query_id",
        "rnk",
        F.col("id").alias("tweet_id"),
        F.coalesce("_month", "_tmonth", F.lit("unknown")).alias("year_month"),
        handle.alias("handle"),
        text.status_url(handle, F.col("id")).alias("tweet_url"),
        text.sanitized(text.cut(pick("_text", "_ttext"), SNIPPET)).alias("snippet"),
        F.transform(safe, lambda u: F.concat(F.lit(begin), text.neutralized(u), F.lit(end))).alias("urls"),
        "score",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("walker_relevance"))).alias("walker_relevance"),
        F.lit("").alias("why"),
        "feature_breakdown",
    )


def second_round(first: DataFrame, queries: DataFrame, graph_nodes: DataFrame, find, k: int = 5) -> DataFrame:
    """Hits of both rounds, each id once with its ``round``: the k heaviest entities of each query's graph are searched in one plan.

    find(queries) -> (query_id, id, ..., rnk) searches a table of queries.
    """
    from tidemark.operators import graph

    picked = graph.seeds(graph_nodes, k)
    named = picked.select((F.col("query_id") * 1000 + F.col("place")).alias("_seed"), "query_id", "seed_text")
    asked = named.join(queries.drop("query_text"), "query_id").select(F.col("_seed").alias("query_id"), F.col("seed_text").alias("query_text"), *[c for c in queries.columns if c not in ("query_id", "query_text")])
    # a few rows for each query, counted and searched: the graph is not built again for each
    asked = materialize(asked, "asked")
    found = find(asked).select((F.floor(F.col("query_id") / 1000)).cast("bigint").alias("query_id"), "id", (F.col("rnk") + (F.col("query_id") % 1000) * 1000).alias("rnk"))
    return P.first_rounds(first.select("query_id", "id", F.col("rnk").cast("bigint").alias("rnk")), found)


def utc(text_: str) -> datetime:
    return datetime.fromisoformat(text_).replace(tzinfo=UTC)
