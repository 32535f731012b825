"""Registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text, vectors
from tidemark.operators import bm25, dense, entities, ranking, search, shredding
from tidemark.operators import posts as P
from tidemark.plans import reading, reporting, texts
from tidemark.plans.oracle import SQL
from tidemark.sources import archive
from tidemark.storage import materialize, scratch, table
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2026, 1, 1, tzinfo=UTC)


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return P.latest(table(spark, d, "tweets"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(shredding.shred(table(spark, d, "likes_export"), "record_id", "payload"), "nodes")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Media entries with a URL of each post at any depth, with their posts and users."""
    return shredding.media_of_posts(_nodes(spark, d)).withColumnRenamed("record", "record_id").distinct()


def p5_posts(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of posts, each with its enclosing post."""
    got = shredding.posts(_nodes(spark, d)).withColumnRenamed("record", "record_id")
    return got.withColumns({c: F.array_join(c, " ") for c in ("hashtags", "urls", "mentions")})


def p5_users(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of posts' users."""
    return shredding.users(_nodes(spark, d)).withColumnRenamed("record", "record_id")


def p5_media(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of media entries."""
    return shredding.media(_nodes(spark, d)).withColumnRenamed("record", "record_id")


def posts_latest(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("id", "text", "created_at", F.col("author.id").alias("author_id"), "view_count", "favorite_count", F.col("fetched_at").cast("string").alias("fetched_at"))


def posts_flat(spark: SparkSession, d: str) -> DataFrame:
    return P.flat(table(spark, d, "tweets")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def posts_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.stats(table(spark, d, "tweets"))


def month_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.month_counts(table(spark, d, "tweets"))


def author_affinity(spark: SparkSession, d: str) -> DataFrame:
    return P.author_affinity(table(spark, d, "tweets")).withColumn("affinity", F.round("affinity", 9))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return bm25.query_terms(table(spark, d, "search_queries"))


def query_months(spark: SparkSession, d: str) -> DataFrame:
    return search.filters(table(spark, d, "search_queries"))


def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(_posts(spark, d)).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors and rows of a dense search; in the place of a query's embedding stands its best hit's vector."""
    rows = materialize(dense.usable(table(spark, d, "corpus_embeddings").where("model_name = 'arch-embed-2'"), "tweet_id", "vector", 96, "row_idx"), "rows")
    queries = table(spark, d, "search_queries")
    hits = table(spark, d, "scored_hits").where("score IS NOT NULL AND NOT isnan(score)").select("query_id", F.col("tweet_id").alias("id"), "score")
    known = hits.join(rows.select("id"), "id", "left_semi")
    # the best score of a query, and of its hits the smallest id
    best = known.groupBy("query_id", "score").agg(F.min("id").alias("id")).groupBy("query_id").agg(F.max_by("id", "score").alias("id"))
    asked = best.join(queries.select("query_id"), "query_id", "left_semi").join(rows, "id").select("query_id", "v")
    # they are counted before they meet the rows
    return materialize(asked, "asked"), rows


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, bm25.Index, DataFrame, DataFrame]:
    """Queries, posts, index, query vectors and rows of a hybrid search."""
    posts = materialize(_posts(spark, d), "posts")
    return table(spark, d, "search_queries"), posts, bm25.build(posts), *_vectors(spark, d)


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    index = bm25.build(_posts(spark, d))
    return search.lexical(index, table(spark, d, "search_queries")).select("query_id", "id", F.round("score", 6).alias("score"), "rnk")


def search_dense(spark: SparkSession, d: str) -> DataFrame:
    asked, rows = _vectors(spark, d)
    return search.dense_hits(asked, rows, table(spark, d, "search_queries"), _posts(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"), "rnk")


def search_fused(spark: SparkSession, d: str) -> DataFrame:
    queries, posts, index, asked, rows = _parts(spark, d)
    near, words = search.dense_hits(asked, rows, queries, posts), search.lexical(index, queries)
    return ranking.fuse([near, words]).withColumn("fused", F.round("fused", 9))


def _features(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "id", "score", "walker_relevance", *[F.col("feature_breakdown")[f].alias(f) for f in ranking.FEATURES], "rnk")


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: lexical and dense candidates of every query, fused, re-ranked, the best 50."""
    queries, posts, index, asked, rows = _parts(spark, d)
    return _features(search.search(queries, posts, index, P.author_affinity(table(spark, d, "tweets")), NOW, asked, rows))


def rank_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "scored_hits").where("walker_relevance IS NOT NULL AND NOT isnan(walker_relevance)").groupBy("query_id", F.col("tweet_id").alias("id")).agg(F.max("walker_relevance").alias("relevance"))
    return _features(ranking.rank(hits, _posts(spark, d), P.author_affinity(table(spark, d, "tweets")), F.lit(NOW), top=20))


def entities_all(spark: SparkSession, d: str) -> DataFrame:
    return entities.extract(_posts(spark, d))


def entities_top(spark: SparkSession, d: str) -> DataFrame:
    total = entities.extract(_posts(spark, d)).groupBy("kind", "value").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("kind").orderBy(F.desc("weight"), "value")
    return total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 50)


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return reporting.graph_of(spark, d).nodes.drop("seq")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return reporting.graph_of(spark, d).edges.drop("seq")


def hits_by_month(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "scored_hits").select("query_id", F.col("tweet_id").alias("id")).distinct()
    month = F.coalesce(dates.month_key(F.col("created_at")), F.lit("unknown"))
    return hits.join(_posts(spark, d).select("id", month.alias("year_month")), "id").groupBy("query_id", "year_month").agg(F.count("*").alias("hits"))


def month_sections(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("year_month"), F.col("text").alias("markdown"))
    return archive.sections(files, ("x.example",)).select(F.col("year_month").alias("doc_id"), "tweet_id", "handle")


def text_cuts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.cut(t, 240).alias("plain"), text.flat_cut(t).alias("flat"), text.ellipsis_cut(t).alias("short"))


def html_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tweets").select("id", "text").distinct().select("id", text.html_escaped(F.col("text")).alias("html"))


def media_files(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "tweets").select(F.col("id").alias("tweet_id"), F.posexplode("media").alias("pos", "m"))
    url = text.original_photo_url(F.col("m.type"), F.col("m.media_url"), F.col("m.url"))
    rows = m.select("tweet_id", "pos", F.col("m.type").alias("type"), url.alias("url")).where("url IS NOT NULL")
    return rows.withColumn("extension", text.file_extension(F.col("url"), F.lit(""), F.col("type")))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_embeddings").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("row_idx", F.size("vector").alias("dims"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


def resume_merge(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tweets").select("id", "fetched_at")
    cut = F.lit("2025-12-01").cast("timestamp_ntz")
    return P.new_only(t.where(F.col("fetched_at") >= cut), t.where(F.col("fetched_at") < cut)).withColumn("fetched_at", F.col("fetched_at").cast("string"))


def posts_popular(spark: SparkSession, d: str) -> DataFrame:
    some = P.since(P.popular(P.with_media(_posts(spark, d)), 100), F.lit("2025-01-01").cast("timestamp"))
    return some.select("id", "favorite_count", F.size("media").alias("media"))


def stream_languages(spark: SparkSession, d: str) -> DataFrame:
    """Posts of each label, from a stream that takes each id once."""
    given = table(spark, d, "tweets")
    # a pattern, so that the table may be one file or a folder
    stream = spark.readStream.schema(given.schema).parquet(f"{d}/tweets.parque?").select("id", "lang", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    home = scratch(spark, "stream")
    ingest.taken(stream, "id", ("fetched_at", "lang"), f"{home}/posts", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/posts").groupBy("lang").agg(F.count("*").alias("posts"))


QUERIES: dict[str, Query] = {
    "search_hybrid": search_hybrid,
    "search_bm25": search_bm25,
    "search_dense": search_dense,
    "search_fused": search_fused,
    "bm25_terms": bm25_terms,
    "query_terms": query_terms,
    "query_months": query_months,
    "rank_hits": rank_hits,
    "hits_by_month": hits_by_month,
    "posts_latest": posts_latest,
    "posts_flat": posts_flat,
    "posts_stats": posts_stats,
    "posts_popular": posts_popular,
    "month_counts": month_counts,
    "author_affinity": author_affinity,
    "resume_merge": resume_merge,
    "entities": entities_all,
    "entities_top": entities_top,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "month_sections": month_sections,
    "html_texts": html_texts,
    "text_cuts": text_cuts,
    "media_files": media_files,
    "vector_norms": vector_norms,
    "stream_languages": stream_languages,
    "p5_found": p5_found,
    "p5_posts": p5_posts,
    "p5_users": p5_users,
    "p5_media": p5_media,
}
ORACLE: dict[str, str] = dict(SQL)
for more in (reading, texts, reporting):
    QUERIES |= more.QUERIES
    ORACLE |= more.SQL
