"""Queries of the training-data operators (problem N is pN_...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import canon, capping, encoding, language, mixing, neardup, neighbours, packing, tokens
from tidemark.storage import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Hits left out when each author keeps at most three posts per query."""
    hits = capping.hits_of_authors(table(spark, d, "scored_hits"), table(spark, d, "tweets"))
    return capping.left_out(hits, ["query_id", "author_id"], "tweet_id", "score", cap=3, temperature=capping.COLD, exact=True).select("query_id", "tweet_id")


def p1_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Three hits of each author and query, drawn by score-weighted exponential keys."""
    hits = capping.hits_of_authors(table(spark, d, "scored_hits"), table(spark, d, "tweets"))
    return capping.reservoir(hits, ["query_id", "author_id"], "tweet_id", "score", cap=3, temperature=10.0, seed=7).select("query_id", "tweet_id", "author_id", F.col("race_rank").alias("place"))


def p1_share(spark: SparkSession, d: str) -> DataFrame:
    """Hits kept when an author may hold at most a tenth of a query's hits."""
    hits = capping.hits_of_authors(table(spark, d, "scored_hits"), table(spark, d, "tweets"))
    return capping.cap_by_share(hits, ["query_id"], ["author_id"], "tweet_id", "score", share=0.1).select("query_id", "author_id", "tweet_id", F.col("race_rank").alias("place"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of posts with nearly the same text."""
    return neardup.near_duplicate_pairs(table(spark, d, "tweets"), "id", "text", t=0.7, min_words=8)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each post's class of equal word sets, the group of near ones it is in, and its links."""
    return neardup.near_duplicate_groups(table(spark, d, "tweets"), "id", "text", t=0.7, min_words=8)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts and users whose text or name reads the same in other characters."""
    t = table(spark, d, "tweets")
    texts = canon.same_reading_pairs(t.select("id", "text"), "id", "text").select(F.lit("text").alias("field"), "key_a", "key_b")
    names = canon.same_reading_pairs(t.select(F.col("author.id").alias("id"), F.col("author.name").alias("name")), "id", "name")
    return texts.unionByName(names.select(F.lit("name").alias("field"), "key_a", "key_b"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every post's text and author name."""
    t = table(spark, d, "tweets")
    return t.select(F.col("id"), F.col("author.id").alias("author_id"), canon.consistent(F.col("text")).alias("text"), canon.consistent(F.col("author.name")).alias("name")).distinct()


def _profiles(spark: SparkSession, d: str) -> language.Profiles:
    return language.fit(table(spark, d, "lang_samples"), table(spark, d, "tweets"), "id", "text", "lang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts with a missing or wrong language label or in several languages, with the languages."""
    return language.mislabelled(table(spark, d, "tweets"), _profiles(spark, d), "id", "text", "lang")


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Each post's language with a confidence."""
    got = language.languages(table(spark, d, "tweets"), _profiles(spark, d), "id", "text", "lang")
    return got.select("id", "label", "words", "lang", F.round("confidence", 6).alias("confidence"), F.array_join("langs", " ").alias("langs")).distinct()


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of one language in each post, with a confidence."""
    # of an id with several texts, the least
    once = table(spark, d, "tweets").where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    return language.language_stretches(once, _profiles(spark, d), "id", "text").withColumn("confidence", F.round("confidence", 6))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "corpus_embeddings").where("model_name = 'arch-embed-2'")
    return neighbours.usable(e, "tweet_id", "vector", 96, newest="row_idx")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of posts of which one is among the five most similar of the other."""
    near = neighbours.nearest(_vectors(spark, d), 96, k=5)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the exact five nearest of every id divisible by 50, the share the index finds."""
    v = _vectors(spark, d)
    exact = neighbours.exact_nearest(v.where(F.col("id").cast("decimal(38,0)") % 50 == 0), v, 96, k=5)
    near = neighbours.nearest(v, 96, k=5).select("id", "other", F.lit(1).alias("hit"))
    return exact.join(near, ["id", "other"], "left").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "container_sizes")).withColumnRenamed("id", "doc_id")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container (or containers, if it is longer) of each capacity."""
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """The fill of every container."""
    return packing.fills(_packed(spark, d), table(spark, d, "container_sizes"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", F.col("source")), "tokens")
    return mixing.mix(sizes, table(spark, d, "mix_targets"), seed=5)[0]


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents chosen for the mix, with their copies."""
    return _mixed(spark, d).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source reaches in the mix."""
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with characters from a wrong encoding."""
    return encoding.garbled_documents(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with characters from a wrong encoding, with the text restored where that is possible."""
    return encoding.garbled_documents(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id").distinct()


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_drawn": p1_drawn,
    "p1_share": p1_share,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p4_languages": p4_languages,
    "p4_stretches": p4_stretches,
    "p6_found": p6_found,
    "p6_recall": p6_recall,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

ORACLE: dict[str, str] = {}

ORACLE["p1_found"] = """
WITH a AS (SELECT id AS tweet_id, max(author.id) AS author_id FROM tweets WHERE author.id <> '' GROUP BY id),
h AS (SELECT query_id, tweet_id, max(CASE WHEN score IS NULL OR CAST(score AS VARCHAR) = 'nan' THEN CAST('-infinity' AS DOUBLE) ELSE score END) AS s FROM scored_hits GROUP BY query_id, tweet_id),
r AS (SELECT query_id, tweet_id, row_number() OVER (PARTITION BY query_id, author_id ORDER BY s DESC, tweet_id) AS place FROM h JOIN a USING (tweet_id))
SELECT query_id, tweet_id FROM r WHERE place > 3"""
ORACLE["p1_drawn"] = """
WITH a AS (SELECT id AS tweet_id, max(author.id) AS author_id FROM tweets WHERE author.id <> '' GROUP BY id),
h AS (SELECT query_id, tweet_id, max(CASE WHEN score IS NULL OR CAST(score AS VARCHAR) = 'nan' THEN CAST('-infinity' AS DOUBLE) ELSE score END) AS s FROM scored_hits GROUP BY query_id, tweet_id),
k AS (SELECT query_id, tweet_id, author_id, s - 10.0 * ln(-ln((CAST(CAST('0x' || substr(md5('7/' || tweet_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496)) AS race FROM h JOIN a USING (tweet_id))
SELECT query_id, tweet_id, author_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, author_id ORDER BY race DESC, tweet_id) AS place FROM k) WHERE place <= 3"""
ORACLE["p1_share"] = """
WITH a AS (SELECT id AS tweet_id, max(author.id) AS author_id FROM tweets WHERE author.id <> '' GROUP BY id),
h AS (SELECT query_id, tweet_id, max(CASE WHEN score IS NULL OR CAST(score AS VARCHAR) = 'nan' THEN CAST('-infinity' AS DOUBLE) ELSE score END) AS s FROM scored_hits GROUP BY query_id, tweet_id),
r AS (SELECT query_id, author_id, tweet_id, row_number() OVER (PARTITION BY query_id, author_id ORDER BY s DESC, tweet_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM h JOIN a USING (tweet_id))
SELECT query_id, author_id, tweet_id, place FROM r WHERE place <= ceil(n * 0.1)"""
