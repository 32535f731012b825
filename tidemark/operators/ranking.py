"""Fusion of rankings, and the linear re-ranker with its ten features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text

#: Damping of reciprocal ranks, ids kept after fusion, idf of words the corpus lacks.
K_RRF, FUSED_TOP, UNKNOWN_IDF = 60, 300, 1.0


@dataclass(frozen=True)
class Weights:
    """The default weights of features, and the scale of recency in days."""

    relevance: float = 80.0
    favorite: float = 0.5
    retweet: float = 0.5
    reply: float = 0.3
    view: float = 0.1
    affinity: float = 1.0
    recency: float = 1.5
    verified: float = 0.5
    media: float = 0.3
    halflife: float = 180.0
    coverage: float = 5.0


FEATURES = ("relevance", "favorite", "retweet", "reply", "view", "affinity", "recency", "verified", "media", "coverage")


def fuse(rankings: list[DataFrame], k: int = K_RRF, top: int = FUSED_TOP, keep: str | None = None) -> DataFrame:
    """(query_id, id, fused, rnk[, keep]) of rankings (query_id, id, rnk): reciprocal ranks summed.

    Ties go to the id seen first (in the earlier ranking, then at the better
    place), then to the smaller id.  keep is a column of the first ranking, null
    for ids that it lacks.
    """
    if k <= 0 or top <= 0:
        raise ValueError("k and top must be positive")
    every = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", "id", (F.lit(1.0) / (k + F.col("rnk"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rnk").alias("place")).alias("seen"), *([(F.col(keep) if i == 0 else F.lit(None)).cast("double").alias(keep)] if keep else []))
        every = part if every is None else every.unionByName(part)
    # once by query: neither the sums nor the ranks need another exchange
    summed = every.repartition("query_id").groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("fused"), F.min("seen").alias("seen"), *([F.max(keep).alias(keep)] if keep else []))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "seen", "id")
    return summed.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= top).select("query_id", "id", "fused", "rnk", *([keep] if keep else []))


def wanted_words(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, wanted): the distinct words (query_id, term) of each query with their idf (term, idf), none below 0."""
    known = words.select("query_id", "term").distinct().join(terms.select("term", "idf"), "term", "left")
    idf = F.greatest(F.lit(0.0), F.coalesce("idf", F.lit(UNKNOWN_IDF)))
    # a query has few words: one array of them for each query
    return known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("wanted"))


def missing_idf(wanted: str, has: str) -> Column:
    """The summed idf of a query's wanted words that a post's array of words lacks; 0 for a query without words."""
    lacking = F.aggregate(F.filter(wanted, lambda t: ~F.array_contains(F.col(has), t["term"])), F.lit(0.0), lambda s, t: s + t["idf"])
    return F.coalesce(lacking, F.lit(0.0))


def _log(c: str) -> Column:
    return F.log1p(F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))).cast("double"))


def rank(hits: DataFrame, posts: DataFrame, affinity: DataFrame, anchor: Column, words: DataFrame | None = None, terms: DataFrame | None = None, tokens: DataFrame | None = None, weights: Weights = Weights(), top: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, relevance_in, features, rnk) of hits (query_id, id, relevance).

    Hits whose post is unknown are dropped; a null or NaN relevance counts 0.
    affinity has (screen_name, affinity); words and terms give the penalty for query words a post lacks, and
    tokens (id, w) the posts' words where they are known already.
    The score is the sum of the ten features; ties go to the larger relevance,
    then to the smaller id.  anchor may use columns of hits.
    """
    extra = [c for c in hits.columns if c not in ("query_id", "id", "relevance")]
    hits = hits.withColumn("relevance", F.coalesce(F.nanvl("relevance", F.lit(0.0)), F.lit(0.0)))
    slim = posts.select("id", "text", "urls", "created_at", "favorite_count", "retweet_count", "reply_count", "view_count", F.col("author.screen_name").alias("screen_name"), F.col("author.verified").alias("verified"), (F.coalesce(F.size("media"), F.lit(0)) > 0).alias("has_media"))
    # posts get what belongs to them before they meet the hits, which are many for a post
    slim = slim.join(affinity.select("screen_name", F.col("affinity").alias("_aff")), "screen_name", "left")
    if words is not None:
        if tokens is None:
            slim = slim.withColumn("w", text.tokens(text.index_text(F.col("text"), F.col("urls"))))
        else:
            slim = slim.join(tokens.select("id", "w"), "id")
        # a query's words go to its hits, so that a post's words aren't shuffled once for each of them
        asked = hits.join(wanted_words(words, terms), "query_id", "left")
        full = asked.join(slim, "id").withColumn("missing", missing_idf("wanted", "w"))
    else:
        full = hits.join(slim, "id").withColumn("missing", F.lit(0.0))
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    value = {
        "relevance": F.col("relevance") * weights.relevance,
        "favorite": _log("favorite_count") * weights.favorite,
        "retweet": _log("retweet_count") * weights.retweet,
        "reply": _log("reply_count") * weights.reply,
        "view": _log("view_count") * weights.view,
        "affinity": F.coalesce("_aff", F.lit(0.0)) * weights.affinity,
        "recency": dates.recency(F.col("created_at"), anchor, weights.halflife) * weights.recency,
        "verified": flag("verified") * weights.verified,
        "media": flag("has_media") * weights.media,
        "coverage": -F.col("missing") * weights.coverage,
    }
    total = value[FEATURES[0]]
    for f in FEATURES[1:]:
        total = total + value[f]
    # features stay columns until ranks are known: a map has their names in each row
    scored = full.select("query_id", "id", *extra, F.round(total, digits).alias("score"), F.col("relevance").alias("walker_relevance"), *[F.round(value[f], digits).alias(f"_{f}") for f in FEATURES])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("walker_relevance"), F.asc("id"))
    out = scored.withColumn("rnk", F.row_number().over(w))
    out = out if top is None else out.where(F.col("rnk") <= top)
    return out.select("query_id", "id", *extra, "score", "walker_relevance", F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f"_{f}"))]).alias("feature_breakdown"), "rnk")
