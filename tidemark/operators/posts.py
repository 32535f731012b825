"""The posts themselves: one row each, months, authors, counts, lookups and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text


def latest(tweets: DataFrame) -> DataFrame:
    """One row for each id: its newest delivery (ids that are null are left out).

    The newest is the largest fetched_at, then the largest counts; the row is
    found by aggregation, so a task holds one row for each id, not its deliveries.
    """
    order = F.struct(*[F.col(c) for c in ("fetched_at", "view_count", "favorite_count", "retweet_count", "reply_count", "quote_count")], F.struct(*[c for c in tweets.columns if c != "media"]))
    best = tweets.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*[c for c in tweets.columns if c != "id"]), order).alias("_best"))
    return best.select("id", "_best.*").select(*tweets.columns)


def newest_by_id(rows: DataFrame, order: Column) -> DataFrame:
    """One row for each id, that with the largest order; orders of an id must differ for a definite result."""
    best = rows.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), order).alias("_best"))
    return best.select("id", "_best.*").select(*rows.columns)


def with_month(posts: DataFrame) -> DataFrame:
    """posts with ``year_month`` (null where the date can't be read)."""
    return posts.withColumn("year_month", dates.month_key(F.col("created_at")))


def in_months(posts: DataFrame, months: list[str] | None) -> DataFrame:
    """Posts of these months; None keeps all, also those without a readable date; an empty list keeps none."""
    return posts if months is None else posts.where(dates.month_key(F.col("created_at")).isin(months))


def author_affinity(posts: DataFrame) -> DataFrame:
    """(screen_name, posts, affinity): ln(1 + saved posts) of each handle that is not empty; every delivery counts."""
    return posts.select(F.col("author.screen_name").alias("screen_name")).where("screen_name <> ''").groupBy("screen_name").agg(F.count("*").alias("posts")).withColumn("affinity", F.log1p(F.col("posts").cast("double")))


def month_counts(posts: DataFrame) -> DataFrame:
    """(year_month, tweet_count) of readable dates; every delivery counts."""
    return posts.select(dates.month_key(F.col("created_at")).alias("year_month")).where("year_month IS NOT NULL").groupBy("year_month").agg(F.count("*").alias("tweet_count"))


def list_months(files: DataFrame, posts: DataFrame) -> DataFrame:
    """(year_month, path, tweet_count), newest first: months of which there is a file; a count of 0 is null."""
    return files.select("year_month", "path").distinct().join(month_counts(posts), "year_month", "left").orderBy(F.desc("year_month"))


def _size(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _size_positive(c: str) -> Column:
    return F.greatest(_size(c), F.lit(0))


def stats(posts: DataFrame) -> DataFrame:
    """One row of totals; an empty table gives a row of zeros."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return posts.agg(
        F.count("*").alias("total"),
        flag(_size_positive("media") > 0).alias("with_media"),
        total(_size_positive("media")).alias("total_media"),
        flag(F.col("is_retweet")).alias("retweets"),
        flag(F.col("is_quote")).alias("quotes"),
        flag(F.col("author.verified")).alias("verified_authors"),
        F.count_distinct(F.when(F.col("author.id") != "", F.col("author.id"))).alias("unique_authors"),
    )


def flat(posts: DataFrame) -> DataFrame:
    """The flat table of 23 columns; arrays become counts and comma-joined text, dates times, absent counts 0."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    media = F.coalesce(F.col("media"), F.array().cast(posts.schema["media"].dataType))
    return posts.select(
        F.col("id").alias("tweet_id"),
        "text",
        dates.post_time(F.col("created_at")).alias("created_at"),
        F.col("author.id").alias("user_id"),
        F.col("author.screen_name").alias("user_screen_name"),
        F.col("author.name").alias("user_name"),
        F.coalesce("author.verified", F.lit(False)).alias("user_verified"),
        *map(whole, ("retweet_count", "favorite_count", "reply_count", "quote_count", "view_count")),
        "lang",
        F.coalesce("is_retweet", F.lit(False)).alias("is_retweet"),
        F.coalesce("is_quote", F.lit(False)).alias("is_quote"),
        (F.size(media) > 0).alias("has_media"),
        F.size(media).alias("media_count"),
        F.array_join(F.transform(media, lambda m: m["type"]), ",").alias("media_types"),
        _size_positive("urls").alias("url_count"),
        _size_positive("hashtags").alias("hashtag_count"),
        F.coalesce(F.array_join("hashtags", ","), F.lit("")).alias("hashtags"),
        _size_positive("mentions").alias("mention_count"),
        text.plain_url(F.col("author.screen_name"), F.col("id")).alias("tweet_url"),
    )


def extremes(posts: DataFrame, count: str = "favorite_count", top: int = 5) -> DataFrame:
    """(place, id, count, least, most): the top posts by a count, ties by smaller id, with the count's extremes over all posts."""
    ends = posts.agg(F.min(count).alias("least"), F.max(count).alias("most")).first()
    best = posts.where(F.col(count).isNotNull()).select("id", F.col(count).alias("count")).orderBy(F.desc("count"), "id").limit(top)  # a top-k report
    place = F.row_number().over(Window.orderBy(F.desc("count"), "id"))
    return best.select(place.alias("place"), "id", "count", F.lit(ends.least).cast("bigint").alias("least"), F.lit(ends.most).cast("bigint").alias("most"))


def post_json() -> Column:
    """The up to nine fields shown of a post as JSON, from its columns; fields that are empty, 0 or null are left out."""
    full = lambda c: F.when((c != "") & (c.cast("string") != "0"), c)
    shown = {
        "tweet_id": F.col("id"),
        "handle": text.sanitized(F.col("author.screen_name")),
        "display_name": text.sanitized(F.col("author.name")),
        "text": text.sanitized(F.col("text")),
        "created_at": F.col("created_at"),
        "url": text.status_url(F.col("author.screen_name"), F.col("id")),
    }
    counts = {"view_count": "view_count", "like_count": "favorite_count", "retweet_count": "retweet_count"}
    return F.to_json(F.struct(*[full(c).alias(k) for k, c in shown.items()], *[F.when(F.col(c) != 0, F.col(c)).alias(k) for k, c in counts.items()]))


def read_post(posts: DataFrame, ident: str) -> DataFrame:
    """(post): what is shown of one post, as JSON."""
    return posts.where(F.col("id") == ident).limit(1).select(post_json().alias("post"))


def new_only(arrived: DataFrame, saved: DataFrame) -> DataFrame:
    """Posts that are not saved yet, appended to those that are; repeats within the arrivals stay, as a stream drops them itself."""
    return saved.unionByName(arrived.join(saved.select("id"), "id", "left_anti").select(*saved.columns))


def first_rounds(*rounds: DataFrame) -> DataFrame:
    """Hits of several rounds, each id once, from the first round that has it, with ``round`` from 1."""
    every = None
    for i, r in enumerate(rounds, 1):
        part = r.withColumn("round", F.lit(i))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy("query_id", "id").orderBy("round", "rnk")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_media(posts: DataFrame) -> DataFrame:
    return posts.where(F.size("media") > 0)


def popular(posts: DataFrame, least: int) -> DataFrame:
    return posts.where(F.col("favorite_count") > least)


def since(posts: DataFrame, moment: Column) -> DataFrame:
    return posts.where(dates.post_time(F.col("created_at")) > moment)
