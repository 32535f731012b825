"""Reading an archive: exports, API pages, monthly Markdown, and what lies on disk."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import materialize

USER = "id string, screen_name string, name string, profile_image_url string, verified boolean, followers_count bigint, following_count bigint"
MEDIA = "type string, url string, media_url string, preview_image_url string, width int, height int, local_path string"
_POST = f"id string, text string, created_at string, user struct<{USER}>, retweet_count bigint, favorite_count bigint, reply_count bigint, quote_count bigint, view_count bigint, lang string, is_retweet boolean, is_quote boolean, media array<struct<{MEDIA}>>, urls array<string>, hashtags array<string>, mentions array<string>, conversation_id string, in_reply_to_user_id string"
#: An export's post; quoted and retweeted posts one level deep, what is nested deeper as a variant.
POST = f"{_POST}, quoted_tweet struct<{_POST}, quoted_tweet variant, retweeted_tweet variant>, retweeted_tweet struct<{_POST}, quoted_tweet variant, retweeted_tweet variant>, raw_data variant"
COUNTS = ("retweet_count", "favorite_count", "reply_count", "quote_count", "view_count")


class ExportError(ValueError):
    """An export that isn't what it should be."""


def _heads(spark: SparkSession, path: str) -> list:
    """(file, head): the first character of each file that is no blank, '' where there is none; files are opened by the tasks, not read."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches):
        from pyarrow import fs

        for b in batches:
            heads = []
            for p in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(p)
                with system.open_input_stream(at) as f:
                    head = ""
                    while not head and (raw := f.read(4096)):
                        head = raw.decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")[:1]
                heads.append(head)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.string())], ["file", "head"])

    return files.mapInArrow(run, "file string, head string").collect()  # one row for each file


def load_export(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The posts of a JSON export, optional fields at their defaults.

    A file that begins with a bracket is one array of posts, read as a stream of
    records; any other has one post to a line, and is split among tasks.  The
    files are parsed once, into an intermediate table.  strict raises
    ExportError where a file is neither, or a post lacks a required field; else
    such posts are left out.
    """
    heads = _heads(spark, path)
    if strict and not any(r.head for r in heads):
        raise ExportError(f"{path}: nothing to read")
    if strict and (bad := [r.file for r in heads if r.head not in ("[", "{", "")]):
        raise ExportError(f"{bad[0]}: no JSON array of posts")
    parsed = None
    for arrays in (True, False):
        some = [r.file for r in heads if r.head and (r.head == "[") == arrays]
        if some:
            rows = spark.read.schema(f"{POST}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", arrays).json(some).withColumn("file", F.col("_metadata.file_path"))
            parsed = rows if parsed is None else parsed.unionByName(rows)
    if parsed is None:
        return with_defaults(spark.createDataFrame([], POST))
    parsed = materialize(parsed.withColumn("_lacks", lacks_required()), "export")
    if strict and (bad := parsed.where("_bad IS NOT NULL OR _lacks").select("file", "id", (F.col("_bad").isNotNull()).alias("broken")).limit(1).collect()):
        raise ExportError(f"{bad[0].file}: " + ("not whole JSON" if bad[0].broken else f"post {bad[0].id} lacks a required field"))
    return with_defaults(parsed.where("_bad IS NULL AND NOT _lacks").drop("_bad", "_lacks", "file"))


def lacks_required() -> Column:
    """Whether a post of an export lacks a field it must have."""
    lacks = F.lit(False)
    for c in ("id", "text", "created_at", "user.id", "user.screen_name", "user.name"):
        lacks = lacks | F.col(c).isNull()
    deep = F.exists("media", lambda m: m["type"].isNull() | m["url"].isNull())
    return lacks | F.coalesce(deep, F.lit(False))


def with_defaults(posts: DataFrame) -> DataFrame:
    """Optional fields at their defaults."""
    out = posts
    for c in COUNTS:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in ("is_retweet", "is_quote"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    for c in ("media", "urls", "hashtags", "mentions"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(posts.schema[c].dataType)))
    return out.withColumn("lang", F.coalesce("lang", F.lit("en")))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


_INSTRUCTIONS = "$.data.user.result.timeline.timeline.instructions"


def _entries(pages: DataFrame, key: str, json: str) -> DataFrame:
    """(page, i, j, content) of timeline entries; pages of another form give none."""
    parsed = pages.select(F.col(key).alias("page"), F.try_variant_get(F.try_parse_json(json), _INSTRUCTIONS, "array<variant>").alias("list"))
    steps = parsed.select("page", F.posexplode("list").alias("i", "step")).where(_get(F.col("step"), "$.type") == "TimelineAddEntries")
    return steps.select("page", "i", F.posexplode(F.try_variant_get("step", "$.entries", "array<variant>")).alias("j", "entry")).select("page", "i", "j", F.try_variant_get("entry", "$.content", "variant").alias("content"))


def page_posts(pages: DataFrame, key: str = "page", json: str = "json") -> DataFrame:
    """The posts of API pages, in the export's shape, with (page, i, j) for their order; what isn't a post is skipped."""
    items = _entries(pages, key, json).where(_get(F.col("content"), "$.entryType") == "TimelineTimelineItem")
    t = items.select("page", "i", "j", F.try_variant_get("content", "$.itemContent.tweet_results.result", "variant").alias("t")).withColumn("l", F.try_variant_get("t", "$.legacy", "variant")).where("l IS NOT NULL")
    t = t.withColumn("u", F.try_variant_get("t", "$.core.user_results.result", "variant"))
    col = F.col
    text = lambda v, p, d="": F.coalesce(_get(col(v), p), F.lit(d))
    filled = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c], F.lit(""))
    num = lambda v, p: F.coalesce(_get(col(v), p, "bigint"), F.lit(0))
    here = lambda v, p: F.try_variant_get(v, p, "variant").isNotNull()
    listed = lambda p, f: F.coalesce(F.transform(F.try_variant_get("l", p, "array<variant>"), lambda x: _get(x, f)), F.array().cast("array<string>"))
    user = F.struct(
        text("u", "$.rest_id").alias("id"),
        filled(_get(col("u"), "$.core.screen_name"), _get(col("u"), "$.legacy.screen_name")).alias("screen_name"),
        filled(_get(col("u"), "$.core.name"), _get(col("u"), "$.legacy.name")).alias("name"),
        text("u", "$.legacy.profile_image_url_https").alias("profile_image_url"),
        F.coalesce(_get(col("u"), "$.legacy.verified", "boolean"), _get(col("u"), "$.is_blue_verified", "boolean"), F.lit(False)).alias("verified"),
        num("u", "$.legacy.followers_count").alias("followers_count"),
        num("u", "$.legacy.friends_count").alias("following_count"),
    )
    media = F.transform(
        F.try_variant_get("l", "$.extended_entities.media", "array<variant>"),
        lambda m: F.struct(
            F.coalesce(_get(m, "$.type"), F.lit("photo")).alias("type"),
            F.coalesce(_get(m, "$.url"), F.lit("")).alias("url"),
            F.coalesce(_get(m, "$.media_url_https"), F.lit("")).alias("media_url"),
            F.lit(None).cast("string").alias("preview_image_url"),
            _get(m, "$.original_info.width", "int").alias("width"),
            _get(m, "$.original_info.height", "int").alias("height"),
            F.lit(None).cast("string").alias("local_path"),
        ),
    )
    return t.select(
        "page",
        "i",
        "j",
        F.coalesce(_get(col("t"), "$.rest_id"), text("l", "$.id_str")).alias("id"),
        text("l", "$.full_text").alias("text"),
        text("l", "$.created_at").alias("created_at"),
        user.alias("user"),
        *[num("l", f"$.{c}").alias(c) for c in COUNTS[:4]],
        F.coalesce(_get(col("t"), "$.views.count").try_cast("bigint"), F.lit(0)).alias("view_count"),
        text("l", "$.lang", "en").alias("lang"),
        here("l", "$.retweeted_status_result").alias("is_retweet"),
        here("t", "$.quoted_status_result").alias("is_quote"),
        F.coalesce(media, F.array().cast(f"array<struct<{MEDIA}>>")).alias("media"),
        listed("$.entities.urls", "$.expanded_url").alias("urls"),
        listed("$.entities.hashtags", "$.text").alias("hashtags"),
        listed("$.entities.user_mentions", "$.screen_name").alias("mentions"),
        _get(col("l"), "$.conversation_id_str").alias("conversation_id"),
        _get(col("l"), "$.in_reply_to_user_id_str").alias("in_reply_to_user_id"),
    )


def page_cursors(pages: DataFrame, key: str = "page", json: str = "json") -> DataFrame:
    """(page, cursor): the first cursor to the next page of each page that has one."""
    found = _entries(pages, key, json).where((_get(F.col("content"), "$.entryType") == "TimelineTimelineCursor") & (_get(F.col("content"), "$.cursorType") == "Bottom"))
    return found.groupBy("page").agg(F.min_by(_get(F.col("content"), "$.value"), F.struct("i", "j")).alias("cursor"))


_FILE = r"^likes_([0-9]{4}-[0-9]{2})\.md$"


def month_files(spark: SparkSession, folder: str) -> DataFrame:
    """(year_month, path, markdown) of likes_YYYY-MM.md files, newest first; other files are skipped; FileNotFoundError without the folder."""
    local = folder.removeprefix("file://")
    if "://" not in local and not os.path.isdir(local):
        raise FileNotFoundError(folder)
    if "://" not in local and not any(re.match(_FILE, f) for f in os.listdir(local)):
        return spark.createDataFrame([], "year_month string, path string, markdown string")
    rows = spark.read.option("pathGlobFilter", "likes_????-??.md").text(folder, wholetext=True)
    named = rows.select(F.regexp_extract(F.col("_metadata.file_name"), _FILE, 1).alias("year_month"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    return named.where("year_month <> ''").orderBy(F.desc("year_month"))


def sections(files: DataFrame, hosts: tuple[str, ...] = ("x.com", "twitter.com")) -> DataFrame:
    """(year_month, seq, tweet_id, handle, text, raw_section): the posts of monthly Markdown.

    A section begins at a line with ###; those without a status address are
    skipped.  The id is that of the first status address (of these hosts) in the
    section.  The text is the section without its heading and its link line.
    """
    parts = files.select("year_month", F.posexplode(F.split("markdown", r"(?m)^(?=### )")).alias("seq", "s")).where(F.col("s").startswith("### "))
    link = rf"https?://(?:{'|'.join(h.replace('.', '[.]') for h in hosts)})/([^/\s)]*)/status/([0-9]+)"
    first = F.regexp_extract("s", r"^([^\n]*)", 1)
    of_link = F.regexp_extract(first, r"^###\s+\[@([^\]]+)\]\(", 1)
    bare = F.regexp_extract(first, r"^###\s+@([A-Za-z0-9_]+)", 1)
    some = lambda c: F.when(c != "", c)
    body = F.regexp_replace(F.regexp_replace("s", r"^[^\n]*\n?", ""), r"(?m)^[ \t]*🔗[ \t]*\[View on X\]\(.*\)[ \t]*$\n?", "")
    return parts.withColumn("tweet_id", F.regexp_extract("s", link, 2)).where("tweet_id <> ''").select(
        "year_month",
        "seq",
        "tweet_id",
        F.coalesce(some(of_link), some(bare), F.regexp_extract("s", link, 1)).alias("handle"),
        F.regexp_replace(body, r"^\n+|\n+$", "").alias("text"),
        F.regexp_replace("s", r"\n+$", "").alias("raw_section"),
    )


def local_media(spark: SparkSession, folder: str) -> DataFrame:
    """(tweet_id, pos, path) of files named <id>_<pos>.<ext>; the first by name counts."""
    return media_names(spark.read.format("binaryFile").load(folder).select("path"))


def media_names(rows: DataFrame) -> DataFrame:
    """The same for a table of paths; other names are skipped."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = rows.select(F.regexp_extract(name, r"^(.+)_([0-9]+)\.[^.]+$", 1).alias("tweet_id"), F.regexp_extract(name, r"^(.+)_([0-9]+)\.[^.]+$", 2).try_cast("int").alias("pos"), "path")
    return found.where("tweet_id <> ''").groupBy("tweet_id", "pos").agg(F.min("path").alias("path"))


def media_to_fetch(posts: DataFrame, files: DataFrame) -> DataFrame:
    """(tweet_id, pos, type, url): media of posts of which there is no file yet, and where to get them."""
    from tidemark.functions.text import original_photo_url

    every = posts.select(F.col("id").alias("tweet_id"), F.posexplode("media").alias("pos", "m")).select("tweet_id", "pos", F.col("m.type").alias("type"), original_photo_url(F.col("m.type"), F.col("m.media_url"), F.col("m.url")).alias("url"))
    return every.where("url IS NOT NULL").join(files.select("tweet_id", "pos"), ["tweet_id", "pos"], "left_anti")


def cached(pages: DataFrame, urls: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """Pages (url_key, url, final_url, content_type, sanitized_markdown, fetched_at seconds) of urls that are not too old; the newest counts."""
    asked = urls.select(F.sha2("url", 256).alias("url_key")).distinct()
    fresh = pages.where(now - F.col("fetched_at") <= ttl_days * 86400).join(asked, "url_key", "left_semi")
    kept = fresh.groupBy("url_key").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "url_key"]), "fetched_at").alias("p"))
    return kept.select("url_key", "p.*")


def put_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new pages in the place of old ones of the same URL."""
    keyed = new.withColumn("url_key", F.sha2("url", 256)).select(*pages.columns)
    return pages.join(keyed.select("url_key"), "url_key", "left_anti").select(*pages.columns).unionByName(keyed)


def cookies(rows: DataFrame, required: tuple[str, ...] = ("ct0", "auth_token")) -> DataFrame:
    """One row (cookies, missing): a map of (seq, name, value), the last of a name winning, and required names it lacks."""
    one = rows.groupBy("name").agg(F.max_by("value", "seq").alias("value"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("cookies")).select("cookies", F.array_except(F.array(*map(F.lit, required)), F.map_keys("cookies")).alias("missing"))


def demos(rows: DataFrame, value: str = "value") -> DataFrame:
    """(query, fenced_context_raw, expected_outputs) of labelled examples, each a JSON object in a column; expected_outputs is JSON text.

    Those that lack one of the three, or are no object, are left out.
    """
    v = F.try_parse_json(value)
    got = rows.select(_get(v, "$.query").alias("query"), _get(v, "$.fenced_context_raw").alias("fenced_context_raw"), F.try_variant_get(v, "$.expected_outputs", "variant").alias("x"))
    return got.where("query IS NOT NULL AND fenced_context_raw IS NOT NULL AND schema_of_variant(x) LIKE 'OBJECT<%'").select("query", "fenced_context_raw", F.to_json("x").alias("expected_outputs"))


def load_demos(spark: SparkSession, path: str) -> DataFrame:
    """The labelled examples of a file that holds a JSON array of them."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("v"))
    return demos(rows.select(F.to_json("v").alias("value")))


def kept_table(spark: SparkSession, path: str, stamp: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table saved below path under this stamp, else one that is built and saved in its place.

    The stamp says what the table was made from (such as the newest change of
    its sources, see :func:`newest_change`, and their number).  A table is
    written beside the old one and named in a small file last, so that readers
    see one or the other.
    """
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda p: system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    current = json.loads(spark.read.text(f"{path}/current").first()[0]) if there(f"{path}/current/_SUCCESS") else {"stamp": None, "n": 0}
    if current["stamp"] != stamp:
        current = {"stamp": stamp, "n": current["n"] + 1}
        build().write.mode("overwrite").parquet(f"{path}/table-{current['n']}")
        spark.createDataFrame([(json.dumps(current),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return spark.read.parquet(f"{path}/table-{current['n']}")


def newest_change(spark: SparkSession, path: str) -> str:
    """When the files of a path last changed, and how many there are: a stamp for :func:`kept_table`."""
    r = spark.read.format("binaryFile").load(path).agg(F.max("modificationTime").alias("t"), F.count("*").alias("n")).first()
    return f"{r.t} {r.n}"


def wait_seconds(remaining: Column, reset: Column, now: Column, buffer: int = 5) -> Column:
    """Seconds to wait for an interface that allows ``remaining`` more calls until the moment ``reset``: none while more than one is left."""
    return F.when(remaining <= 1, F.greatest(reset - now, F.lit(0)) + buffer).otherwise(F.lit(0))
