"""Registered queries of sources, sinks, caches and ingest, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dense
from tidemark.operators import posts as P
from tidemark.plans import oracle as O
from tidemark.sources import archive, sinks
from tidemark.storage import materialize, scratch, table
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return P.latest(table(spark, d, "tweets"))


@registered(f"""WITH {O._POSTS} SELECT id, text, created_at, author.screen_name AS screen_name, coalesce(favorite_count, 0) AS favorite_count, coalesce(lang, 'en') AS lang, coalesce(len(media), 0) AS media,
  coalesce(array_to_string(urls, ' '), '') AS urls FROM posts WHERE text IS NOT NULL AND created_at IS NOT NULL AND author.id IS NOT NULL AND author.screen_name IS NOT NULL AND author.name IS NOT NULL
  AND len(list_filter(coalesce(media, []), lambda m: m.type IS NULL OR m.url IS NULL)) = 0""")
def export_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Posts written as JSON and loaded as an export; those that lack a required field are left out."""
    path = scratch(spark, "export")
    sinks.write_json(_posts(spark, d).withColumnRenamed("author", "user").drop("fetched_at"), path)
    got = archive.load_export(spark, path, strict=False)
    return got.select("id", "text", "created_at", F.col("user.screen_name").alias("screen_name"), "favorite_count", "lang", F.size("media").alias("media"), F.array_join("urls", " ").alias("urls"))


@registered(f"WITH {O._POSTS} SELECT id AS tweet_id, coalesce(author.screen_name, '') AS user_screen_name, coalesce(favorite_count, 0) AS favorite_count, coalesce(array_to_string(hashtags, ','), '') AS hashtags, {O._PLAIN_URL} AS tweet_url FROM posts")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """The flat table written as CSV and read again."""
    path = scratch(spark, "csv")
    sinks.write_flat(_posts(spark, d), path, "csv")
    got = spark.read.csv(path, header=True, escape='"', multiLine=True)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return got.select("tweet_id", text("user_screen_name"), F.col("favorite_count").cast("bigint").alias("favorite_count"), text("hashtags"), "tweet_url")


@registered(f"""WITH {O._POSTS}, files AS (SELECT DISTINCT {O._month('created_at')} AS year_month FROM posts), n AS (SELECT {O._month('created_at')} AS year_month, count(*) AS tweet_count FROM tweets GROUP BY 1)
SELECT f.year_month, 'likes_' || f.year_month || '.md' AS file, n.tweet_count, row_number() OVER (ORDER BY f.year_month DESC) AS place FROM files f LEFT JOIN n USING (year_month) WHERE f.year_month IS NOT NULL""")
def months_listed(spark: SparkSession, d: str) -> DataFrame:
    """Months of which there is a Markdown file, newest first, with their posts."""
    from tidemark.operators import ordering

    folder = scratch(spark, "months")
    sinks.write_months(_posts(spark, d), folder)
    got = P.list_months(archive.month_files(spark, folder), table(spark, d, "tweets"))
    newest = got.withColumn("_m", -F.regexp_replace("year_month", "-", "").cast("int"))
    return ordering.numbered(newest, [], ["_m"]).select("year_month", F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "tweet_count", F.col("place").cast("bigint").alias("place"))


@registered(f"""WITH {O._POSTS} SELECT {O._month('created_at')} AS year_month, id AS tweet_id, coalesce(author.screen_name, '') AS handle, contains(coalesce(text, ''), '#') AS tagged FROM posts WHERE {O._month('created_at')} IS NOT NULL""")
def months_read(spark: SparkSession, d: str) -> DataFrame:
    """The posts of Markdown files by month, read again."""
    folder = scratch(spark, "months")
    sinks.write_months(_posts(spark, d).withColumn("hashtags", F.array().cast("array<string>")), folder, include_media=False)
    return archive.sections(archive.month_files(spark, folder)).select("year_month", "tweet_id", "handle", F.col("text").contains("#").alias("tagged"))


_N = "coalesce(CAST(greatest({0}, 0) AS VARCHAR), '0')"


@registered(f"""WITH {O._POSTS} SELECT id, '<div class=''tweet''><div class=''user''><strong>' || coalesce(author.name, '') || '</strong> @' || coalesce(author.screen_name, '') || '</div><div class=''text''>'
  || {O._escaped("coalesce(text, '')")} || '</div>' || CASE WHEN len(media) > 0 THEN '<div class=''media''>' || coalesce(array_to_string(list_filter(list_transform(media, lambda m:
  CASE WHEN m.local_path <> '' AND m.type = 'photo' THEN '<img src=''' || m.local_path || ''' alt=''Tweet image''>' WHEN coalesce(m.local_path, '') = '' AND m.media_url <> '' THEN '<img src=''' || m.media_url || ''' alt=''Tweet image''>' END), lambda x: x IS NOT NULL), ''), '') || '</div>' ELSE '' END
  || '<div class=''stats''><span>🔄 ' || coalesce(retweet_count, 0) || '</span><span>❤️ ' || coalesce(favorite_count, 0) || '</span><span>💬 ' || coalesce(reply_count, 0) || '</span><a href=''https://x.com/' || coalesce(author.screen_name, '') || '/status/' || id || ''' target=''_blank''>View on X</a></div></div>' AS line FROM posts""")
def html_posts(spark: SparkSession, d: str) -> DataFrame:
    """Each post's HTML."""
    return _posts(spark, d).select("id", sinks.html_block().alias("line"))


_MEDIUM = """CASE WHEN coalesce(m.local_path, '') <> '' THEN CASE m.type WHEN 'photo' THEN '![Image](' || {path} || ')' || chr(10) WHEN 'video' THEN '🎥 [Video](' || {path} || ')' || chr(10) WHEN 'animated_gif' THEN '![GIF](' || {path} || ')' || chr(10) END
  WHEN m.type = 'photo' AND m.media_url <> '' THEN '![Image](' || m.media_url || ')' || chr(10) WHEN m.url <> '' THEN '🔗 [' || m.type || '](' || m.url || ')' || chr(10) END""".format(path="CASE WHEN starts_with(m.local_path, 'media/') THEN substr(m.local_path, 7) ELSE m.local_path END")
_STATS = "array_to_string(list_filter([CASE WHEN retweet_count > 0 THEN '🔄 ' || retweet_count END, CASE WHEN favorite_count > 0 THEN '❤️ ' || favorite_count END, CASE WHEN reply_count > 0 THEN '💬 ' || reply_count END, CASE WHEN view_count > 0 THEN '👁️ ' || view_count END], lambda x: x IS NOT NULL), ' • ')"


@registered(f"""WITH {O._POSTS}, b AS (SELECT coalesce({O._month('created_at')}, 'unknown') AS year_month, id, {_STATS} AS stats, * EXCLUDE (id) FROM posts),
rows AS (SELECT year_month, id, array_to_string(list_filter(list_concat([chr(10) || '### [@' || coalesce(author.screen_name, '') || '](https://x.com/' || coalesce(author.screen_name, '') || ')', '**' || coalesce(author.name, '') || '** ' || CASE WHEN author.verified THEN '✓' ELSE '' END,
  '*' || coalesce(strftime({O._time('created_at')}, '%Y-%m-%d %H:%M:%S'), created_at, '') || '*', chr(10) || coalesce(text, '') || chr(10)],
  CASE WHEN len(media) > 0 THEN list_concat(['**Media:**' || chr(10)], list_filter(list_transform(media, lambda m: {_MEDIUM}), lambda x: x IS NOT NULL)) ELSE CAST([] AS VARCHAR[]) END,
  [CASE WHEN stats <> '' THEN chr(10) || '*' || stats || '*' END, chr(10) || '🔗 [View on X](https://x.com/' || coalesce(author.screen_name, '') || '/status/' || id || ')',
  CASE WHEN len(hashtags) > 0 THEN chr(10) || '**Tags:** ' || array_to_string(list_transform(hashtags, lambda t: '#' || t), ' ') END, chr(10) || '---']), lambda x: x IS NOT NULL), chr(10)) AS line FROM b)
SELECT * FROM rows UNION ALL SELECT year_month, '', chr(10) || '## ' || CASE year_month WHEN 'unknown' THEN 'Unknown Date' ELSE year_month END || ' (' || count(*) || ' tweets)' || chr(10) FROM rows GROUP BY year_month""")
def markdown_posts(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown export's lines, media seen from their folder."""
    return sinks.markdown_rows(_posts(spark, d), base="media")


@registered(f"WITH {O._POSTS} SELECT f AS format, (SELECT count(*) FROM posts) AS posts FROM (SELECT unnest(['json', 'csv', 'markdown', 'html']) AS f)")
def formats_exported(spark: SparkSession, d: str) -> DataFrame:
    """How many posts each format of an export holds."""
    out = sinks.export_all(_posts(spark, d), scratch(spark, "all"), "2026-01-01 00:00:00")
    heads = {"markdown": "### [@", "html": "<div class='tweet'>"}
    parts = [spark.read.schema("id string").json(out["json"]).select(F.lit("json").alias("format"))]
    parts.append(spark.read.csv(out["csv"], header=True, escape='"', multiLine=True).select(F.lit("csv").alias("format")))
    parts += [spark.read.text(out[k]).where(F.col("value").startswith(h)).select(F.lit(k).alias("format")) for k, h in heads.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("format").agg(F.count("*").alias("posts"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(page, json): saved posts as pages of an interface, about twenty posts each, with a cursor to the next."""
    t = table(spark, d, "tweets").where("id IS NOT NULL")
    pages = max(1, t.count() // 20)
    c = F.col
    legacy = F.struct(
        c("text").alias("full_text"), "created_at", "retweet_count", "favorite_count", "reply_count", "quote_count", "lang",
        F.struct(F.transform("urls", lambda u: F.struct(u.alias("expanded_url"))).alias("urls"), F.transform("hashtags", lambda h: F.struct(h.alias("text"))).alias("hashtags"), F.transform("mentions", lambda m: F.struct(m.alias("screen_name"))).alias("user_mentions")).alias("entities"),
        F.struct(F.transform("media", lambda m: F.struct(m["type"].alias("type"), m["url"].alias("url"), m["media_url"].alias("media_url_https"), F.struct(m["width"].alias("width"), m["height"].alias("height")).alias("original_info"))).alias("media")).alias("extended_entities"),
        F.when(c("is_retweet"), F.struct(F.lit("x").alias("rest_id"))).alias("retweeted_status_result"),
        F.col("conversation_id").alias("conversation_id_str"),
    )
    user = F.struct(c("author.id").alias("rest_id"), F.struct(F.when(c("author.verified"), c("author.screen_name")).alias("screen_name"), c("author.name").alias("name")).alias("core"), F.struct(c("author.screen_name").alias("screen_name"), c("author.followers_count").alias("followers_count")).alias("legacy"))
    result = F.struct(c("id").alias("rest_id"), legacy.alias("legacy"), F.struct(F.struct(user.alias("result")).alias("user_results")).alias("core"), F.struct(c("view_count").cast("string").alias("count")).alias("views"), F.when(c("is_quote"), F.struct(F.lit("x").alias("rest_id"))).alias("quoted_status_result"))
    item = F.struct(F.struct(F.lit("TimelineTimelineItem").alias("entryType"), F.struct(F.struct(result.alias("result")).alias("tweet_results")).alias("itemContent")).alias("content"))
    place = F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint"), F.lit(pages))
    entries = t.select(F.format_string("%012d", place).alias("page"), F.to_json(item).alias("e")).groupBy("page").agg(F.concat_ws(",", F.array_sort(F.collect_list("e"))).alias("e"))
    cursor = F.concat(F.lit('{"content":{"entryType":"TimelineTimelineCursor","cursorType":"Top","value":"t"}},{"content":{"entryType":"TimelineTimelineCursor","cursorType":"Bottom","value":"after-'), F.col("page"), F.lit('"}}'))
    whole = F.concat(F.lit('{"data":{"user":{"result":{"timeline":{"timeline":{"instructions":[{"type":"Other"},{"type":"TimelineAddEntries","entries":['), F.col("e"), F.lit(","), cursor, F.lit("]}]}}}}}}"))
    return entries.select("page", whole.alias("json"))


@registered("""SELECT id, coalesce(text, '') AS text, coalesce(author.id, '') AS user_id, coalesce(author.screen_name, '') AS screen_name, coalesce(author.name, '') AS name, coalesce(author.followers_count, 0) AS followers_count, coalesce(favorite_count, 0) AS favorite_count,
  coalesce(view_count, 0) AS view_count, coalesce(lang, 'en') AS lang, coalesce(is_retweet, false) AS is_retweet, coalesce(is_quote, false) AS is_quote, coalesce(array_to_string(urls, ' '), '') AS urls, coalesce(array_to_string(hashtags, ' '), '') AS hashtags,
  coalesce(len(media), 0) AS media, conversation_id FROM tweets WHERE id IS NOT NULL""")
def pages_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The posts of pages of an interface."""
    got = archive.page_posts(_pages(spark, d))
    return got.select("id", "text", F.col("user.id").alias("user_id"), F.col("user.screen_name").alias("screen_name"), F.col("user.name").alias("name"), F.col("user.followers_count").alias("followers_count"), "favorite_count", "view_count", "lang", "is_retweet", "is_quote", F.array_join("urls", " ").alias("urls"), F.array_join("hashtags", " ").alias("hashtags"), F.size("media").alias("media"), "conversation_id")


@registered("""WITH t AS (SELECT id FROM tweets WHERE id IS NOT NULL), n AS (SELECT greatest(1, count(*) // 20) AS pages FROM t), p AS (SELECT DISTINCT printf('%012d', CAST('0x' || substr(md5(id), 1, 6) AS BIGINT) % pages) AS page FROM t, n) SELECT page, 'after-' || page AS cursor FROM p""")
def page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """The cursor to the next page of each page."""
    return archive.page_cursors(_pages(spark, d))


@registered("SELECT lang, count(*) AS posts FROM (SELECT id, any_value(coalesce(lang, 'en')) AS lang FROM tweets WHERE id IS NOT NULL GROUP BY id) GROUP BY lang")
def stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """Posts of each label from a stream of saved pages, each id once."""
    home = scratch(spark, "paged")

    def save(part) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(f"{home}/pages")
        system.create_dir(at)
        for r in part:
            with system.open_output_stream(f"{at}/{r.page}.json") as out:
                out.write(r.json.encode())

    _pages(spark, d).foreachPartition(save)
    ingest.new_posts(ingest.read_pages(spark, f"{home}/pages"), f"{home}/posts", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/posts").groupBy("lang").agg(F.count("*").alias("posts"))


@registered("""WITH c AS (SELECT o_orderpriority AS name, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1)
SELECT name, value, (SELECT count(*) FROM c WHERE name = '1-URGENT') = 0 AS missing FROM c""")
def cookie_values(spark: SparkSession, d: str) -> DataFrame:
    """Named values of a list in which the last of a name counts, and whether a required one is missing."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("value"))
    got = archive.cookies(rows, ("1-URGENT",))
    return got.select(F.explode("cookies").alias("name", "value"), (F.size("missing") > 0).alias("missing"))


_CACHE = """pages AS (SELECT doc_id, 'https://pages.example/' || CAST(doc_id % 500 AS VARCHAR) AS url, epoch(fetched_at) AS ts, source FROM documents WHERE kind = 'url' AND fetched_at IS NOT NULL)"""


@registered(f"""WITH {_CACHE}, fresh AS (SELECT * FROM pages WHERE epoch(TIMESTAMP '2026-01-01') - ts <= 400 * 86400)
SELECT sha256(url) AS url_key, url, max(ts) AS fetched_at FROM fresh GROUP BY url""")
def url_cache(spark: SparkSession, d: str) -> DataFrame:
    """Saved pages that are not too old, the newest of each address."""
    docs = table(spark, d, "documents").where("kind = 'url' AND fetched_at IS NOT NULL")
    url = F.concat(F.lit("https://pages.example/"), (F.col("doc_id") % 500).cast("string"))
    at = F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1e6
    pages = docs.select(F.sha2(url, 256).alias("url_key"), url.alias("url"), url.alias("final_url"), F.lit("text/html").alias("content_type"), F.lit("").alias("sanitized_markdown"), at.alias("fetched_at"))
    return archive.cached(pages, pages.select("url"), F.unix_timestamp(F.lit("2026-01-01 00:00:00")), 400).select("url_key", "url", "fetched_at")


@registered(f"""WITH {_CACHE}, marked AS (SELECT url, ts >= epoch(TIMESTAMP '2025-01-01') AS is_new FROM pages), new AS (SELECT DISTINCT url FROM marked WHERE is_new)
SELECT url, is_new, count(*) AS rows FROM marked WHERE is_new OR url NOT IN (SELECT url FROM new) GROUP BY ALL""")
def url_cache_put(spark: SparkSession, d: str) -> DataFrame:
    """A cache with new pages in the place of old ones."""
    docs = table(spark, d, "documents").where("kind = 'url' AND fetched_at IS NOT NULL")
    url = F.concat(F.lit("https://pages.example/"), (F.col("doc_id") % 500).cast("string"))
    rows = docs.select(F.sha2(url, 256).alias("url_key"), url.alias("url"), (F.col("fetched_at") >= F.lit("2025-01-01").cast("timestamp_ntz")).alias("is_new"))
    return archive.put_pages(rows.where("NOT is_new"), rows.where("is_new").drop("url_key")).groupBy("url", "is_new").agg(F.count("*").alias("rows"))


_MEDIA_URL = r"""CASE WHEN m.type = 'photo' AND m.media_url <> '' THEN CASE WHEN regexp_replace(m.media_url, '\?.*$', '') LIKE '%:orig' THEN regexp_replace(m.media_url, '\?.*$', '') ELSE regexp_replace(m.media_url, '\?.*$', '') || '?format=jpg&name=orig' END
  WHEN m.media_url <> '' THEN m.media_url WHEN m.url <> '' THEN m.url END"""


@registered(f"""WITH {O._POSTS}, m AS (SELECT id AS tweet_id, generate_subscripts(media, 1) - 1 AS pos, unnest(media) AS m FROM posts)
SELECT tweet_id, pos, m.type AS type, {_MEDIA_URL} AS url FROM m WHERE coalesce(m.local_path, '') = '' AND {_MEDIA_URL} IS NOT NULL""")
def media_missing(spark: SparkSession, d: str) -> DataFrame:
    """Media of which there is no file, and where to get them; files are known by their names."""
    posts = materialize(_posts(spark, d), "posts")
    m = posts.select("id", F.posexplode("media").alias("pos", "m")).where("m.local_path <> ''")
    files = archive.media_names(m.select(F.concat(F.lit("/media/"), "id", F.lit("_"), F.col("pos").cast("string"), F.lit(".jpg")).alias("path")))
    return archive.media_to_fetch(posts, files)


@registered(f"WITH {O._USABLE} SELECT id, len(v) AS dims, round(v[1], 5) AS first FROM usable")
def corpus_reopened(spark: SparkSession, d: str) -> DataFrame:
    """A corpus of vectors that is built and saved when it is first opened, and read when it is opened again."""
    rows = materialize(dense.usable(table(spark, d, "corpus_embeddings").where("model_name = 'arch-embed-2'"), "tweet_id", "vector", 96, "row_idx"), "rows")
    path = scratch(spark, "corpus")
    sinks.open_or_build_corpus(rows.select("id"), path, "arch-embed-2", 96, lambda posts: rows.join(posts, "id", "left_semi"))

    def refused(_):
        raise RuntimeError("a saved corpus is not built again")

    got = sinks.open_or_build_corpus(rows.select("id"), path, "arch-embed-2", 96, refused)
    return got.select("id", F.size("v").alias("dims"), F.round(F.col("v")[0].cast("double"), 5).alias("first"))


@registered(f"""WITH {O._POSTS}, t AS (SELECT id, length(CASE WHEN trim(text) <> '' THEN text ELSE ' ' END) AS n FROM posts) SELECT id, round(n / sqrt(n * n + 1.0), 5) AS a, round(1 / sqrt(n * n + 1.0), 5) AS b FROM t""")
def embedded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of texts from a call that takes batches of 32; here of the text's length."""

    def call(texts: list[str]) -> list[list[float]]:
        if len(texts) > 32:
            raise ValueError("too many texts at once")
        return [[float(len(t)), 1.0] for t in texts]

    got = dense.embed(_posts(spark, d), "id", "text", call)
    return got.select("id", F.round(F.col("v")[0].cast("double"), 5).alias("a"), F.round(F.col("v")[1].cast("double"), 5).alias("b"))


@registered("SELECT query_text AS query, 'context ' || query_id AS fenced_context_raw, '{\"n\":' || query_id || '}' AS expected_outputs FROM search_queries WHERE query_text IS NOT NULL AND query_id % 3 <> 0")
def demos_valid(spark: SparkSession, d: str) -> DataFrame:
    """Labelled examples that have all they must have."""
    q = table(spark, d, "search_queries")
    outputs = F.when(F.col("query_id") % 3 != 0, F.struct(F.col("query_id").alias("n")))
    return archive.demos(q.select(F.to_json(F.struct(F.col("query_text").alias("query"), F.concat(F.lit("context "), F.col("query_id").cast("string")).alias("fenced_context_raw"), outputs.alias("expected_outputs"))).alias("value")))


@registered("WITH a AS (SELECT count(*) AS n FROM documents WHERE kind = 'month'), b AS (SELECT count(*) AS n FROM documents) SELECT s AS opened, CASE s WHEN 3 THEN b.n ELSE a.n END AS rows FROM a, b, (SELECT unnest([1, 2, 3]) AS s)")
def table_kept(spark: SparkSession, d: str) -> DataFrame:
    """A saved table is read while its stamp stands, and built anew when that changes."""
    docs, path = table(spark, d, "documents").select("doc_id", "kind"), scratch(spark, "kept")
    opened = [archive.kept_table(spark, path, stamp, lambda df=df: df) for stamp, df in (("a", docs.where("kind = 'month'")), ("a", docs), ("b", docs))]
    out = None
    for i, t in enumerate(opened, 1):
        part = t.groupBy().agg(F.count("*").alias("rows")).select(F.lit(i).alias("opened"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@registered("SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN greatest(event_id % 900 - event_id % 700, 0) + 5 ELSE 0 END AS seconds FROM events")
def rate_waits(spark: SparkSession, d: str) -> DataFrame:
    """How long to wait for an interface, by the calls it still allows."""
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", archive.wait_seconds(e % 4, e % 900, e % 700).alias("seconds"))
