"""Registered queries of text rules, addresses and hits as shown, with SQL that gives the same rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text, vectors
from tidemark.operators import network, search, validation
from tidemark.operators import posts as P
from tidemark.plans import oracle as O
from tidemark.sources import archive, sinks
from tidemark.storage import table

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


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _compatible() -> str:
    """SQL map of the characters with a compatibility decomposition to that, from Python's Unicode data."""
    got = {}
    for cp in (*range(0xA0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(cp)
        if unicodedata.normalize("NFKD", ch) != unicodedata.normalize("NFD", ch):
            got[ch] = unicodedata.normalize("NFKD", ch)
    return f"MAP([{', '.join(map(quoted, got))}], [{', '.join(map(quoted, got.values()))}])"


#: Common table of SQL with the map, read once.
COMPAT = f"compat AS MATERIALIZED (SELECT {_compatible()} AS compat_map)"
_ANSI = r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-_])"
_CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]"
_FORMAT = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]"


def clean(x: str) -> str:
    """SQL of sanitised text; the statement needs COMPAT, and compat among its sources."""
    x = f"coalesce({x}, '')"
    nfkc = rf"CASE WHEN regexp_full_match({x}, '[\x00-\x7F]*') THEN {x} ELSE nfc_normalize(array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN c < chr(160) THEN c ELSE coalesce(compat_map[c], c) END), '')) END"
    for p in (_ANSI, _CONTROL, _FORMAT):
        nfkc = f"regexp_replace({nfkc}, '{p}', '', 'g')"
    return nfkc


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{O._WS}+|{O._WS}+$', '', 'g')"


def neutral(x: str) -> str:
    # The markers of fences and what stands in their place
    for family in ("TWEET_BODY", "URL", "URL_BODY", "ENTITY", "KG_NODE", "KG_EDGE"):
        for m in (f"<<<{family}>>>", f"<<<END_{family}>>>"):
            x = f"replace({x}, '{m}', '[FENCE]')"
    return x


def fence(x: str, marker: str, lines: bool) -> str:
    nl = " || chr(10) || " if lines else " || "
    return f"'<<<{marker}>>>'{nl}{neutral(x)}{nl}'<<<END_{marker}>>>'"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{O._WS}+', ' ', 'g'))"


@registered(f"""WITH {COMPAT}, raw AS (SELECT DISTINCT id, text, author.name AS name, author.screen_name AS handle, urls[1] AS url FROM tweets),
c AS MATERIALIZED (SELECT id, {clean('text')} AS text, {clean('name')} AS name, {clean('handle')} AS handle, CASE WHEN url IS NOT NULL THEN {trimmed(clean('url'))} END AS url FROM raw, compat)
SELECT id, text, name, {fence('text', 'TWEET_BODY', True)} AS tweet, {fence('text', 'URL_BODY', True)} AS url_body, CASE WHEN regexp_matches(lower(url), '^https?://') THEN {fence('url', 'URL', False)} END AS url,
CASE WHEN {trimmed('name')} <> '' THEN {fence(trimmed('name'), 'ENTITY', False)} END AS entity, {fence('handle', 'KG_NODE', False)} AS node, {fence('name', 'KG_EDGE', False)} AS edge FROM c""")
def text_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Posts' texts and names as they are shown, and between the markers of all families."""
    t = table(spark, d, "tweets").select("id", "text", F.col("author.name").alias("name"), F.col("author.screen_name").alias("handle"), F.try_element_at("urls", F.lit(1)).alias("url")).distinct()
    c = F.col
    return t.select("id", text.sanitized(c("text")).alias("text"), text.sanitized(c("name")).alias("name"), text.fenced(c("text"), "tweet").alias("tweet"), text.fenced(c("text"), "url_body").alias("url_body"), text.fenced(c("url"), "url").alias("url"), text.fenced(c("name"), "entity").alias("entity"), text.fenced(c("handle"), "kg_node").alias("node"), text.fenced(c("name"), "kg_edge").alias("edge"))


@registered("""SELECT doc_id, CASE WHEN strlen(text) <= 1024 THEN text ELSE (SELECT substring(text, 1, max(n)) FROM (SELECT unnest(range(250, 1025)) AS n) WHERE strlen(substring(text, 1, n)) <= 1024) END AS cut FROM documents""")
def byte_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of at most 1,024 bytes, never half a character."""
    return table(spark, d, "documents").select("doc_id", text.byte_cut(F.col("text"), 1024).alias("cut"))


_BARE = flat(f"regexp_replace({clean('text')}, 'https?://t[.]co/[^[:space:]]+', '', 'g')")


@registered(f"""WITH {COMPAT}, {O._POSTS}, u AS (SELECT id, {_BARE} AS bare, list_filter(list_transform(coalesce(urls, []), lambda x: trim(x)), lambda x: regexp_matches(lower(x), '^https?://')) AS safe, list_filter(coalesce(urls, []), lambda x: trim(x) <> '') AS raw FROM posts, compat),
j AS (SELECT id, bare, array_to_string(list_distinct_in_order, ' ') AS once, array_to_string(safe, ' ') AS every, raw FROM (SELECT *, list_filter(safe, lambda x, i: list_position(safe, x) = i) AS list_distinct_in_order FROM u))
SELECT id, CASE WHEN once = '' THEN bare WHEN bare = '' THEN once ELSE bare || '  ' || once END AS once, CASE WHEN every = '' THEN bare WHEN bare = '' THEN every ELSE bare || '  ' || every END AS every,
array_to_string(list_filter(list_concat([bare], raw), lambda x: x <> ''), ' ') AS raw FROM j""")
def links_shown(spark: SparkSession, d: str) -> DataFrame:
    """Texts without short links and with their addresses: each once, every one, and as they are."""
    p = _posts(spark, d)
    body, urls = F.coalesce(F.col("text"), F.lit("")), F.coalesce("urls", F.array().cast("array<string>"))
    return p.select("id", text.expanded_links(body, urls).alias("once"), text.expanded_links(body, urls, distinct=False).alias("every"), text.with_raw_links(body, urls).alias("raw"))


@registered(f"WITH {COMPAT}, v AS (SELECT id, v FROM (SELECT id, unnest(list_concat(coalesce(urls, []), [text, author.profile_image_url])) AS v FROM tweets)), c AS (SELECT id, v, {trimmed(clean('v'))} AS c FROM v, compat WHERE v IS NOT NULL) SELECT DISTINCT id, v, CASE WHEN regexp_matches(lower(c), '^https?://') THEN c END AS safe FROM c")
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    """Which values are addresses that may be shown."""
    every = F.concat(F.coalesce("urls", F.array().cast("array<string>")), F.array("text", "author.profile_image_url"))
    return table(spark, d, "tweets").select("id", F.explode(every).alias("v")).where("v IS NOT NULL").distinct().select("id", "v", text.safe_http_url(F.col("v")).alias("safe"))


def label(x: str) -> str:
    return f"""coalesce(nullif(trim(regexp_replace(regexp_replace({clean(x)}, '[()\\[\\]{{}}"/@:]', '', 'g'), '{O._WS}+', ' ', 'g')), ''), 'unnamed')"""


@registered(f"WITH {COMPAT}, n AS (SELECT DISTINCT author.id AS author_id, author.name AS name FROM tweets) SELECT author_id, name, {label('name')} AS label FROM n, compat")
def mindmap_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names without the signs that end a node of a mind map."""
    n = table(spark, d, "tweets").select(F.col("author.id").alias("author_id"), F.col("author.name").alias("name")).distinct()
    return n.select("author_id", "name", text.mindmap_label(F.col("name")).alias("label"))


@registered("SELECT DISTINCT m.local_path AS path, CASE WHEN starts_with(m.local_path, 'media/') THEN substr(m.local_path, 7) ELSE m.local_path END AS inside FROM (SELECT unnest(media) AS m FROM tweets) WHERE m.local_path IS NOT NULL")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of media seen from their folder."""
    m = table(spark, d, "tweets").select(F.explode("media").alias("m")).select(F.col("m.local_path").alias("path")).where("path IS NOT NULL").distinct()
    return m.select("path", text.relative_path(F.col("path"), "media").alias("inside"))


# addresses made of order keys, and some at the borders of networks
_EDGES = ("0.0.0.0", "0.0.0.1", "10.255.255.255", "11.0.0.0", "127.0.0.1", "128.0.0.1", "169.254.169.254", "169.254.1.1", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.9", "192.0.0.192", "192.0.2.7", "192.167.255.255", "192.168.0.0", "192.169.0.0", "198.18.0.1", "198.20.0.0", "198.51.100.4", "203.0.113.255", "203.0.114.0", "100.64.0.1", "223.255.255.255", "224.0.0.0", "240.0.0.1", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "x", "")
_MADE = "(o_orderkey * 2654435761 + 12345) % 4294967296"
_IPS = f"""ips AS (SELECT o_orderkey AS k, concat_ws('.', n // 16777216, (n // 65536) % 256, (n // 256) % 256, n % 256) AS ip FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 167772160 + o_orderkey WHEN o_orderkey % 7 = 0 THEN 3232235520 + o_orderkey % 70000 ELSE {_MADE} END AS n FROM orders)
UNION ALL SELECT -i, [{', '.join(map(quoted, _EDGES))}][i] FROM range(1, {len(_EDGES) + 1}) r(i))"""


def _ips(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey").cast("decimal(38,0)")
    n = F.when(o % 5 == 0, o + 167772160).when(o % 7 == 0, o % 70000 + 3232235520).otherwise((o * 2654435761 + 12345) % 4294967296).cast("bigint")
    quad = F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    edges = spark.createDataFrame([(-i, ip) for i, ip in enumerate(_EDGES, 1)], "k bigint, ip string")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), quad.alias("ip")).unionByName(edges)


def _verdict(ip: str) -> str:
    """SQL of an IPv4 address's verdict, by its parts."""
    p = [f"TRY_CAST(split_part({ip}, '.', {i}) AS INT)" for i in range(1, 5)]
    a, b, c, e = p
    good = f"regexp_full_match({ip}, '((0|[1-9][0-9]{{0,2}})[.]){{3}}(0|[1-9][0-9]{{0,2}})') AND greatest({', '.join(p)}) <= 255"
    return f"""CASE WHEN NOT coalesce({good}, false) THEN 'never' WHEN {ip} IN ('0.0.0.0', '169.254.169.254', '192.0.0.192') OR {a} = 127 OR {a} >= 224 THEN 'never'
  WHEN {a} IN (0, 10) OR {a} = 169 AND {b} = 254 OR {a} = 172 AND {b} BETWEEN 16 AND 31 OR {a} = 192 AND {b} = 168 OR {a} = 198 AND {b} IN (18, 19) OR {a} = 192 AND {b} = 0 AND {c} = 2 OR {a} = 198 AND {b} = 51 AND {c} = 100
  OR {a} = 203 AND {b} = 0 AND {c} = 113 OR {a} = 192 AND {b} = 0 AND {c} = 0 AND {e} NOT IN (9, 10) THEN 'private' ELSE 'open' END"""


@registered(f"WITH {_IPS} SELECT k, ip, {_verdict('ip')} AS verdict FROM ips")
def address_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which addresses may be connected to."""
    return _ips(spark, d).select("k", "ip", network.address_verdict(F.col("ip")).alias("verdict"))


@registered(f"""WITH {_IPS}, judged AS (SELECT k, k % 100 AS host, {_verdict('ip')} AS v FROM ips WHERE k > 0), chains AS (SELECT k // 10 AS chain, count(*) AS n, count_if(v <> 'open') AS bad FROM judged WHERE k % 10 < 4 + (k // 10) % 3 GROUP BY 1)
SELECT chain, n BETWEEN 1 AND 4 AND bad = 0 AND chain % 4 <> 3 AS allowed FROM chains""")
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    """Which chains of redirects may be followed: short, with open addresses, to a readable type."""
    ips = _ips(spark, d).where("k > 0").withColumn("chain", F.expr("k div 10")).where("k % 10 < 4 + chain % 3")
    chains = ips.groupBy("chain").agg(F.collect_list("ip").alias("hops")).withColumn("type", F.when(F.col("chain") % 4 == 3, "image/png").otherwise("Text/HTML; charset=utf-8"))
    return network.chain_allowed(chains, "chain", "hops", "type")


@registered(f"""WITH {_IPS}, good AS (SELECT 'h' || k // 8 || '.example' AS host, arg_min(ip, k) AS ip FROM ips WHERE k > 0 AND {_verdict('ip')} = 'open' GROUP BY 1)
SELECT 'https://u@H' || o_orderkey // 8 || '.example:8/p' AS url, host, ip FROM orders JOIN good ON host = 'h' || o_orderkey // 8 || '.example' WHERE o_orderkey % 8 = 1""")
def hosts_pinned(spark: SparkSession, d: str) -> DataFrame:
    """Each address's host with the first address of it that is open."""
    host = lambda k, h: F.concat(F.lit(h), F.expr(f"{k} div 8").cast("string"), F.lit(".example"))
    resolved = _ips(spark, d).where("k > 0").select(host("k", "h").alias("host"), "ip", F.col("k").alias("place"))
    urls = table(spark, d, "orders").where("o_orderkey % 8 = 1").select(F.concat(F.lit("https://u@"), host("o_orderkey", "H"), F.lit(":8/p")).alias("url"))
    return network.pinned(urls, resolved)


@registered("""SELECT query_id, CASE WHEN coalesce(trim(query_text), '') = '' THEN 'query' WHEN year_filter IS NOT NULL AND year_filter NOT BETWEEN 2006 AND 9999 THEN 'year' WHEN month_start IS NOT NULL AND NOT regexp_full_match(month_start, '0[1-9]|1[0-2]') THEN 'month_start'
  WHEN month_end IS NOT NULL AND NOT regexp_full_match(month_end, '0[1-9]|1[0-2]') THEN 'month_end' WHEN month_end IS NOT NULL AND month_start IS NULL OR month_start IS NOT NULL AND year_filter IS NULL OR month_end < month_start THEN 'filter'
  WHEN ['brief', 'synthesis', 'trend', 'poem'][query_id % 4 + 1] = 'poem' THEN 'report_shape' WHEN query_id % 3 = 0 THEN 'hops' END AS wrong FROM search_queries""")
def query_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each query's input, if anything is."""
    q = table(spark, d, "search_queries")
    shape = F.element_at(F.array(*map(F.lit, ("brief", "synthesis", "trend", "poem"))), (F.col("query_id") % 4 + 1).cast("int"))
    return q.select("query_id", validation.wrong(F.col("query_text"), F.col("year_filter"), F.col("month_start"), F.col("month_end"), shape, (F.col("query_id") % 3).cast("int")).alias("wrong"))


def _safe_list(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []), lambda u: trim(u)), lambda u: regexp_matches(lower(u), '^https?://'))"


_STATUS_OF = "CASE WHEN regexp_full_match(coalesce({id}, ''), '[0-9]+') THEN 'https://x.com/' || CASE WHEN regexp_full_match(coalesce({handle}, ''), '[A-Za-z0-9_]{{1,15}}') THEN {handle} ELSE 'i' END || '/status/' || {id} ELSE '' END"
_TREE = r"""parts AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, string_split(chr(10) || text, chr(10) || '### ') AS p FROM documents WHERE text IS NOT NULL AND kind = 'month')),
s AS (SELECT doc_id, k, '### ' || s || CASE WHEN k < max(k) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS s FROM parts WHERE k > 1),
tree AS (SELECT doc_id, k, regexp_extract(s, 'https?://x[.]example/([^/\s)]*)/status/([0-9]+)', 2) AS tweet_id,
  CASE WHEN regexp_extract(s, '^###\s+\[@([^\]\n]+)\]\(', 1) <> '' THEN regexp_extract(s, '^###\s+\[@([^\]\n]+)\]\(', 1) WHEN regexp_extract(s, '^###\s+@([A-Za-z0-9_]+)', 1) <> '' THEN regexp_extract(s, '^###\s+@([A-Za-z0-9_]+)', 1)
  ELSE regexp_extract(s, 'https?://x[.]example/([^/\s)]*)/status/([0-9]+)', 1) END AS handle,
  regexp_replace(regexp_replace(regexp_replace(s, '^[^\n]*\n?', ''), '(?m)^[ \t]*🔗[ \t]*\[View on X\]\(.*\)[ \t]*$\n?', '', 'g'), '^\n+|\n+$', '', 'g') AS text, regexp_replace(s, '\n+$', '') AS raw_section
  FROM s WHERE regexp_matches(s, 'https?://x[.]example/([^/\s)]*)/status/([0-9]+)'))"""


@registered(f"WITH {_TREE} SELECT doc_id, tweet_id, handle, text, raw_section FROM tree")
def month_tree(spark: SparkSession, d: str) -> DataFrame:
    """The sections of Markdown by month: posts, authors and bodies."""
    files = table(spark, d, "documents").where("text IS NOT NULL AND kind = 'month'").select(F.col("doc_id").alias("year_month"), F.col("text").alias("markdown"))
    return archive.sections(files, ("x.example",)).select(F.col("year_month").alias("doc_id"), "tweet_id", "handle", "text", "raw_section")


_HITS = "hits AS (SELECT query_id, tweet_id AS id, max(score) AS score, max(walker_relevance) AS relevance FROM scored_hits WHERE tweet_id IS NOT NULL AND coalesce(CAST(score AS VARCHAR), '') <> 'nan' AND coalesce(CAST(walker_relevance AS VARCHAR), '') <> 'nan' GROUP BY query_id, tweet_id)"
_RANKED = f"{_HITS}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rnk FROM hits)"


def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, score, relevance, rnk): each query's hits by score."""
    h = table(spark, d, "scored_hits").where("tweet_id IS NOT NULL AND NOT isnan(score) AND NOT isnan(walker_relevance)")
    hits = h.groupBy("query_id", F.col("tweet_id").alias("id")).agg(F.max("score").alias("score"), F.max("walker_relevance").alias("relevance"))
    return hits.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


@registered(f"""WITH {COMPAT}, {O._POSTS}, {_RANKED}, {_TREE}, t AS (SELECT tweet_id, any_value(year) AS year, min(handle) AS handle, min(text) AS text FROM (SELECT tweet_id, 'x' AS year, handle, text FROM tree) GROUP BY tweet_id HAVING count(DISTINCT handle || text) = 1),
b AS (SELECT r.query_id, r.rnk, r.id, coalesce({O._month('p.created_at')}, CASE WHEN t.tweet_id IS NOT NULL THEN 'filed' END, 'unknown') AS year_month, {clean('CASE WHEN p.id IS NOT NULL THEN p.author.screen_name ELSE t.handle END')} AS handle,
  {clean('substring(CASE WHEN p.id IS NOT NULL THEN p.text ELSE t.text END, 1, 240)')} AS snippet, array_to_string(list_transform({_safe_list('p.urls')}, lambda u: '<<<URL>>>' || u || '<<<END_URL>>>'), ' ') AS urls, r.score, greatest(0.0, least(1.0, r.relevance)) AS walker_relevance
  FROM ranked r LEFT JOIN posts p ON p.id = r.id LEFT JOIN t ON t.tweet_id = r.id CROSS JOIN compat)
SELECT query_id, rnk, id AS tweet_id, year_month, handle, {_STATUS_OF.format(id='id', handle='handle')} AS tweet_url, snippet, coalesce(urls, '') AS urls, score, walker_relevance FROM b""")
def hits_shaped(spark: SparkSession, d: str) -> DataFrame:
    """Hits as they are shown; posts the archive lacks fall back to their Markdown section where that is definite."""
    files = table(spark, d, "documents").where("text IS NOT NULL AND kind = 'month'").select(F.col("doc_id").alias("year_month"), F.col("text").alias("markdown"))
    found = archive.sections(files, ("x.example",)).groupBy("tweet_id").agg(F.min("handle").alias("handle"), F.min("text").alias("text"), F.count_distinct(F.concat("handle", "text")).alias("n"))
    tree = found.where("n = 1").select("tweet_id", F.lit("filed").alias("year_month"), "handle", "text")
    ranked = ranked_hits(spark, d).withColumnRenamed("relevance", "walker_relevance").withColumn("feature_breakdown", F.lit(None).cast("map<string,double>"))
    return search.shaped(ranked, _posts(spark, d), tree).select("query_id", "rnk", "tweet_id", "year_month", "handle", "tweet_url", "snippet", F.coalesce(F.array_join("urls", " "), F.lit("")).alias("urls"), "score", "walker_relevance")


@registered(f"""WITH {COMPAT}, {O._POSTS}, {_RANKED}, s AS (SELECT r.query_id, r.rnk, r.id, r.score, p.author.screen_name AS handle, {_BARE} AS bare, array_to_string({_safe_list('p.urls')}, ' ') AS every FROM ranked r LEFT JOIN posts p ON p.id = r.id CROSS JOIN compat)
SELECT query_id, rnk, rnk || '. @' || coalesce(handle, '') || ' ' || {_STATUS_OF.format(id='id', handle='handle')} || ' [' || coalesce(printf('%.3f', score), '-') || ']' || chr(10) || '   ' || CASE WHEN coalesce(every, '') = '' THEN bare WHEN bare = '' THEN every ELSE bare || '  ' || every END AS line FROM s""")
def hits_text(spark: SparkSession, d: str) -> DataFrame:
    """Hits as lines to read."""
    return sinks.hits_as_text(ranked_hits(spark, d), _posts(spark, d))


@registered(f"""WITH {COMPAT}, {O._POSTS}, b AS (SELECT id, {clean('author.screen_name')} AS handle, {clean('author.name')} AS name, {clean('text')} AS text, created_at, {O._STATUS} AS url, view_count, favorite_count, retweet_count FROM posts, compat)
SELECT id, array_to_string(list_filter(['tweet_id=' || nullif(id, '0'), 'handle=' || nullif(nullif(handle, ''), '0'), 'display_name=' || nullif(nullif(name, ''), '0'), 'text=' || nullif(nullif(text, ''), '0'), 'created_at=' || nullif(created_at, ''), 'url=' || nullif(url, ''),
  'view_count=' || nullif(view_count, 0), 'like_count=' || nullif(favorite_count, 0), 'retweet_count=' || nullif(retweet_count, 0)], lambda x: x IS NOT NULL), '|') AS shown FROM b""")
def posts_read(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of each post when it is looked up: filled fields only."""
    fields = ("tweet_id", "handle", "display_name", "text", "created_at", "url", "view_count", "like_count", "retweet_count")
    got = _posts(spark, d).select("id", F.from_json(P.post_json(), ", ".join(f"{f} string" for f in fields)).alias("p"))
    return got.select("id", F.concat_ws("|", *[F.when(F.col(f"p.{f}").isNotNull(), F.concat(F.lit(f"{f}="), F.col(f"p.{f}"))) for f in fields]).alias("shown"))


@registered(f"WITH {O._USABLE} SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(v[96] / sqrt(list_dot_product(v, v)), 9) AS last FROM usable")
def vectors_unit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of unit length."""
    from tidemark.operators import dense

    rows = dense.usable(table(spark, d, "corpus_embeddings").where("model_name = 'arch-embed-2'"), "tweet_id", "vector", 96, "row_idx")
    u = rows.select("id", vectors.normalized(F.col("v")).alias("u"))
    return u.select("id", F.round(F.col("u")[0], 9).alias("first"), F.round(F.col("u")[95], 9).alias("last"))
