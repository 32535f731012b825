"""SQL with the same rows as the queries of the core, for DuckDB over the same tables.

NaN is asked for by its text: isnan is folded away where a file's statistics,
which leave NaN out, say that there is none.
"""

from __future__ import annotations

from tidemark.operators.entities import STOPWORDS

#: Unicode white space, which RE2's \s leaves out.
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
_DATE = "(Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z]{2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4} [0-9]{4}"

_POSTS = """posts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, view_count DESC NULLS LAST,
  favorite_count DESC NULLS LAST, retweet_count DESC NULLS LAST, reply_count DESC NULLS LAST, quote_count DESC NULLS LAST, created_at DESC NULLS LAST, text DESC NULLS LAST) AS _rn
  FROM tweets WHERE id IS NOT NULL) WHERE _rn = 1)"""


def _wall(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{_DATE}') THEN try_strptime(regexp_replace(substr({c}, 5), '[+-][0-9]{{4}} ', ''), '%b %d %H:%M:%S %Y') END"


def _time(c: str) -> str:
    off = f"regexp_extract({c}, '([+-][0-9]{{4}}) [0-9]{{4}}$', 1)"
    minutes = f"(CASE WHEN substr({off}, 1, 1) = '-' THEN -1 ELSE 1 END) * (TRY_CAST(substr({off}, 2, 2) AS INT) * 60 + TRY_CAST(substr({off}, 4, 2) AS INT))"
    return f"({_wall(c)} - to_minutes(CAST({minutes} AS BIGINT)))"


def _month(c: str) -> str:
    return f"strftime({_wall(c)}, '%Y-%m')"


def _tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({x}), '{_WS}+'), lambda w: regexp_replace(w, '{_EDGE}', '', 'g')), lambda w: w <> '')"


_BODY = "array_to_string(list_filter(list_concat([text], coalesce(urls, CAST([] AS VARCHAR[]))), lambda p: trim(p) <> ''), ' ')"
_STATUS = "CASE WHEN regexp_full_match(coalesce(id, ''), '[0-9]+') THEN 'https://x.com/' || CASE WHEN regexp_full_match(coalesce(author.screen_name, ''), '[A-Za-z0-9_]{1,15}') THEN author.screen_name ELSE 'i' END || '/status/' || id ELSE '' END"

#: The address an export writes: handle and id as they are.
_PLAIN_URL = "'https://x.com/' || coalesce(author.screen_name, '') || '/status/' || coalesce(id, '')"


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_INDEX = f"""{_POSTS},
words AS (SELECT id, {_tokens(_BODY)} AS w FROM posts),
sizes AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM words),
postings AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, df, ln((SELECT n FROM sizes) - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM postings GROUP BY term)),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

_QUERIES = f"""qterms AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query_text')}) AS term FROM search_queries) GROUP BY ALL),
bounds AS (SELECT query_id, year_filter, coalesce(TRY_CAST(month_start AS INT), 1) AS lo,
  CASE WHEN month_start IS NULL THEN 12 ELSE coalesce(TRY_CAST(month_end AS INT), TRY_CAST(month_start AS INT)) END AS hi, month_start, month_end FROM search_queries
  WHERE year_filter IS NOT NULL AND (month_start IS NULL OR TRY_CAST(month_start AS INT) IS NOT NULL)
  AND (month_end IS NULL OR (month_start IS NOT NULL AND TRY_CAST(month_end AS INT) IS NOT NULL))),
scope AS MATERIALIZED (SELECT query_id, printf('%d-%02d', year_filter, m) AS year_month FROM (SELECT query_id, year_filter, unnest(range(lo, hi + 1)) AS m FROM bounds
  WHERE lo BETWEEN 1 AND 12 AND hi BETWEEN 1 AND 12 AND lo <= hi)),
bound AS MATERIALIZED (SELECT query_id FROM search_queries WHERE year_filter IS NOT NULL OR month_start IS NOT NULL OR month_end IS NOT NULL),
dated AS MATERIALIZED (SELECT id, {_month('created_at')} AS year_month FROM posts),
allowed AS MATERIALIZED (SELECT query_id, id FROM dated JOIN scope USING (year_month))"""


def _within(rows: str) -> str:
    return f"(SELECT * FROM {rows} r WHERE query_id NOT IN (SELECT query_id FROM bound) OR EXISTS (SELECT 1 FROM allowed a WHERE a.query_id = r.query_id AND a.id = r.id))"


_LEXICAL = f"""found AS (SELECT q.query_id, p.id, sum(q.qtf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (1.0 - 0.75 + 0.75 * p.dl / (SELECT mean FROM sizes)))) AS score
  FROM qterms q JOIN terms t USING (term) JOIN postings p USING (term) GROUP BY ALL),
lexical AS MATERIALIZED (SELECT query_id, id, score, rnk FROM (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rnk
  FROM {_within('found')}) WHERE rnk <= 200)"""

_USABLE = """usable AS MATERIALIZED (SELECT tweet_id AS id, CAST(vector AS DOUBLE[]) AS v, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY row_idx DESC) AS _rn
  FROM corpus_embeddings WHERE model_name = 'arch-embed-2' AND tweet_id IS NOT NULL) WHERE _rn = 1 AND len(vector) = 96
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""

_DENSE = f"""{_USABLE},
units AS MATERIALIZED (SELECT id, row_idx, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM usable),
best AS MATERIALIZED (SELECT query_id, id FROM (SELECT h.query_id, u.id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, u.id) AS place FROM scored_hits h JOIN units u ON u.id = h.tweet_id WHERE h.score IS NOT NULL AND NOT (CAST(h.score AS VARCHAR) = 'nan')) WHERE place = 1),
sims AS (SELECT s.query_id, u.id, list_dot_product(q.v, u.v) AS score FROM search_queries s JOIN best b ON b.query_id = s.query_id JOIN units q ON q.id = b.id CROSS JOIN units u),
dense AS MATERIALIZED (SELECT query_id, id, score, rnk FROM (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rnk
  FROM {_within('sims')}) WHERE rnk <= 200)"""

_FUSED = """lists AS (SELECT query_id, id, 1.0 / (60 + rnk) AS part, 0 AS list, rnk FROM dense UNION ALL SELECT query_id, id, 1.0 / (60 + rnk), 1, rnk FROM lexical),
fused AS MATERIALIZED (SELECT query_id, id, fused, rnk FROM (SELECT query_id, id, round(sum(part), 12) AS fused, min(list * 1000 + rnk) AS seen,
  row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 12) DESC, min(list * 1000 + rnk), id) AS rnk FROM lists GROUP BY query_id, id) WHERE rnk <= 300)"""

_AFFINITY = "affinity AS (SELECT author.screen_name AS screen_name, count(*) AS posts, ln(1 + count(*)) AS affinity FROM tweets WHERE author.screen_name <> '' GROUP BY 1)"


def _log(c: str, w: float) -> str:
    return f"ln(1 + greatest(0, coalesce({c}, 0))) * {w}"


def _rank(hits: str, anchor: str, missing: str, top: int) -> str:
    """SQL of ranked hits (query_id, id, relevance[, ...]) joined with posts p."""
    parts = {
        "relevance": "relevance * 80.0",
        "favorite": _log("p.favorite_count", 0.5),
        "retweet": _log("p.retweet_count", 0.5),
        "reply": _log("p.reply_count", 0.3),
        "view": _log("p.view_count", 0.1),
        "affinity": "coalesce(a.affinity, 0)",
        "recency": f"CASE WHEN {_time('p.created_at')} IS NULL THEN 0.0 ELSE exp(-greatest(0.0, (epoch_us({anchor}) - epoch_us({_time('p.created_at')})) / 86400000000.0) / 180.0) * 1.5 END",
        "verified": "CASE WHEN p.author.verified THEN 0.5 ELSE 0 END",
        "media": "CASE WHEN len(p.media) > 0 THEN 0.3 ELSE 0 END",
        "coverage": f"-({missing}) * 5.0",
    }
    total = " + ".join(f"({x})" for x in parts.values())
    shown = ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {k}" for k, x in parts.items())
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, walker_relevance DESC, id) AS rnk FROM (
  SELECT h.query_id, h.id, round(CAST({total} AS DOUBLE), 6) AS score, h.relevance AS walker_relevance, {shown}
  FROM {hits} h JOIN posts p ON p.id = h.id LEFT JOIN affinity a ON a.screen_name = p.author.screen_name)) WHERE rnk <= {top}"""


_ANCHOR = "(SELECT CASE WHEN year_filter IS NULL THEN TIMESTAMP '2026-01-01 00:00:00' WHEN coalesce(TRY_CAST(coalesce(month_end, month_start) AS INT), 12) = 12 THEN make_timestamp(year_filter, 12, 31, 23, 59, 59) ELSE make_timestamp(year_filter, CAST(coalesce(month_end, month_start) AS INT) + 1, 1, 0, 0, 0) - INTERVAL 1 MICROSECOND END FROM search_queries s WHERE s.query_id = h.query_id)"

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_CAP = "(?:[A-Z][a-z]+|[A-Z]{2,})"
# letters and digits beyond ASCII become _ first, because RE2's \b knows ASCII words only
_MASKED = r"regexp_replace(t, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]', '_', 'g')"
_RUNS = f"list_transform(regexp_extract_all({_MASKED}, '\\b{_CAP}(?:{_WS}+{_CAP})*\\b'), lambda r: regexp_split_to_array(lower(r), '{_WS}+'))"
_WINDOWS = "list_filter(flatten(list_transform(" + _RUNS + ", lambda w: flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i : i + k - 1]))))), lambda x: len(list_filter(x, lambda y: NOT list_contains(" + _STOP + ", y))) > 0)"

ENTITIES = rf"""source AS (SELECT id, coalesce(text, '') AS t FROM posts),
mined AS (SELECT id, length(t) AS n, 'handle' AS kind, lower(unnest(regexp_extract_all(t, '@([A-Za-z0-9_]{{1,15}})', 1))) AS value FROM source
UNION ALL SELECT id, length(t), 'hashtag', lower(unnest(regexp_extract_all(t, '#([\p{{L}}\p{{N}}_]+)', 1))) FROM source
UNION ALL SELECT id, length(t), 'domain', regexp_replace(lower(unnest(regexp_extract_all(t, '(?i)https?://([^/\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+)', 1))), '^www\.', '') FROM source
UNION ALL SELECT id, length(t), 'concept', array_to_string(unnest({_WINDOWS}), '_') FROM source),
entities AS MATERIALIZED (SELECT id, kind, value, CAST(count(*) AS DOUBLE) AS weight FROM mined GROUP BY id, n, kind, value HAVING kind <> 'concept' OR count(*) >= CASE WHEN n < 50 THEN 1 ELSE 2 END)"""

_NODE = "CASE kind WHEN 'concept' THEN 'concept:' || regexp_replace(regexp_replace(lower(value), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') WHEN 'handle' THEN 'handle:' || lower(regexp_replace(value, '^@+', '')) WHEN 'hashtag' THEN 'hashtag:' || lower(regexp_replace(value, '^#+', '')) ELSE 'domain:' || lower(value) END"

_GRAPH = f"""{_POSTS}, {ENTITIES},
hits AS (SELECT query_id, tweet_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY max(CASE WHEN score IS NULL OR CAST(score AS VARCHAR) = 'nan' THEN CAST('-infinity' AS DOUBLE) ELSE score END) DESC, tweet_id) AS rnk FROM scored_hits WHERE tweet_id IS NOT NULL GROUP BY query_id, tweet_id),
top AS MATERIALIZED (SELECT * FROM hits WHERE rnk <= 20),
slim AS (SELECT t.query_id, t.id, t.rnk, p.author.screen_name AS handle FROM top t LEFT JOIN posts p USING (id))"""

_SHOWN = "regexp_replace(substr({c}, 5), 'x', 'x')"

SQL: dict[str, str] = {
    "posts_latest": f"WITH {_POSTS} SELECT id, text, created_at, author.id AS author_id, view_count, favorite_count, CAST(fetched_at AS VARCHAR) AS fetched_at FROM posts",
    "posts_flat": rf"""SELECT id AS tweet_id, text, strftime({_time('created_at')}, '%Y-%m-%d %H:%M:%S') AS created_at, author.id AS user_id, author.screen_name AS user_screen_name, author.name AS user_name,
  coalesce(author.verified, false) AS user_verified, coalesce(retweet_count, 0) AS retweet_count, coalesce(favorite_count, 0) AS favorite_count, coalesce(reply_count, 0) AS reply_count,
  coalesce(quote_count, 0) AS quote_count, coalesce(view_count, 0) AS view_count, lang, coalesce(is_retweet, false) AS is_retweet, coalesce(is_quote, false) AS is_quote,
  coalesce(len(media), 0) > 0 AS has_media, coalesce(len(media), 0) AS media_count, coalesce(array_to_string(list_filter(list_transform(media, lambda m: m.type), lambda x: x IS NOT NULL), ','), '') AS media_types,
  coalesce(len(urls), 0) AS url_count, coalesce(len(hashtags), 0) AS hashtag_count, coalesce(array_to_string(hashtags, ','), '') AS hashtags, coalesce(len(mentions), 0) AS mention_count, {_PLAIN_URL} AS tweet_url FROM tweets""",
    "posts_stats": "SELECT count(*) AS total, count_if(len(media) > 0) AS with_media, CAST(coalesce(sum(len(media)), 0) AS BIGINT) AS total_media, count_if(is_retweet) AS retweets, count_if(is_quote) AS quotes, count_if(author.verified) AS verified_authors, count(DISTINCT CASE WHEN author.id <> '' THEN author.id END) AS unique_authors FROM tweets",
    "month_counts": f"SELECT year_month, count(*) AS tweet_count FROM (SELECT {_month('created_at')} AS year_month FROM tweets) WHERE year_month IS NOT NULL GROUP BY 1",
    "author_affinity": f"WITH {_AFFINITY} SELECT screen_name, posts, round(affinity, 9) AS affinity FROM affinity",
    "query_terms": f"WITH {_POSTS}, {_QUERIES} SELECT query_id, term, qtf FROM qterms",
    "query_months": f"WITH {_POSTS}, {_QUERIES} SELECT query_id, year_month FROM scope",
    "bm25_terms": f"WITH {_INDEX} SELECT term, df, round(idf, 9) AS idf FROM terms",
    "search_bm25": f"WITH {_INDEX}, {_QUERIES}, {_LEXICAL} SELECT query_id, id, round(score, 6) AS score, rnk FROM lexical",
    "search_dense": f"WITH {_POSTS}, {_QUERIES}, {_DENSE} SELECT query_id, id, round(score, 6) AS score, rnk FROM dense",
    "search_fused": f"WITH {_INDEX}, {_QUERIES}, {_LEXICAL}, {_DENSE}, {_FUSED} SELECT query_id, id, round(fused, 9) AS fused, rnk FROM fused",
    "search_hybrid": f"""WITH {_INDEX}, {_QUERIES}, {_LEXICAL}, {_DENSE}, {_FUSED}, {_AFFINITY},
hits AS MATERIALIZED (SELECT f.query_id, f.id, coalesce(d.score, 0) AS relevance FROM fused f LEFT JOIN dense d USING (query_id, id)),
lacks AS MATERIALIZED (SELECT h.query_id, h.id, sum(greatest(0, coalesce(t.idf, 1.0))) AS missing FROM hits h JOIN qterms q USING (query_id) LEFT JOIN terms t ON t.term = q.term
  LEFT JOIN postings p ON p.id = h.id AND p.term = q.term WHERE p.term IS NULL GROUP BY ALL)
{_rank('hits', _ANCHOR, '(coalesce((SELECT missing FROM lacks l WHERE l.query_id = h.query_id AND l.id = h.id), 0))', 50)}""",
    "rank_hits": f"""WITH {_POSTS}, {_AFFINITY},
hits AS (SELECT query_id, tweet_id AS id, max(walker_relevance) AS relevance FROM scored_hits WHERE NOT (CAST(walker_relevance AS VARCHAR) = 'nan') GROUP BY ALL)
{_rank('hits', "TIMESTAMP '2026-01-01 00:00:00'", '0.0', 20)}""",
    "entities": f"WITH {_POSTS}, {ENTITIES} SELECT id, kind, value, weight FROM entities",
    "entities_top": f"WITH {_POSTS}, {ENTITIES} SELECT kind, value, weight, place FROM (SELECT kind, value, sum(weight) AS weight, row_number() OVER (PARTITION BY kind ORDER BY sum(weight) DESC, value) AS place FROM entities GROUP BY kind, value) WHERE place <= 50",
    "graph_nodes": f"""WITH {_GRAPH},
rows AS (SELECT query_id, 'query:root' AS id, 'query' AS kind, query_text AS label, 1.0 AS weight, 0 AS rnk, 0 AS step, '' AS name FROM search_queries
UNION ALL SELECT query_id, 'tweet:' || id, 'tweet', id, 1.0, rnk, 1, '' FROM slim
UNION ALL SELECT query_id, 'handle:' || lower(regexp_replace(handle, '^@+', '')), 'handle', handle, 1.0, rnk, 2, '' FROM slim WHERE handle <> ''
UNION ALL SELECT t.query_id, {_NODE}, kind, value, weight, rnk, CASE kind WHEN 'handle' THEN 3 WHEN 'hashtag' THEN 4 WHEN 'domain' THEN 5 ELSE 6 END, value FROM top t JOIN entities e USING (id))
SELECT query_id, id, arg_min(kind, {{'a': rnk, 'b': step, 'c': name}}) AS kind, arg_min(label, {{'a': rnk, 'b': step, 'c': name}}) AS label, CAST(sum(weight) AS DOUBLE) AS weight FROM rows GROUP BY query_id, id""",
    "graph_edges": f"""WITH {_GRAPH}
SELECT DISTINCT * FROM (SELECT query_id, 'query:root' AS src, 'tweet:' || id AS dst, 'recall_for' AS kind FROM slim
UNION ALL SELECT query_id, 'tweet:' || id, 'handle:' || lower(regexp_replace(handle, '^@+', '')), 'authored_by' FROM slim WHERE handle <> ''
UNION ALL SELECT t.query_id, 'tweet:' || id, {_NODE}, CASE kind WHEN 'domain' THEN 'cites' ELSE 'mentions' END FROM top t JOIN entities e USING (id))""",
    "month_sections": r"""WITH parts AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, string_split(chr(10) || text, chr(10) || '### ') AS p FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, '### ' || s AS s FROM parts WHERE k > 1)
SELECT doc_id, regexp_extract(s, 'https?://x[.]example/([^/\s)]*)/status/([0-9]+)', 2) AS tweet_id,
  CASE WHEN regexp_extract(s, '^###\s+\[@([^\]\n]+)\]\(', 1) <> '' THEN regexp_extract(s, '^###\s+\[@([^\]\n]+)\]\(', 1) WHEN regexp_extract(s, '^###\s+@([A-Za-z0-9_]+)', 1) <> '' THEN regexp_extract(s, '^###\s+@([A-Za-z0-9_]+)', 1)
  ELSE regexp_extract(s, 'https?://x[.]example/([^/\s)]*)/status/([0-9]+)', 1) END AS handle FROM s WHERE regexp_matches(s, 'https?://x[.]example/([^/\s)]*)/status/([0-9]+)')""",
    "text_cuts": f"""SELECT doc_id, substring(coalesce(text, ''), 1, 240) AS plain, substring(trim(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')), 1, 280) AS flat,
  CASE WHEN length(text) > 120 THEN rtrim(substring(text, 1, 119), ' ') || '…' ELSE text END AS short FROM documents""",
    "html_texts": "SELECT id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM (SELECT DISTINCT id, text FROM tweets)",
    "media_files": rf"""SELECT id AS tweet_id, pos, type, url, CASE WHEN own <> '' THEN own WHEN type = 'video' THEN '.mp4' WHEN type = 'animated_gif' THEN '.gif' ELSE '.jpg' END AS extension FROM (
  SELECT id, pos, type, url, lower(regexp_extract(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)$', 1), '[^.].*(\.[^.]*)$', 1)) AS own FROM (
  SELECT id, pos, m.type AS type, CASE WHEN m.type = 'photo' AND m.media_url <> '' THEN CASE WHEN regexp_replace(m.media_url, '\?.*$', '') LIKE '%:orig' THEN regexp_replace(m.media_url, '\?.*$', '') ELSE regexp_replace(m.media_url, '\?.*$', '') || '?format=jpg&name=orig' END
  WHEN m.media_url <> '' THEN m.media_url WHEN m.url <> '' THEN m.url END AS url FROM (SELECT id, generate_subscripts(media, 1) - 1 AS pos, unnest(media) AS m FROM tweets))) WHERE url IS NOT NULL""",
    "vector_norms": "SELECT row_idx, len(vector) AS dims, round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS norm FROM corpus_embeddings WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0",
    "resume_merge": "WITH saved AS (SELECT id, fetched_at FROM tweets WHERE fetched_at < TIMESTAMP '2025-12-01'), arrived AS (SELECT id, fetched_at FROM tweets WHERE fetched_at >= TIMESTAMP '2025-12-01') SELECT id, CAST(fetched_at AS VARCHAR) AS fetched_at FROM saved UNION ALL SELECT id, CAST(fetched_at AS VARCHAR) FROM arrived WHERE id NOT IN (SELECT id FROM saved WHERE id IS NOT NULL)",
    "posts_popular": f"WITH {_POSTS} SELECT id, favorite_count, len(media) AS media FROM posts WHERE len(media) > 0 AND favorite_count > 100 AND {_time('created_at')} > TIMESTAMP '2025-01-01'",
    "stream_languages": "SELECT lang, count(*) AS posts FROM (SELECT id, any_value(lang) AS lang FROM tweets WHERE id IS NOT NULL GROUP BY id) GROUP BY lang",
    "hits_by_month": f"WITH {_POSTS} SELECT h.query_id, coalesce({_month('p.created_at')}, 'unknown') AS year_month, count(*) AS hits FROM (SELECT DISTINCT query_id, tweet_id FROM scored_hits) h JOIN posts p ON p.id = h.tweet_id GROUP BY 1, 2",
}


# nested records: objects with the path that leads to them, which sorts as they are met
_OBJECTS = r"""RECURSIVE whole AS (SELECT record_id, CAST(payload AS JSON) AS j FROM likes_export WHERE record_id IS NOT NULL AND json_valid(payload)),
tops AS (SELECT record_id, CAST(0 AS BIGINT) AS ordinal, j AS o FROM whole WHERE json_type(j) = 'OBJECT' UNION ALL SELECT record_id, generate_subscripts(x, 1) - 1, unnest(x) FROM (SELECT record_id, json_extract(j, '$[*]') AS x FROM whole WHERE json_type(j) = 'ARRAY')),
objects AS (SELECT record_id, 'post' AS type, '' AS label, ordinal, [ordinal] AS path, o FROM tops WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT record_id, type, label, ordinal, list_concat(path, [place, ordinal]), o FROM (
  SELECT record_id, path, type, label, place, CAST(0 AS BIGINT) AS ordinal, v AS o FROM (
    SELECT p.record_id, p.path, l.type, l.label, l.place, CASE WHEN l.as_text AND json_type(p.o, '$.' || l.label) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(p.o, '$.' || l.label)) THEN CAST(json_extract_string(p.o, '$.' || l.label) AS JSON) END ELSE json_extract(p.o, '$.' || l.label) END AS v
    FROM objects p JOIN (VALUES ('post', 'media', 'media', CAST(0 AS BIGINT), false), ('post', 'user', 'user', 1, false), ('post', 'retweeted_tweet', 'post', 2, true), ('post', 'quoted_tweet', 'post', 3, true), ('user', 'legacy', 'legacy', 0, false), ('user', 'core', 'core', 1, false)) l(owner, label, type, place, as_text) ON l.owner = p.type)
  WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT record_id, path, type, label, place, generate_subscripts(x, 1) - 1, unnest(x) FROM (SELECT record_id, path, type, label, place, json_extract(v, '$[*]') AS x FROM (
    SELECT p.record_id, p.path, l.type, l.label, l.place, CASE WHEN l.as_text AND json_type(p.o, '$.' || l.label) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(p.o, '$.' || l.label)) THEN CAST(json_extract_string(p.o, '$.' || l.label) AS JSON) END ELSE json_extract(p.o, '$.' || l.label) END AS v
    FROM objects p JOIN (VALUES ('post', 'media', 'media', CAST(0 AS BIGINT), false), ('post', 'user', 'user', 1, false), ('post', 'retweeted_tweet', 'post', 2, true), ('post', 'quoted_tweet', 'post', 3, true), ('user', 'legacy', 'legacy', 0, false), ('user', 'core', 'core', 1, false)) l(owner, label, type, place, as_text) ON l.owner = p.type)
  WHERE json_type(v) = 'ARRAY')) WHERE json_type(o) = 'OBJECT'),
nodes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY path) - 1 AS node FROM objects)"""


def _s(name: str, o: str = "o.o") -> str:
    return f"CASE WHEN json_type({o}, '$.{name}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string({o}, '$.{name}') END"


def _filled(*x: str) -> str:
    return f"coalesce({', '.join(f'nullif({v}, {chr(39) * 2})' for v in x)}, '')"


_UP = "len(o.path) > 1 AND o.path[1 : len(o.path) - 2] = p.path AND p.record_id = o.record_id"
_JOINED = "CASE WHEN json_type(o.o, '$.{0}') = 'ARRAY' THEN array_to_string(json_extract_string(o.o, '$.{0}[*]'), ' ') END AS {0}"
_P5_POSTS = f"""SELECT o.record_id, o.node, p.node AS parent_node, coalesce({_s('id', 'p.o')}, '') AS parent_tweet_id, coalesce({_s('id')}, '') AS tweet_id, o.label AS relation, CAST(o.ordinal AS INT) AS ordinal, {_s('text')} AS text, {_s('created_at')} AS created_at, {_s('lang')} AS lang,
  {', '.join(f"TRY_CAST({_s(c)} AS BIGINT) AS {c}" for c in ('favorite_count', 'retweet_count', 'reply_count', 'quote_count', 'view_count'))}, TRY_CAST({_s('is_retweet')} AS BOOLEAN) AS is_retweet, TRY_CAST({_s('is_quote')} AS BOOLEAN) AS is_quote, {_s('conversation_id')} AS conversation_id, {_s('in_reply_to_user_id')} AS in_reply_to_user_id,
  {', '.join(_JOINED.format(c) for c in ('hashtags', 'urls', 'mentions'))} FROM nodes o LEFT JOIN nodes p ON {_UP} WHERE o.type = 'post'"""
_BLOCKS = "LEFT JOIN nodes c ON c.record_id = o.record_id AND c.path = list_concat(o.path, [1, 0]) AND c.type = 'core' LEFT JOIN nodes l ON l.record_id = o.record_id AND l.path = list_concat(o.path, [0, 0]) AND l.type = 'legacy'"
_NAME = _filled(_s("screen_name", "c.o"), _s("screen_name"), _s("screen_name", "l.o"))
_P5_USERS = f"""SELECT o.record_id, p.node AS post_node, {_filled(_s('id'), _s('rest_id'))} AS user_id, {_NAME} AS screen_name, {_filled(_s('name', 'c.o'), _s('name'), _s('name', 'l.o'))} AS name, coalesce({_s('profile_image_url')}, {_s('profile_image_url_https', 'l.o')}) AS profile_image_url,
  TRY_CAST(coalesce({_s('verified')}, {_s('verified', 'l.o')}) AS BOOLEAN) AS verified, TRY_CAST(coalesce({_s('followers_count')}, {_s('followers_count', 'l.o')}) AS BIGINT) AS followers_count, TRY_CAST(coalesce({_s('following_count')}, {_s('friends_count', 'l.o')}) AS BIGINT) AS following_count
  FROM nodes o JOIN nodes p ON {_UP} {_BLOCKS} WHERE o.type = 'user'"""
_P5_MEDIA = f"""SELECT o.record_id, p.node AS post_node, CAST(o.ordinal AS INT) AS media_pos, {_s('type')} AS kind, {_s('url')} AS url, {_filled(_s('media_url'), _s('media_url_https'))} AS media_url, {_s('preview_image_url')} AS preview_image_url,
  TRY_CAST({_s('width')} AS INT) AS width, TRY_CAST({_s('height')} AS INT) AS height, {_s('local_path')} AS local_path FROM nodes o JOIN nodes p ON {_UP} WHERE o.type = 'media'"""
SQL |= {
    "p5_posts": f"WITH {_OBJECTS} {_P5_POSTS}",
    "p5_users": f"WITH {_OBJECTS} {_P5_USERS}",
    "p5_media": f"WITH {_OBJECTS} {_P5_MEDIA}",
    "p5_found": f"""WITH {_OBJECTS}, posts AS ({_P5_POSTS}), users AS ({_P5_USERS}), media AS ({_P5_MEDIA})
SELECT DISTINCT m.record_id, p.parent_tweet_id, p.tweet_id, m.media_pos, coalesce(u.screen_name, '') AS screen_name, m.media_url FROM media m JOIN posts p ON p.record_id = m.record_id AND p.node = m.post_node LEFT JOIN users u ON u.record_id = m.record_id AND u.post_node = m.post_node WHERE m.media_url <> ''""",
}
