"""Registered queries of graphs, second rounds, walking, claims, budgets and reports, with SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import bm25, claims, graph, network, ordering, reports, search, walking
from tidemark.operators import posts as P
from tidemark.plans import oracle as O
from tidemark.plans import texts as T
from tidemark.storage import materialize, table

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


def hits_of(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """(query_id, id, rnk): each query's best hits; null and NaN scores are below every number."""
    hits = table(spark, d, "scored_hits").where("tweet_id IS NOT NULL")
    s = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    best = hits.groupBy("query_id", F.col("tweet_id").alias("id")).agg(F.max(s).alias("score"))
    return best.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rnk") <= most).select("query_id", "id", "rnk")


def graph_of(spark: SparkSession, d: str) -> graph.Graph:
    top = materialize(hits_of(spark, d), "hits")
    # a graph is of a search's hits: its posts are read, not the archive
    return graph.build(table(spark, d, "search_queries"), top, materialize(_posts(spark, d).join(top.select("id").distinct(), "id", "left_semi"), "posts"))


_NODES = f"nodes AS MATERIALIZED ({O.SQL['graph_nodes']})"
_EDGES = f"edges AS MATERIALIZED ({O.SQL['graph_edges']})"
_ENTITY = "kind IN ('handle', 'hashtag', 'domain', 'concept')"


def _seeds(nodes: str = "nodes") -> str:
    return f"""seeds AS MATERIALIZED (SELECT query_id, id, boosted, place, CASE WHEN starts_with(id, 'concept:') THEN replace(regexp_replace(id, '^[^:]*:', ''), '_', ' ') ELSE regexp_replace(id, '^[^:]*:', '') END AS seed_text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) AS place FROM (SELECT *, round(weight * CASE kind WHEN 'handle' THEN 1.0 WHEN 'hashtag' THEN 0.7 WHEN 'domain' THEN 0.5 ELSE 0.3 END, 9) AS boosted,
  row_number() OVER (PARTITION BY query_id, kind ORDER BY weight DESC, id) AS in_kind FROM {nodes} WHERE {_ENTITY}) WHERE in_kind <= 5) WHERE place <= 5)"""


@registered(f"WITH {_NODES}, {_seeds()} SELECT query_id, id, CAST(boosted AS DOUBLE) AS boosted, place, seed_text FROM seeds")
def graph_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The entities a second round of each search is made with."""
    return graph.seeds(graph_of(spark, d).nodes)


@registered(f"""WITH {O._GRAPH}, {_NODES}, steps AS (SELECT query_id, 'query:root' AS src, 'tweet:' || id AS dst, 'recall_for' AS kind, {{'a': rnk, 'b': 1, 'c': ''}} AS seq FROM slim
UNION ALL SELECT query_id, 'tweet:' || id, 'handle:' || lower(regexp_replace(handle, '^@+', '')), 'authored_by', {{'a': rnk, 'b': 2, 'c': ''}} FROM slim WHERE handle <> ''
UNION ALL SELECT t.query_id, 'tweet:' || id, {O._NODE}, CASE kind WHEN 'domain' THEN 'cites' ELSE 'mentions' END, {{'a': rnk, 'b': CASE kind WHEN 'handle' THEN 3 WHEN 'hashtag' THEN 4 WHEN 'domain' THEN 5 ELSE 6 END, 'c': value}} FROM top t JOIN entities e USING (id)),
e AS (SELECT query_id, src, dst, kind, min(seq) AS seq FROM steps GROUP BY ALL),
ej AS (SELECT query_id, string_agg('{{"src":' || to_json(src) || ',"dst":' || to_json(dst) || ',"kind":' || to_json(kind) || '}}', ',' ORDER BY seq, src, dst, kind) AS j FROM e GROUP BY query_id),
nj AS (SELECT query_id, string_agg('{{"id":' || to_json(id) || ',"kind":' || to_json(kind) || CASE WHEN label IS NULL THEN '' ELSE ',"label":' || to_json(label) END || ',"weight":' || to_json(weight) || '}}', ',' ORDER BY id) AS j FROM nodes GROUP BY query_id)
SELECT query_id, '{{"nodes":[' || nj.j || ']' || coalesce(',"edges":[' || ej.j || ']', '') || '}}' AS graph FROM nj LEFT JOIN ej USING (query_id)""")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """Each search's graph as JSON."""
    return graph.as_json(graph_of(spark, d))


@registered(f"WITH {_NODES}, {_EDGES} SELECT DISTINCT e.query_id, e.src AS id, e.dst AS near, n.kind FROM edges e JOIN nodes n ON n.query_id = e.query_id AND n.id = e.dst")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that each node's edges lead to."""
    return graph.all_neighbors(graph_of(spark, d))


@registered(f"""WITH {_NODES}, {_EDGES}, many AS (SELECT query_id FROM nodes WHERE {_ENTITY} GROUP BY query_id HAVING count(*) > 1),
kept AS (SELECT query_id, id FROM nodes WHERE NOT ({_ENTITY}) OR query_id % 2 = 0 OR query_id NOT IN (SELECT query_id FROM many) OR length(id) % 3 = 0)
SELECT e.query_id, src, dst, kind FROM edges e JOIN kept a ON a.query_id = e.query_id AND a.id = e.src JOIN kept b ON b.query_id = e.query_id AND b.id = e.dst""")
def graph_relevant(spark: SparkSession, d: str) -> DataFrame:
    """Edges of graphs in which a filter (here: of odd queries, by the length of ids) has kept some entities."""
    g = graph_of(spark, d)
    answer = g.nodes.where("query_id % 2 = 1").select("query_id", F.when(F.length("id") % 3 == 0, F.col("id")).otherwise("").alias("id"))
    return graph.relevant(g, answer).edges.select("query_id", "src", "dst", "kind")


@registered(f"""WITH {T.COMPAT}, {_NODES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY weight DESC, id) AS place FROM nodes WHERE {_ENTITY})
SELECT query_id, kind, place, {T.label('label')} AS label FROM ranked, compat WHERE place <= 8 AND weight >= 2""")
def graph_mindmap(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of each search's mind map."""
    return graph.mindmap(graph_of(spark, d))


_NODE_ROWS = O.SQL["graph_nodes"].split("rows AS (", 1)[1].rsplit(")\nSELECT", 1)
_SECOND = f"""WITH {O._INDEX}, {O._QUERIES}, {O._LEXICAL}, {O.ENTITIES}, top AS MATERIALIZED (SELECT query_id, id, rnk FROM lexical WHERE rnk <= 20),
slim AS (SELECT t.query_id, t.id, t.rnk, p.author.screen_name AS handle FROM top t LEFT JOIN posts p USING (id)), rows AS ({_NODE_ROWS[0]}), nodes AS MATERIALIZED (SELECT{_NODE_ROWS[1]}), {_seeds()},
sterms AS (SELECT query_id * 1000 + place AS seed, query_id, place, term, count(*) AS qtf FROM (SELECT query_id, place, unnest({O._tokens('seed_text')}) AS term FROM seeds) GROUP BY ALL),
again AS (SELECT q.seed, q.query_id, q.place, p.id, round(sum(q.qtf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (1.0 - 0.75 + 0.75 * p.dl / (SELECT mean FROM sizes)))), 9) AS score FROM sterms q JOIN terms t USING (term) JOIN postings p USING (term) GROUP BY ALL),
second AS (SELECT query_id, id, rnk + place * 1000 AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rnk FROM {O._within('again')}) WHERE rnk <= 20),
both_rounds AS (SELECT query_id, id, rnk, 1 AS round FROM top UNION ALL SELECT query_id, id, rnk, 2 FROM second)
SELECT query_id, id, rnk, round FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY round, rnk) AS n FROM both_rounds) WHERE n = 1"""


@registered(_SECOND)
def search_second_round(spark: SparkSession, d: str) -> DataFrame:
    """Hits of both rounds of every search; the second round is one plan over all seeds."""
    posts = materialize(_posts(spark, d), "posts")
    index = bm25.build(posts)
    queries = table(spark, d, "search_queries").select("query_id", "query_text", "year_filter", "month_start", "month_end")
    first = materialize(search.lexical(index, queries, 20).select("query_id", "id", "rnk"), "hits")
    nodes = graph.build(queries, first, posts).nodes
    return search.second_round(first, queries, nodes, lambda q: search.lexical(index, q, 20))


_CHUNKS = f"""chunks AS (SELECT {O._month('created_at')} AS year_month, id, CAST((row_number() OVER (PARTITION BY {O._month('created_at')} ORDER BY id) - 1) // 30 AS INT) AS chunk FROM posts WHERE {O._month('created_at')} IS NOT NULL)"""


@registered(f"WITH {O._POSTS}, {_CHUNKS} SELECT year_month, chunk, id, CAST(right(id, 2) AS INT) / 100.0 AS relevance, 'ends in ' || right(id, 2) AS why FROM chunks WHERE right(id, 1) <> '3'")
def walk_hits(spark: SparkSession, d: str) -> DataFrame:
    """Posts walked month by month in chunks of 30, scored by a call (here: by their last digits)."""

    def call(prompt: str) -> str:
        ids = re.findall(r"^\[id=([0-9]+)\] @", prompt, re.M)
        hits = [{"id": i, "relevance": int(i[-2:]) / 100, "why": f"ends in {i[-2:]}"} if i[-1] != "3" else {"id": i, "relevance": True} for i in ids]
        return "```json\n" + json.dumps({"hits": [*hits, {"id": "0", "relevance": 1}]}) + "\n```"

    sections = _posts(spark, d).select(dates.month_key(F.col("created_at")).alias("year_month"), F.col("id").alias("seq"), F.col("id").alias("tweet_id"), F.col("author.screen_name").alias("handle"), "text").where("year_month IS NOT NULL")
    return walking.walk(sections, "anything", call)


@registered("""SELECT query_id, hop, tweet_id AS id, walker_relevance AS relevance, coalesce(why, '') AS why FROM scored_hits WHERE tweet_id IS NOT NULL AND right(tweet_id, 1) <> '7' AND walker_relevance BETWEEN 0 AND 1 AND CAST(walker_relevance AS VARCHAR) <> 'nan'""")
def answers_valid(spark: SparkSession, d: str) -> DataFrame:
    """Valid hits of answers that hold their JSON bare, in a fence, or inside a sentence."""
    h = table(spark, d, "scored_hits").where("tweet_id IS NOT NULL")
    entry = F.struct(F.col("tweet_id").alias("id"), F.col("walker_relevance").alias("relevance"), "why")
    per = h.groupBy("query_id", "hop").agg(F.to_json(F.collect_list(entry)).alias("j"), F.collect_set(F.when(~F.col("tweet_id").endswith("7"), F.col("tweet_id"))).alias("ids"))  # the hits of one answer
    style = F.col("query_id") % 3
    answer = F.when(style == 0, F.col("j")).when(style == 1, F.concat(F.lit('```json\n{"hits": '), "j", F.lit("}\n```"))).otherwise(F.concat(F.lit('Sure: {"results": '), "j", F.lit("} - done.")))
    return walking.answered(per.withColumn("answer", answer), ["query_id", "hop"], "answer", "ids")


@registered(f"""WITH {T._RANKED}, a AS (SELECT query_id, tweet_id AS id, min(why) AS why FROM scored_hits WHERE why IS NOT NULL GROUP BY ALL)
SELECT r.query_id, r.id, r.rnk, CASE WHEN r.rnk <= 20 THEN coalesce(a.why, '') ELSE '' END AS why FROM ranked r LEFT JOIN a USING (query_id, id)""")
def hits_explained(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the reasons of an explainer's answers for the first twenty."""
    hits = T.ranked_hits(spark, d).select("query_id", "id", "rnk", F.lit("").alias("why"))
    answers = table(spark, d, "scored_hits").where("why IS NOT NULL").select("query_id", F.col("tweet_id").alias("id"), "why")
    return walking.explained(hits, answers, keys=("query_id", "id")).select("query_id", "id", "rnk", "why")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "scored_hits").select("query_id", F.concat(F.when(F.col("hop") == 1, "tweet:").otherwise("url:https://u.example/"), "tweet_id").alias("source"), "hop")
    return h.groupBy("query_id", F.col("hop").alias("claim")).agg(F.array_sort(F.collect_set("source")).alias("sources"))  # of one report


_CITED = "cited AS (SELECT query_id, hop AS claim, source, row_number() OVER (PARTITION BY query_id, hop ORDER BY source) - 1 AS pos FROM (SELECT DISTINCT query_id, hop, CASE WHEN hop = 1 THEN 'tweet:' ELSE 'url:https://u.example/' END || tweet_id AS source FROM scored_hits WHERE tweet_id IS NOT NULL))"


@registered(f"WITH {_CITED} SELECT DISTINCT query_id, source FROM cited WHERE source NOT IN (SELECT 'tweet:' || id FROM tweets WHERE id IS NOT NULL)")
def unknown_citations(spark: SparkSession, d: str) -> DataFrame:
    """Cited sources that are not among a search's known ones, here the saved posts."""
    every = claims.cited(_claims(spark, d)).select("query_id", "source").distinct()
    saved = table(spark, d, "tweets").select(F.concat(F.lit("tweet:"), "id").alias("source")).where("source IS NOT NULL").distinct()
    return claims.unknown_sources(_claims(spark, d), every.join(saved, "source"))


@registered(f"""WITH {O._POSTS}, {T._RANKED}, {_CITED}, h AS (SELECT r.query_id, r.id, p.author.screen_name AS handle FROM ranked r JOIN posts p USING (id))
SELECT c.query_id, c.claim, c.pos, c.source, CASE WHEN starts_with(c.source, 'url:') THEN substr(c.source, 5) ELSE {T._STATUS_OF.format(id="substr(c.source, 7)", handle="h.handle")} END AS url FROM cited c LEFT JOIN h ON h.query_id = c.query_id AND c.source = 'tweet:' || h.id""")
def claims_linked(spark: SparkSession, d: str) -> DataFrame:
    """Cited sources with their addresses."""
    handles = _posts(spark, d).select("id", F.col("author.screen_name").alias("handle"))
    return claims.linked(_claims(spark, d), T.ranked_hits(spark, d).select("query_id", "id", "rnk").join(handles, "id"))


_WORDS = f"CASE WHEN {T.trimmed('coalesce(text, {q}{q})'.format(q=chr(39)))} = '' THEN 0 ELSE len(regexp_split_to_array({T.trimmed('text')}, '{O._WS}+')) END"


@registered(f"""WITH {O._POSTS}, {T._RANKED}, w AS (SELECT r.query_id, r.id, r.rnk, sum({_WORDS}) OVER (PARTITION BY r.query_id ORDER BY r.rnk) AS words FROM ranked r JOIN posts p USING (id)) SELECT query_id, id, rnk, CAST(words AS BIGINT) AS words FROM w WHERE words <= 350""")
def words_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each search whose texts fit 350 words, up to the first that doesn't."""
    rows = T.ranked_hits(spark, d).select("query_id", "id", "rnk").join(_posts(spark, d).select("id", "text"), "id")
    return ordering.word_budget(rows, ["query_id"], ["rnk"], "text", 350).select("query_id", "id", "rnk", "words")


@registered(f"""WITH {O._POSTS}, {T._RANKED}, parts AS (SELECT r.query_id, 0 AS part, r.rnk, 0 AS pos, coalesce(p.text, '') AS body FROM ranked r JOIN posts p USING (id) UNION ALL SELECT query_id, 1, rnk, pos, body FROM (SELECT r.query_id, r.rnk, generate_subscripts(p.urls, 1) - 1 AS pos, unnest(p.urls) AS body FROM ranked r JOIN posts p USING (id))),
b AS (SELECT *, sum(strlen(coalesce(body, ''))) OVER (PARTITION BY query_id ORDER BY part, rnk, pos) AS bytes FROM parts) SELECT query_id, part, rnk, pos, CAST(bytes AS BIGINT) AS bytes FROM b WHERE bytes <= 4096""")
def bytes_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """The texts and then addresses of each search's hits that fit 4,096 bytes."""
    rows = T.ranked_hits(spark, d).select("query_id", "id", "rnk").join(_posts(spark, d).select("id", "text", "urls"), "id")
    bodies = rows.select("query_id", F.lit(0).alias("part"), "rnk", F.lit(0).alias("pos"), F.coalesce("text", F.lit("")).alias("body"))
    links = rows.select("query_id", F.lit(1).alias("part"), "rnk", F.posexplode("urls").alias("pos", "body"))
    return ordering.byte_budget(bodies.unionByName(links), ["query_id"], "part", ["rnk", "pos"], "body", 4096).select("query_id", "part", "rnk", "pos", "bytes")


@registered(f"""WITH {O._POSTS}, {T._RANKED}, u AS (SELECT r.query_id, r.rnk, generate_subscripts(p.urls, 1) - 1 AS pos, trim(unnest(p.urls)) AS url FROM ranked r JOIN posts p USING (id)), f AS (SELECT query_id, url, min({{'a': rnk, 'b': pos}}) AS place FROM u WHERE regexp_matches(lower(url), '^https?://') GROUP BY ALL)
SELECT query_id, url, place.a AS rnk, place.b AS pos FROM f""")
def hit_urls(spark: SparkSession, d: str) -> DataFrame:
    """Each search's addresses, once, at their first place."""
    rows = T.ranked_hits(spark, d).select("query_id", "id", "rnk").join(_posts(spark, d).select("id", "urls"), "id")
    return network.distinct_urls(rows).select("query_id", "url", F.col("place.rnk").alias("rnk"), F.col("place.pos").alias("pos"))


@registered(f"WITH {O._POSTS}, e AS (SELECT min(favorite_count) AS least, max(favorite_count) AS most FROM posts) SELECT row_number() OVER (ORDER BY favorite_count DESC, id) AS place, id, favorite_count AS count, least, most FROM posts, e WHERE favorite_count IS NOT NULL QUALIFY place <= 5")
def posts_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The five most liked posts, and the least and most likes there are."""
    return P.extremes(_posts(spark, d))


def _searches(spark: SparkSession, d: str, most: int) -> DataFrame:
    """(query_id, query_text, hits, nodes, edges): each query's best hits, and their graph."""
    queries = table(spark, d, "search_queries").select("query_id", "query_text")
    top = materialize(hits_of(spark, d, most), "hits")
    posts = materialize(_posts(spark, d).join(top.select("id").distinct(), "id", "left_semi"), "posts")
    g = graph.build(queries, top, posts)
    slim = top.join(posts.select("id", "text", "urls", F.col("author.screen_name").alias("handle"), dates.month_key(F.col("created_at")).alias("month")), "id")
    # arrays of one search: at most `most` hits and what they name
    hits = slim.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "id", "handle", "text", "urls", "month"))).alias("hits"))
    nodes = g.nodes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "kind", "label", "weight"))).alias("nodes"))
    edges = g.edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "src", "dst", "kind"))).alias("edges"))
    bare = lambda c, names: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names])).alias(c)
    return queries.join(hits, "query_id", "left").join(nodes, "query_id", "left").join(edges, "query_id", "left").select("query_id", "query_text", bare("hits", ("id", "handle", "text", "urls", "month")), bare("nodes", ("id", "kind", "label", "weight")), bare("edges", ("src", "dst", "kind")))


_Q = f"coalesce(nullif({T.trimmed(T.clean('query_text'))}, ''), '(empty query)')"
_REPR = "CASE WHEN contains({0}, '''') AND NOT contains({0}, '\"') THEN '\"' || {0} || '\"' ELSE '''' || replace({0}, '''', '\\''') || '''' END"


@registered(f"""WITH {T.COMPAT}, {O._POSTS}, hits AS (SELECT query_id, tweet_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY max(CASE WHEN score IS NULL OR CAST(score AS VARCHAR) = 'nan' THEN CAST('-infinity' AS DOUBLE) ELSE score END) DESC, tweet_id) AS rnk FROM scored_hits WHERE tweet_id IS NOT NULL GROUP BY query_id, tweet_id),
h AS (SELECT query_id, p.id, p.author.screen_name AS handle, row_number() OVER (PARTITION BY query_id ORDER BY rnk) AS n, {T._BARE} AS bare, list_filter({T._safe_list('urls')}, lambda x, i: list_position({T._safe_list('urls')}, x) = i) AS safe FROM hits JOIN posts p USING (id) CROSS JOIN compat WHERE rnk <= 20),
b AS (SELECT *, array_to_string(list_filter([bare, array_to_string(safe, ' ')], lambda x: x <> ''), '  ') AS body FROM h),
s AS (SELECT *, CASE WHEN length(body) <= 120 THEN body ELSE regexp_replace(substring(body, 1, 119), '{O._WS}+$', '') || '...' END AS short FROM b),
q AS (SELECT query_id, {_Q} AS q, coalesce(query_text, '') AS raw FROM search_queries, compat), found AS (SELECT DISTINCT query_id FROM h),
lines AS (SELECT query_id, 0 AS line, '# Synthesis report — ' || q AS markdown FROM q UNION ALL SELECT query_id, k, ['', '## Brief', NULL, '', '## Top entities', '- (none)', '', '## Anchor tweets'][k] FROM found, range(1, 9) r(k) WHERE k <> 3
UNION ALL SELECT query_id, 3, {T.clean("'This brief lists the top hits for ' || " + _REPR.format('raw') + " || '. The synthesizer did not produce a structured summary.'")} FROM q JOIN found USING (query_id) CROSS JOIN compat
UNION ALL SELECT query_id, 8 + n, '- [' || id || '](' || {T._STATUS_OF.format(id='id', handle='handle')} || '): ' || short FROM s WHERE n <= 10
UNION ALL SELECT query_id, k, ['', {T.clean("'No matching tweets were found in the corpus for the query ' || " + _REPR.format('q') + " || '.'")}, ''][k] FROM q CROSS JOIN compat, range(1, 4) r(k) WHERE query_id NOT IN (SELECT query_id FROM found))
SELECT query_id, CAST(line AS INT) AS line, markdown FROM lines""")
def report_brief(spark: SparkSession, d: str) -> DataFrame:
    """The brief report of every search."""
    return reports.rendered(_searches(spark, d, 20), "brief")


@registered()
def report_trend(spark: SparkSession, d: str) -> DataFrame:
    """The trend report of every search: a mind map, and its hits by month."""
    return reports.rendered(_searches(spark, d, 50), "trend")


@registered()
def report_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """The synthesis report of every search, without a model's sections."""
    return reports.rendered(_searches(spark, d, 50), "synthesis")
