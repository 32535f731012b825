"""The small property graph of a search: nodes and edges as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import entities

#: What an entity of a kind weighs when seeds of a second round are picked, and edge kinds by entity kind.
BOOSTS = {"handle": 1.0, "hashtag": 0.7, "domain": 0.5, "concept": 0.3}
EDGES = {"handle": "mentions", "hashtag": "mentions", "domain": "cites", "concept": "mentions"}
ROOT = "query:root"


@dataclass
class Graph:
    """nodes (query_id, id, kind, label, weight) and edges (query_id, src, dst, kind, seq)."""

    nodes: DataFrame
    edges: DataFrame


def _by_kind(kind: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def merged_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of rows (query_id, id, kind, label, weight, seq): weights add up, kind and label are those first seen."""
    return rows.groupBy("query_id", "id").agg(F.min_by("kind", "seq").alias("kind"), F.min_by("label", "seq").alias("label"), F.sum("weight").alias("weight"), F.min("seq").alias("seq"))


def merged_edges(rows: DataFrame) -> DataFrame:
    """Edges of rows (query_id, src, dst, kind, seq), each once, at its first place."""
    return rows.groupBy("query_id", "src", "dst", "kind").agg(F.min("seq").alias("seq"))


def build(queries: DataFrame, hits: DataFrame, posts: DataFrame, edge_kind: str = "recall_for") -> Graph:
    """The graph of (query_id, query_text) and hits (query_id, id, rnk): one node for each query and hit, the hits' authors and entities.

    seq orders what a row-by-row build would add first: by rank, then the post,
    its author, its entities by kind and value.
    """
    slim = hits.select("query_id", "id", "rnk").join(posts.select("id", "text", F.col("author.screen_name").alias("handle")), "id", "left")
    order = lambda step, name: F.struct(F.col("rnk").cast("int").alias("rnk"), F.lit(step).alias("step"), name.alias("name"))
    none = F.lit("")
    root = queries.select("query_id", F.lit(ROOT).alias("id"), F.lit("query").alias("kind"), F.col("query_text").alias("label"), F.lit(1.0).alias("weight"), F.struct(F.lit(0).alias("rnk"), F.lit(0).alias("step"), none.alias("name")).alias("seq"))
    tweet = slim.select("query_id", text.node_id("tweet", F.col("id")).alias("id"), F.lit("tweet").alias("kind"), F.col("id").alias("label"), F.lit(1.0).alias("weight"), order(1, none).alias("seq"))
    named = slim.where("handle <> ''")
    author = named.select("query_id", text.node_id("handle", F.col("handle")).alias("id"), F.lit("handle").alias("kind"), F.col("handle").alias("label"), F.lit(1.0).alias("weight"), order(2, none).alias("seq"))
    # each post is mined once, however many queries hit it
    mined = entities.extract(slim.select("id", "text").dropDuplicates(["id"]))
    found = hits.select("query_id", "id", "rnk").join(mined, "id")
    node = _by_kind(F.col("kind"), {k: text.node_id(k, F.col("value")) for k in entities.KINDS})
    step = _by_kind(F.col("kind"), {k: F.lit(3 + i) for i, k in enumerate(entities.KINDS)})
    entity = found.select("query_id", node.alias("id"), "kind", F.col("value").alias("label"), "weight", F.struct(F.col("rnk").cast("int").alias("rnk"), step.alias("step"), F.col("value").alias("name")).alias("seq"))
    nodes = merged_nodes(root.unionByName(tweet).unionByName(author).unionByName(entity))
    recall = slim.select("query_id", F.lit(ROOT).alias("src"), text.node_id("tweet", F.col("id")).alias("dst"), F.lit(edge_kind).alias("kind"), order(1, none).alias("seq"))
    wrote = named.select("query_id", text.node_id("tweet", F.col("id")).alias("src"), text.node_id("handle", F.col("handle")).alias("dst"), F.lit("authored_by").alias("kind"), order(2, none).alias("seq"))
    link = found.select("query_id", text.node_id("tweet", F.col("id")).alias("src"), node.alias("dst"), _by_kind(F.col("kind"), {k: F.lit(v) for k, v in EDGES.items()}).alias("kind"), F.struct(F.col("rnk").cast("int").alias("rnk"), step.alias("step"), F.col("value").alias("name")).alias("seq"))
    return Graph(nodes, merged_edges(recall.unionByName(wrote).unionByName(link)))


def top_entities(nodes: DataFrame, kinds: tuple[str, ...] = entities.KINDS, n: int = 8) -> DataFrame:
    """The n heaviest nodes of each kind and query, with ``place``; ties by smaller id."""
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc("weight"), "id")
    return nodes.where(F.col("kind").isin(list(kinds))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def seeds(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, boosted, place, seed_text): the k entities of largest boosted weight, and the text they are searched by."""
    boosted = F.round(F.col("weight") * _by_kind(F.col("kind"), BOOSTS), 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "id")
    per_kind = top_entities(nodes, n=k).drop("place").withColumn("boosted", boosted)
    return per_kind.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "id", "boosted", "place", text.entity_query(F.col("id")).alias("seed_text"))


def neighbors(graph: Graph, ident: str, kind: str | None = None, reverse: bool = False) -> DataFrame:
    """The distinct nodes that ident's edges (of a kind) lead to, or come from if reversed."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    some = graph.edges.where(F.col(near) == ident)
    some = some if kind is None else some.where(F.col("kind") == kind)
    return graph.nodes.join(some.select("query_id", F.col(far).alias("id")).distinct(), ["query_id", "id"], "left_semi")


def all_neighbors(graph: Graph, kind: str | None = None) -> DataFrame:
    """(query_id, id, near, kind): the distinct nodes that each node's edges (of a kind) lead to, with their kinds."""
    edges = graph.edges if kind is None else graph.edges.where(F.col("kind") == kind)
    far = graph.nodes.select("query_id", F.col("id").alias("near"), "kind")
    return edges.select("query_id", F.col("src").alias("id"), F.col("dst").alias("near")).distinct().join(far, ["query_id", "near"]).select("query_id", "id", "near", "kind")


def relevant(graph: Graph, keep: DataFrame | None) -> Graph:
    """The graph without the entities that a filter's answer (query_id, id) leaves out.

    Queries and posts always stay; a query of which the filter says nothing, or
    that has at most one entity, keeps all.
    """
    if keep is None:
        return graph
    entity = F.col("kind").isin(list(entities.KINDS))
    asked = keep.select("query_id").distinct().withColumn("_asked", F.lit(True))
    many = graph.nodes.where(entity).groupBy("query_id").agg((F.count("*") > 1).alias("_many"))
    good = keep.select("query_id", "id").distinct().withColumn("_good", F.lit(True))
    marked = graph.nodes.join(asked, "query_id", "left").join(many, "query_id", "left").join(good, ["query_id", "id"], "left")
    stays = ~entity | F.col("_asked").isNull() | ~F.coalesce("_many", F.lit(False)) | F.coalesce("_good", F.lit(False))
    return kept(graph, marked.where(stays).select("query_id", "id"))


def mindmap(graph: Graph, per_kind: int = 8, least: float = 2.0) -> DataFrame:
    """(query_id, kind, place, label): the nodes of each search's mind map: the first per_kind of each kind, then those that weigh enough."""
    some = top_entities(graph.nodes, n=per_kind).where(F.col("weight") >= least)
    return some.select("query_id", "kind", "place", text.mindmap_label(F.col("label")).alias("label"))


def kept(graph: Graph, allowed: DataFrame) -> Graph:
    """The graph of allowed (query_id, id) nodes, and of edges with both ends kept."""
    nodes = graph.nodes.join(allowed, ["query_id", "id"], "left_semi")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("query_id", F.col("id").alias(end)), ["query_id", end], "left_semi")
    return Graph(nodes, edges)


def as_json(graph: Graph) -> DataFrame:
    """(query_id, graph): each query's graph as JSON, nodes by id, edges by first place.  A query has at most a few hundred hits."""
    n = graph.nodes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "label", "weight"))).alias("nodes"))
    e = graph.edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "src", "dst", "kind"))).alias("edges"))
    edges = F.transform("edges", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), x["kind"].alias("kind")))
    return n.join(e, "query_id", "left").select("query_id", F.to_json(F.struct("nodes", edges.alias("edges"))).alias("graph"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of the edges and the smallest node it is connected with.

    Alternates large-star and small-star steps, each one aggregation and one
    join on node ids, writing the edges after each round; rounds grow with the
    logarithm of the diameter.  No component is ever collected, and a hot node's
    edges are only grouped to their least neighbour.
    """
    from tidemark.storage import discard, materialize

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # edges are distinct, so their number and two sums of hashes tell whether a round changed them
    state = lambda df: df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in (1, 2)]).first()
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = materialize(small, "edges")
        before, now = now, state(new)
        discard(e)
        e = new
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
