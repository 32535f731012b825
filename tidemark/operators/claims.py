"""What reports claim and cite, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


def cited(claims: DataFrame) -> DataFrame:
    """(query_id, claim, pos, source) of claims (query_id, claim, sources): each source cited, in order; null sources are left out."""
    return claims.select("query_id", "claim", F.posexplode("sources").alias("pos", "source")).where("source IS NOT NULL")


def unknown_sources(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (query_id, source) that claims cite and known (query_id, source) doesn't have."""
    return cited(claims).select("query_id", "source").distinct().join(known.select("query_id", "source"), ["query_id", "source"], "left_anti")


def linked(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, claim, pos, source, url): each cited source with its address, '' where it has none.

    hits (query_id, id, rnk, handle) give the handles of posts, the best-ranked
    of an id counting; sources are tweet:<id> or url:<address>.
    """
    of = hits.groupBy("query_id", F.col("id").alias("_value")).agg(F.min_by("handle", "rnk").alias("_handle"))
    parts = cited(claims).withColumn("_kind", F.substring_index("source", ":", 1)).withColumn("_value", F.regexp_replace("source", "^[^:]*:?", ""))
    url = F.when(F.col("_kind") == "tweet", text.status_url(F.col("_handle"), F.col("_value"))).when(F.col("_kind") == "url", F.col("_value")).otherwise("")
    return parts.join(of, ["query_id", "_value"], "left").select("query_id", "claim", "pos", "source", url.alias("url"))
