"""Ranks and budgets inside groups, without ranking a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place", amount: Column | None = None) -> DataFrame:
    """df with the row's rank from 1 inside its group, or the running sum of ``amount`` up to and with the row, by rising ``order``.

    Rows are range-partitioned by group and order, so a large group lies in
    several tasks; each task counts within its own piece, and pieces are moved by
    the totals of those before them (tasks x groups that share a task rows).
    Nulls come first; ``order`` must tell rows of a group apart for a definite result.
    """
    cut = df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    rows = materialize(cut, "pieces")
    inside = Window.partitionBy("_piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    what = F.lit(1) if amount is None else amount
    total = rows.groupBy("_piece", *keys).agg(F.sum(what).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    moved = total.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before <> 0").drop("_n")
    on = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    moved = moved.select(F.col("_piece").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    ranked = rows.withColumn("_in", F.sum(what).over(inside)).join(moved, on, "left")
    kind = "int" if amount is None else "bigint"
    return ranked.select(*df.columns, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast(kind).alias(name))


def word_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int) -> DataFrame:
    """The rows of each group up to the first whose words would overflow the budget, with ``words`` so far; null counts no word."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    n = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))
    return numbered(df, keys, order, "words", n).where(F.col("words") <= budget)


def byte_budget(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], body: str, budget: int) -> DataFrame:
    """The rows of each group whose bodies fit the budget of bytes, with ``bytes`` so far.

    Bodies are dropped from the end of the last part, then from that of the part
    before: what fits is a prefix by part and order.  A null body has no bytes.
    """
    return numbered(df, keys, [part, *order], "bytes", F.coalesce(F.octet_length(F.col(body)), F.lit(0))).where(F.col("bytes") <= budget)
