"""Problem 3: texts and names that look the same but are written with other characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialize


def consistent(text: Column) -> Column:
    """The consistent form (see textform) of a string column; null stays null, invisible text becomes empty."""

    @F.arrow_udf("string")
    def run(arr):
        from tidemark.llm.textform import consistent_array

        return consistent_array(arr)

    return run(text)


def spellings(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (k, f1, f2, v) of rows with a value and a key that is not empty.

    f1 and f2 are two 64-bit hashes of the consistent form, v is one of the
    characters as written: all that coincidence needs, in a few bytes a row.
    The texts themselves are neither shuffled nor kept.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("t")).where("k <> '' AND t IS NOT NULL")
    rows = rows.withColumn("form", consistent(F.col("t")))
    return rows.select("k", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"), F.xxhash64("t").alias("v")).distinct()


def same_reading_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """The keys whose values coincide in consistent form but not in characters.

    One row (k, f1, f2, v) for each distinct key and spelling in a group (f1,
    f2) of at least two different spellings.  A group is only ever aggregated
    to its least and greatest spelling, never collected.  Null or empty keys
    and null values are left out; repeated rows count once; an empty table
    gives no row.
    """
    rows = materialize(spellings(df, key, value), "spellings")
    mixed = rows.groupBy("f1", "f2").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("f1", "f2")
    return rows.join(mixed, ["f1", "f2"], "left_semi")


def same_reading_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct pairs (key_a < key_b, as text) of keys with values that read the same and differ in characters.

    Within a form only unlike spellings are paired, and then each such pair
    with its keys; keys of one spelling are never paired with each other.  The
    result may be quadratic in a group, the steps before it are not.
    """
    g = same_reading_groups(df, key, value)
    spell = g.select("f1", "f2", "v").distinct()
    unlike = spell.withColumnRenamed("v", "va").join(spell.withColumnRenamed("v", "vb"), ["f1", "f2"]).where("va <> vb")
    left = g.select("f1", "f2", F.col("v").alias("va"), F.col("k").alias("key_a"))
    right = g.select("f1", "f2", F.col("v").alias("vb"), F.col("k").alias("key_b"))
    pairs = unlike.join(left, ["f1", "f2", "va"]).join(right, ["f1", "f2", "vb"])
    return pairs.where("key_a < key_b").select("key_a", "key_b").distinct()
