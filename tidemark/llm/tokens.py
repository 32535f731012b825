"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default vocabulary file: byte-level BPE for many languages, as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pieces for byte-level BPE of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, ident: str, text: str, *keep: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens, *keep): each row's size; null and empty texts have 0 tokens.

    The vocabulary is read once on the driver and broadcast (a file of a fixed
    size, under 1 MB), so executors need no copy.
    """
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(text).cast("string").alias("_text"), F.col(ident).alias("id"), *keep)

    def run(batches):
        enc = _encoding(raw.value, pattern)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n)], [*b.schema.names[1:], "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, tokens bigint")


def spread_rank(df: DataFrame, keys: list[str], ident: str, salts: int = 64, seed: int = 0) -> DataFrame:
    """df with ``rank``: 0, 1, ... inside each group of keys, in an order drawn from the ids.

    No task ranks a whole group: ranks are taken inside salts of it and moved
    by the sizes of the salts before, which are counted (keys x salts rows).
    """
    order = F.xxhash64(F.lit(seed), F.col(ident).cast("string"))
    salted = df.withColumn("_order", order).withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = salted.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_order", ident)))
    return inside.join(moved, [*keys, "_salt"]).withColumn("rank", F.col("_off") + F.col("_in") - 1).drop("_order", "_salt", "_off", "_in")
