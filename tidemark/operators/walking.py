"""Posts scored by a language model in chunks: prompts, tolerant answers, validated hits."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ordering, reports

CHUNK, WHY, PROMPT = 30, 240, 280
_WRAPPERS = ("hits", "results", "tweets", "data")


def parse_answer(raw: str | None):
    """The JSON value of an answer: as it is, out of a code fence, or between the outermost brackets; ValueError if there is none."""
    raw = (raw or "").strip()
    tries = [raw]
    if m := re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", raw, re.S | re.I):
        tries.append(m[1])
    for a, b in ("{}", "[]"):
        if 0 <= raw.find(a) < raw.rfind(b):
            tries.append(raw[raw.find(a) : raw.rfind(b) + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    raise ValueError("no JSON in the answer")


def valid_hits(value, ids: set[str]) -> list[tuple[str, float, str]]:
    """(id, relevance, why) of the entries with a known id and a number from 0 to 1; the list may stand in a wrapper."""
    if isinstance(value, dict):
        value = next((value[k] for k in _WRAPPERS if isinstance(value.get(k), list)), [])
    out = []
    for e in value if isinstance(value, list) else []:
        if not isinstance(e, dict) or e.get("id") is None or str(e["id"]) not in ids:
            continue
        r = e.get("relevance")
        if isinstance(r, bool) or not isinstance(r, (int, float)) or not math.isfinite(r) or not 0 <= r <= 1:
            continue
        why = e.get("why", "")
        out.append((str(e["id"]), float(r), "" if why is None else str(why)[:WHY]))
    return out


def answered(answers: DataFrame, keys: list[str], answer: str, ids: str) -> DataFrame:
    """(*keys, id, relevance, why): the validated hits of answers (text) to questions about ids (an array); an unreadable answer gives none."""
    fields = ", ".join(f"`{k}` {answers.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            at, hits = [], []
            for i, (raw, known) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                try:
                    some = valid_hits(parse_answer(raw), set(known or ()))
                except ValueError:
                    continue
                at += [i] * len(some)
                hits += some
            cols = list(zip(*hits, strict=True)) if hits else [()] * 3
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), *(pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True))], [*keys, "id", "relevance", "why"])

    return answers.select(*keys, answer, ids).mapInArrow(run, f"{fields}, id string, relevance double, why string")


def chunks(sections: DataFrame, months: list[str] | None = None, size: int = CHUNK) -> DataFrame:
    """(year_month, chunk, prompt_part, ids): sections (year_month, seq, tweet_id, handle, text) in chunks of each month, in order.

    months restricts and is not reordered here; an order is a column's matter.
    """
    some = sections if months is None else sections.where(F.col("year_month").isin(months))
    line = F.concat(F.lit("[id="), F.col("tweet_id"), F.lit("] @"), text.sanitized(F.col("handle")), F.lit(": "), text.fenced(text.flat_cut(F.col("text"), PROMPT), "tweet"))
    placed = ordering.numbered(some.select("year_month", "seq", "tweet_id", "handle", "text"), ["year_month"], ["seq", "tweet_id"])
    rows = placed.withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("int")).withColumn("line", line)
    # a chunk has at most `size` rows
    got = F.array_sort(F.collect_list(F.struct("place", "tweet_id", "line")))
    return rows.groupBy("year_month", "chunk").agg(got.alias("g")).select("year_month", "chunk", F.array_join(F.transform("g", lambda x: x["line"]), "\n").alias("prompt_part"), F.transform("g", lambda x: x["tweet_id"]).alias("ids"))


def prompt(query: str, part: str) -> str:
    return f"Query: {reports.clean(query)}\n\nTweets:\n{part}\n\nReturn the relevant tweets as JSON: a list of id, relevance from 0 to 1, and why."


def walk(sections: DataFrame, query: str, call: Callable[[str], str], months: list[str] | None = None, size: int = CHUNK) -> DataFrame:
    """(year_month, chunk, id, relevance, why): validated answers of an injected call for each chunk; a chunk without a readable answer gives none."""

    def run(batches):
        for b in batches:
            said = [call(prompt(query, part)) for part in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), b.column(3)], ["year_month", "chunk", "answer", "ids"])

    asked = chunks(sections, months, size).mapInArrow(run, "year_month string, chunk int, answer string, ids array<string>")
    return answered(asked, ["year_month", "chunk"], "answer", "ids")


def explained(hits: DataFrame, answers: DataFrame, top: int = 20, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """hits (*keys, rnk, why, ...) with the reasons of answers (*keys, why) for the first ``top``; order and other hits stay."""
    a = answers.groupBy(*keys).agg(F.min("why").alias("_why"))
    return hits.join(a, list(keys), "left").withColumn("why", F.when(F.col("rnk") <= top, F.coalesce("_why", F.col("why"))).otherwise(F.col("why"))).drop("_why")
