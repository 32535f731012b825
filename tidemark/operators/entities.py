"""Handles, hashtags, domains and concepts named in posts, with their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that alone make no concept, by part of speech.
STOPWORDS = tuple(
    """
a an the and but or if is are was were be been being have has had do does did will would could should may might shall must can
this that these those i me my you your we us our they them their he she him her his hers its
what which who whom where when why how all any both each few more most other some such no nor not only own same so than too very just now
ok okay yes yeah yep nope nah huh wow lol haha uh um hey oh ah well hmm
got get gets go goes going gone make makes made see sees saw seen say says said tell tells told think thinks thought know knows knew known want wants wanted use uses used
good great bad best better worse worst really actually basically literally totally
first second third last next previous
many much less lots
""".split()
)
KINDS = ("handle", "hashtag", "domain", "concept")
#: A concept must occur twice in texts of at least this length.
SHORT = 50
#: Fixed value: a capitalised word.
_CAPITAL = r"(?:[A-Z][a-z]+|[A-Z]{2,})"
_RUN = rf"(?U)\b{_CAPITAL}(?:\s+{_CAPITAL})*\b"


def handles(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("@([A-Za-z0-9_]{1,15})"), 1), F.lower)


def hashtags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), 1), F.lower)


def domains(text: Column) -> Column:
    """Hosts of addresses as written (with port and user), in lower case, without a leading www."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)https?://([^/\s]+)"), 1), lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))


def concepts(text: Column) -> Column:
    """Windows of one to three words of runs of capitalised words, joined by _, those of stop words alone left out."""
    words = F.transform(F.regexp_extract_all(text, F.lit(_RUN), 0), lambda r: F.split(F.lower(r), r"(?U)\s+"))
    stop = F.array(*map(F.lit, STOPWORDS))

    def windows(w: Column, size: int) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(w, i, size))

    every = F.flatten(F.transform(words, lambda w: F.concat(*[windows(w, k) for k in (1, 2, 3)])))
    return F.transform(F.filter(every, lambda w: ~F.forall(w, lambda x: F.array_contains(stop, x))), lambda w: F.array_join(w, "_"))


def extract(posts: DataFrame, ident: str = "id", text: str = "text", bodies: str | None = None) -> DataFrame:
    """(id, kind, value, weight) of each text, with those of fetched bodies (an array column) joined to it.

    The weight counts occurrences in text and bodies; whether one occurrence of a
    concept suffices depends on the length of the text alone.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    whole = F.array_join(F.concat(F.array(own), F.coalesce(F.col(bodies), F.array().cast("array<string>"))), "\n") if bodies else own
    found = {"handle": handles, "hashtag": hashtags, "domain": domains, "concept": concepts}
    rows = posts.select(F.col(ident).cast("string").alias("id"), F.length(own).alias("_length"), whole.alias("_whole"))

    def named(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    parts = F.concat(*[F.transform(found[k](F.col("_whole")), named(k)) for k in KINDS])
    counted = rows.select("id", "_length", F.explode(parts).alias("e")).groupBy("id", "_length", "e.kind", "e.value").agg(F.count("*").alias("n"))
    enough = (F.col("kind") != "concept") | (F.col("n") >= F.when(F.col("_length") < SHORT, 1).otherwise(2))
    return counted.where(enough).select("id", "kind", "value", F.col("n").cast("double").alias("weight"))
