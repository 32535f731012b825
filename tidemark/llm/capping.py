"""Problem 1: few contributors hold most records; limit each to a count or a share.

Method: quality-weighted reservoir sampling without replacement.  Each record
gets the random key ``score / temperature - ln(E)`` with E exponential with mean
1, which is the exponential race ``E / w`` for weights ``w = exp(score /
temperature)`` on a logarithmic scale; a contributor's cap-size largest keys are
retained.  Multiplied by the temperature the key is ``score - temperature *
ln(E)``, so temperature 0 is the race's limit in which the best-scored records
win for certain and only ties are drawn, here by the smaller id.  Where the
best-scored are asked for, they are drawn at a small temperature and an exact
check follows (:func:`best`): the draw bounds each contributor's cap-th score,
and only records near that bound are ranked by score and id.

E comes from a hash of seed and id, so a rerun or a retried task draws the same.
The reservoir is mergeable: each map task keeps at most cap rows of a
contributor before the shuffle (Spark's window group limit), so a contributor
with a third of all rows sends only a few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordering

#: Stands below every number: null and NaN scores are as low as this.
LOWEST = float("-inf")
#: Temperature of a draw that an exact check follows, and the most that -ln(E) can be from 0, E coming from 53 bits.
COLD, SPAN = 1e-6, 40.0


def race_key(score: Column, ident: Column, temperature: float = 0.0, seed: int = 0) -> Column:
    """The record's key; null and NaN scores lie below every number."""
    s = F.when(score.isNull() | F.isnan(score), F.lit(LOWEST)).otherwise(score.cast("double"))
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    if temperature == 0:
        return s
    # 52 bits of a hash that other engines have too
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), ident.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return s - F.lit(float(temperature)) * F.log(-F.log(u))


def reservoir(df: DataFrame, contributor: Sequence[str], ident: str, score: str, cap: int, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """The at most cap records of each contributor with the largest keys, with columns ``race`` and ``race_rank``.

    Columns of df with these two names are replaced, others kept; repeated rows
    are records of their own.  Ties in the key go to the smaller ident.  Every null contributor is one
    group; filter them before if they are not to be limited.  cap must be >= 1.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    w = Window.partitionBy(*contributor).orderBy(F.desc("race"), F.asc(ident))
    keyed = df.withColumn("race", race_key(F.col(score), F.col(ident), temperature, seed))
    return keyed.withColumn("race_rank", F.row_number().over(w)).where(F.col("race_rank") <= cap)


def _same(columns: Sequence[str], names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c, n in zip(columns, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return on


def best(df: DataFrame, contributor: Sequence[str], ident: str, score: str, cap: int, temperature: float = COLD, seed: int = 0) -> DataFrame:
    """The at most cap best-scored records of each contributor, with ``race`` (the score) and ``race_rank``; ties go to the smaller ident.

    They are drawn by exponential keys; a key differs from its score by at most
    SPAN x temperature, so no record further below the contributor's cap-th key
    than twice that can be among the best.  The others are ranked exactly.
    """
    names = [f"_d{i}" for i in range(len(contributor))]
    drawn = reservoir(df, contributor, ident, score, cap, temperature, seed)
    bound = drawn.groupBy(*(F.col(c).alias(n) for c, n in zip(contributor, names, strict=True))).agg(F.min("race").alias("_bound"), F.count("*").alias("_n")).where(F.col("_n") == cap).drop("_n")
    low = F.col("_bound") - (2 * SPAN * temperature + F.abs("_bound") * 1e-14)
    keyed = df.withColumn("race", race_key(F.col(score), F.col(ident), temperature, seed)).join(bound, _same(contributor, names), "left")
    near = keyed.where(F.col("_bound").isNull() | (F.col("_bound") == LOWEST) | (F.col("race") >= low)).drop("_bound", *names)
    return reservoir(near, contributor, ident, score, cap)


def left_out(df: DataFrame, contributor: Sequence[str], ident: str, score: str, cap: int, temperature: float = 0.0, seed: int = 0, exact: bool = False) -> DataFrame:
    """The records that :func:`reservoir` doesn't retain or, if exact, that :func:`best` doesn't.

    Instead of ranking a whole contributor in one task, the reservoir's last
    key becomes the contributor's threshold; a record is out if it lies behind
    it.  The threshold join is an ordinary equi-join, which AQE splits where a
    contributor is hot.  Of the records at the threshold, which differ in
    neither key nor ident, as many are out as the reservoir doesn't hold.
    Null idents come first, as in the reservoir.
    """
    kept = best(df, contributor, ident, score, cap, temperature, seed) if exact else reservoir(df, contributor, ident, score, cap, temperature, seed)
    temperature = 0.0 if exact else temperature
    names = [f"_c{i}" for i in range(len(contributor))]
    edge = F.struct(F.col("race").alias("race"), F.col(ident).alias("ident"))
    per = kept.select(*(F.col(c).alias(n) for c, n in zip(contributor, names, strict=True)), "race_rank", edge.alias("_edge"))
    # at most cap rows of a contributor
    held = per.groupBy(*names).agg(F.max_by("_edge", "race_rank").alias("_last"), F.max("race_rank").alias("_full"), F.collect_list("_edge").alias("_all"))
    bound = held.where(F.col("_full") == cap).select(*names, F.col("_last.race").alias("_race"), F.col("_last.ident").alias("_ident"), F.size(F.filter("_all", lambda e: e.eqNullSafe(F.col("_last")))).alias("_held"))
    keyed = df.withColumn("race", race_key(F.col(score), F.col(ident), temperature, seed))
    on = _same(contributor, names)
    later = (F.col(ident).isNotNull() & F.col("_ident").isNull()) | F.coalesce(F.col(ident) > F.col("_ident"), F.lit(False))
    behind = (F.col("race") < F.col("_race")) | ((F.col("race") == F.col("_race")) & later)
    level = (F.col("race") == F.col("_race")) & F.col(ident).eqNullSafe(F.col("_ident"))
    joined = keyed.join(bound, on & (behind | level))
    out = joined.where(behind)
    w = Window.partitionBy(*names).orderBy(F.lit(0))
    again = joined.where(level).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > F.col("_held")).drop("_n")
    return out.unionByName(again).drop("_race", "_ident", "_held", *names)


def cap_by_share(df: DataFrame, within: Sequence[str], contributor: Sequence[str], ident: str, score: str, share: float, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """Each contributor limited to ceil(share x the records of its group), before capping, with ``race_rank``.

    ``within`` names the group (such as the query), ``contributor`` the
    contributor inside it.  Ranks are exact without ranking a hot contributor in
    one task: rows are range-partitioned by contributor, key and ident, ranked
    in their pieces, and moved by the sizes of the pieces before.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    keyed = df.withColumn("race", race_key(F.col(score), F.col(ident), temperature, seed)).withColumn("_low", -F.col("race"))
    ranked = ordering.numbered(keyed, [*within, *contributor], ["_low", ident], "race_rank")
    sizes = df.groupBy(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(within))).agg(F.count("*").alias("_all"))
    joined = ranked.join(sizes, _same(within, [f"_w{i}" for i in range(len(within))]))
    return joined.where(F.col("race_rank") <= F.ceil(F.col("_all") * share)).drop("_low", "_all", *[f"_w{i}" for i in range(len(within))])


def hits_of_authors(hits: DataFrame, tweets: DataFrame) -> DataFrame:
    """Distinct hits (query_id, tweet_id, author_id, score) of posts whose author is known.

    A post repeated in a query counts once with its highest score, a null or
    NaN score being below every number.  Posts are taken once however often
    they were delivered.
    """
    s = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(LOWEST)).otherwise(F.col("score"))
    once = hits.select("query_id", "tweet_id", s.alias("score")).groupBy("query_id", "tweet_id").agg(F.max("score").alias("score"))
    author = tweets.select(F.col("id").alias("tweet_id"), F.col("author.id").alias("author_id")).where("author_id <> ''")
    return once.join(author.groupBy("tweet_id").agg(F.max("author_id").alias("author_id")), "tweet_id")
