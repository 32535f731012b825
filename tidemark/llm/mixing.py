"""Problem 8: mixing sources to target weights.

Method: entropy balancing.  Among all document rates the one of least relative
entropy to one copy of each document is sought under a token constraint for each
source; its dual is convex, and its solution tilts the rates exponentially: a
document of t tokens has the rate min(max_repeats, exp(lambda t / mean t)), with
one lambda for its source.  Newton iterations on the dual run over the counts of
documents by source and length, aggregated by the cluster at each step (the rate
is the same for all documents of a cell); rates are then rounded into copies, from
the longest documents to the shortest, each cell making up for the tokens the
cells before it were rounded by, so that a source ends within a short document of
its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import spread_rank
from tidemark.storage import materialize


@dataclass
class Target:
    """What one source is to contribute."""

    source: str
    share: float
    repeats: int
    have: int = 0  # tokens of one copy of everything
    mean: float = 1.0  # tokens of a document
    want: float = 0.0  # tokens
    tilt: float = 0.0  # lambda; infinite where every document is repeated as often as allowed


def source_key(column):
    """Sources are the same without regard to letter case and blanks around."""
    return F.lower(F.trim(column))


def _targets(targets: DataFrame) -> dict[str, Target]:
    rows = targets.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").where("s IS NOT NULL AND target_share > 0").orderBy("s", "target_share").collect()  # one row for each source named
    out: dict[str, Target] = {}
    for r in rows:
        out.setdefault(r.s, Target(r.s, float(r.target_share), 1 if r.max_repeats is None else int(r.max_repeats)))
    return {k: x for k, x in out.items() if x.repeats > 0}


def solve(cells: DataFrame, targets: dict[str, Target], total: float | None = None, tolerance: float = 1e-7, steps: int = 60) -> None:
    """Sets want and tilt of the targets, from cells (source, tokens, n)."""
    for r in cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect():
        targets[r.source].have, targets[r.source].mean = int(r.t), r.t / r.n
    there = [x for x in targets.values() if x.have]
    if not there:
        return
    named = sum(x.share for x in there)
    most = min(x.repeats * x.have / (x.share / named) for x in there)
    total = most if total is None else total
    for x in there:
        x.want = min(x.share / named * total, float(x.repeats * x.have))
    lo, hi = {x.source: -60.0 for x in there}, {x.source: 60.0 for x in there}
    open_ = {x.source: x for x in there}
    for x in there:
        if x.want >= x.repeats * x.have * (1 - 1e-9):
            x.tilt = float("inf")
            del open_[x.source]
    for _ in range(steps):
        if not open_:
            return
        tilt = F.create_map(*[F.lit(v) for x in open_.values() for v in (x.source, x.tilt / x.mean)])
        cap = F.create_map(*[F.lit(v) for x in open_.values() for v in (x.source, float(x.repeats))])
        raw = F.exp(F.least(tilt[F.col("source")] * F.col("tokens"), F.lit(50.0)))
        rate = F.least(raw, cap[F.col("source")])
        now = cells.where(F.col("source").isin(list(open_))).groupBy("source")
        got = now.agg(F.sum(F.col("n") * F.col("tokens") * rate).alias("f"), F.sum(F.when(raw < cap[F.col("source")], F.col("n") * F.col("tokens") * F.col("tokens") * rate).otherwise(0.0)).alias("h")).collect()
        for r in got:
            x = open_[r.source]
            gap = r.f - x.want
            if abs(gap) <= tolerance * x.want:
                del open_[r.source]
                continue
            if gap > 0:
                hi[x.source] = x.tilt
            else:
                lo[x.source] = x.tilt
            step = x.tilt - gap / (r.h / x.mean) if r.h > 0 else float("nan")
            x.tilt = step if lo[x.source] < step < hi[x.source] else (lo[x.source] + hi[x.source]) / 2


def _rounded(cells: pa.Table) -> pa.Table:
    """Copies of a source's cells: base for each document, one more for ``extra`` of them.  There are at most as many cells as lengths."""
    cells = cells.sort_by([("tokens", "descending")])
    t, n, rate = (np.asarray(cells[c]) for c in ("tokens", "n", "rate"))
    base = np.floor(rate + 1e-12).astype(np.int64)
    extra = np.zeros(len(t), np.int64)
    owed = 0.0
    for i, want in enumerate(np.maximum(n * (rate - base), 0.0) * t):
        owed += want
        extra[i] = min(max(round(owed / t[i]), 0), int(n[i]) if want > 0 else 0)
        owed -= extra[i] * t[i]
    return pa.table({"source": cells["source"], "tokens": cells["tokens"], "base": pa.array(base), "extra": pa.array(extra)})


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> tuple[DataFrame, dict[str, Target]]:
    """((id, source, tokens, copies), targets) for (id, source, tokens) and (source, target_share, max_repeats).

    Shares are of the chosen tokens, among the named sources that have any; by
    default the total is the largest with which each of them can reach its
    share, and no document is repeated more than its source allows.  Sources
    are compared without letter case and blanks around; documents of other
    sources, of null source and without tokens are not chosen; a target named
    twice counts with its smaller share, one without a number of repeats once,
    and one of 0 repeats or less not at all; empty tables give no row.
    """
    wanted = _targets(targets)
    rows = sizes.select("id", source_key(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens")).where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    cells = materialize(rows.groupBy("source", "tokens").agg(F.count("*").alias("n")), "cells")
    solve(cells, wanted, total)
    there = [x for x in wanted.values() if x.have] or [Target("", 1.0, 1)]
    tilt = F.create_map(*[F.lit(v) for x in there for v in (x.source, (x.tilt if np.isfinite(x.tilt) else 1e6) / x.mean)])
    cap = F.create_map(*[F.lit(v) for x in there for v in (x.source, float(x.repeats))])
    rate = F.least(F.exp(F.least(tilt[F.col("source")] * F.col("tokens"), F.lit(50.0))), cap[F.col("source")])
    exact = cells.select("source", "tokens", "n", rate.alias("rate"))
    extra = exact.groupBy("source").applyInArrow(_rounded, "source string, tokens bigint, base bigint, extra bigint")
    ranked = spread_rank(rows, ["source", "tokens"], "id", salts=16, seed=seed).join(extra, ["source", "tokens"])
    copies = (F.col("base") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)).cast("int")
    return ranked.select("id", "source", "tokens", copies.alias("copies")).where("copies > 0"), wanted


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, tokens, share) of every target, reached or not."""
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    out = want.join(per, "source", "left").withColumn("_all", F.sum("tokens").over(Window.partitionBy()))  # one row for each target
    return out.select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens")], F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("share"))
