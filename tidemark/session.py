"""Session settings the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC everywhere; AQE sizes partitions, splits skewed joins and picks join strategies at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with these settings; conf (dots as double underscores) overrides them.

    checkpoint_dir is the folder all executors share, for intermediate tables;
    on a cluster it must be given here or in the cluster's own settings.
    """
    b = SparkSession.builder.appName("tidemark")
    if master:
        b = b.master(master)
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return session(f"local[{n}]", **({"spark__sql__shuffle__partitions": str(n), "spark__ui__enabled": "false", "spark__driver__memory": "8g"} | conf))
