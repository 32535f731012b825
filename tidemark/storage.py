"""Where intermediate tables live.

Lineage is cut by writing a Parquet table into the folder that all executors
share (``spark.checkpoint.dir``), so a lost executor loses nothing and nothing
is computed twice.  Only a session on a local master, as in tests, may leave the
folder unnamed: a temporary one of this machine is used then.  On a cluster that
is refused, because executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_own: dict[int, str] = {}


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that all executors share."""


def named_dir(spark: SparkSession) -> str | None:
    """The shared folder that the session names, if it names one."""
    return spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder for intermediate tables; NoSharedFolder where a cluster names none."""
    named = named_dir(spark)
    if named:
        return named.rstrip("/")
    return own_dir(spark.sparkContext.master, id(spark.sparkContext))


def own_dir(master: str, key: int = 0) -> str:
    """A temporary folder of this machine, for a master that runs on this machine alone."""
    if not (master == "local" or master.startswith("local[")):
        raise NoSharedFolder(f"{_CONF} must name a folder that all executors of {master} share")
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's process ends; results may be read until then."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written once as a table of its own in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that no later result is read from."""
    for t in tables:
        if path := getattr(t, "_tidemark_path", None):
            _delete(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
