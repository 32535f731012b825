"""Incremental ingest: pages as a stream with a cursor, posts taken once.

A page source hands out JSON pages by cursor; here it replays pages that were
saved, or calls an injected function.  The stream's checkpoint keeps the cursor,
so a restart goes on where it stopped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import archive


def pages(call: Callable[[str | None], str], most: int | None = None) -> Iterator[tuple[str | None, str]]:
    """(cursor, page) from the first page on; ends without a next cursor, at a page without posts, or after ``most`` pages."""
    cursor, n = None, 0
    while most is None or n < most:
        page = call(cursor)
        entries = list(_entries(page))
        yield cursor, page
        n += 1
        following = next((e.get("value") for e in entries if e.get("entryType") == "TimelineTimelineCursor" and e.get("cursorType") == "Bottom"), None)
        if not following or not any(e.get("entryType") == "TimelineTimelineItem" for e in entries):
            return
        cursor = following


def _entries(page: str) -> Iterator[dict]:
    try:
        at = json.loads(page)
        for name in ("data", "user", "result", "timeline", "timeline", "instructions"):
            at = at[name]
        for step in at:
            if step.get("type") == "TimelineAddEntries":
                for e in step.get("entries", []):
                    yield e.get("content", {})
    except (ValueError, KeyError, TypeError, AttributeError):
        return


@dataclass
class PagePart(InputPartition):
    """Pages that one task reads."""

    names: tuple[str, ...]


class PageReader(DataSourceStreamReader):
    """Pages of a folder of saved pages in order of name; the offset is the last name read.

    The driver only lists names; the pages' bodies are read by the tasks, some
    pages each.  The folder must be one that all executors share.
    """

    def __init__(self, folder: str, each: int):
        self.folder, self.each = folder, each

    def initialOffset(self) -> dict:
        return {"after": ""}

    def _names(self) -> list[str]:
        from pyarrow import fs

        system, at = _place(self.folder)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".json"))

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[PagePart]:
        names = [n for n in self._names() if start["after"] < n <= end["after"]]
        return [PagePart(tuple(names[i : i + self.each])) for i in range(0, len(names), self.each)]

    def read(self, partition: PagePart) -> Iterator[tuple]:
        system, at = _place(self.folder)
        for n in partition.names:
            with system.open_input_stream(f"{at}/{n}") as f:
                yield n, f.read().decode("utf-8")

    def commit(self, end: dict) -> None:
        pass


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")


class PageSource(DataSource):
    """``saved_pages``: a stream of (page, json) from a folder (option path; each: pages to a task)."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "page string, json string"

    def streamReader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("each", "20")))


def read_pages(spark: SparkSession, folder: str, each: int = 20) -> DataFrame:
    """The pages of a folder as a stream, ``each`` of them to a task."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("saved_pages").option("path", folder).option("each", str(each)).load()


def taken(stream: DataFrame, key: str, order: tuple[str, ...], saved: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends the rows that parse makes of a stream to a Parquet table, each key once (its first row by order), until nothing new is there.

    What has been taken is the table itself: each batch is joined against its
    keys, so the stream keeps no state that grows, and rows of any age count.  A
    batch that is repeated after a failure replaces what it had written.  Null
    keys are left out; orders of a key in a batch must differ for a definite row.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = parse(batch).where(F.col(key).isNotNull())
        one = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_one")).select(key, "_one.*").select(*rows.columns)
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved)
        if number and there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            kind = rows.schema[key].dataType.simpleString()
            old = spark.read.schema(f"`{key}` {kind}, batch bigint").parquet(saved).where(F.col("batch") < number)
            one = one.join(old.select(key), key, "left_anti").select(*rows.columns)
        one.write.mode("overwrite").parquet(f"{saved}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_posts(stream: DataFrame, saved: str, checkpoint: str) -> StreamingQuery:
    """The posts of a stream of pages, each id once, in a Parquet table (see :func:`taken`)."""
    return taken(stream, "id", ("page", "i", "j"), saved, checkpoint, archive.page_posts)


def new_deliveries(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream of posts with fetched_at, each id once within the delay; state older than that is dropped."""
    return stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["id"])


def activity(stream: DataFrame, every: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(start, lang, posts) of a stream of posts by time fetched; late posts count within the delay."""
    return stream.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", every), "lang").agg(F.count("*").alias("posts")).select(F.col("window.start").alias("start"), "lang", "posts")


def sink(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table, exactly once, until nothing new is there."""
    return posts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


@dataclass(frozen=True)
class Checkpoint:
    """Where a fetch without a stream stopped: whose it is, and the cursor."""

    user: str
    cursor: str | None

    def save(self, path: str) -> None:
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump({"user": self.user, "cursor": self.cursor}, f)
        os.replace(f"{path}.new", path)

    @staticmethod
    def load(path: str, user: str) -> Checkpoint | None:
        """The checkpoint of this user; None where there is none, it can't be read, or it is another's."""
        try:
            with open(path, encoding="utf-8") as f:
                got = json.load(f)
            return Checkpoint(got["user"], got.get("cursor")) if got["user"] == user else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    @staticmethod
    def clear(path: str) -> None:
        if os.path.exists(path):
            os.remove(path)
