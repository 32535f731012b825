"""Command line of the exporter: saved pages of an interface become an archive and its formats."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import posts as P
from tidemark.sources import archive, sinks
from tidemark.streaming import ingest

FORMATS = ("json", "csv", "markdown", "html", "parquet", "excel")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Takes new pages into the archive in --output, each post once, and writes the formats.  0, or 1 for what can't be done.

    Without --resume the archive is begun anew.  The checkpoint names the user
    and keeps what pages were taken; another user's is refused.
    """
    from tidemark.session import local

    parser = argparse.ArgumentParser(prog="tidemark-export")
    parser.add_argument("pages", help="folder of saved pages")
    parser.add_argument("--cookies", help="JSON list of cookies; required ones must be there")
    parser.add_argument("--user", required=True)
    parser.add_argument("--output", default="output")
    parser.add_argument("--format", action="append", choices=FORMATS)
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--stats", action="store_true")
    parser.add_argument("--single-file", action="store_true", help="Markdown in one table of lines, not by month")
    parser.add_argument("--checkpoint", help="folder; default: below --output")
    parser.add_argument("--clear-checkpoint", action="store_true")
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or local()
    if a.cookies:
        try:
            with open(a.cookies, encoding="utf-8") as f:
                rows = [(i, c["name"], c["value"]) for i, c in enumerate(json.load(f))]
            missing = archive.cookies(spark.createDataFrame(rows, "seq int, name string, value string")).first().missing
        except (OSError, ValueError, KeyError, TypeError) as e:
            print(f"cookies: {e}", file=sys.stderr)
            return 1
        if missing:
            print(f"cookies: {', '.join(missing)} missing", file=sys.stderr)
            return 1
    if not os.path.isdir(a.pages):
        print(f"no folder {a.pages}", file=sys.stderr)
        return 1
    mark, state = f"{a.output}/user.json", a.checkpoint or f"{a.output}/.checkpoint"
    os.makedirs(a.output, exist_ok=True)
    if a.resume and os.path.exists(mark) and ingest.Checkpoint.load(mark, a.user) is None:
        print("the checkpoint is another user's", file=sys.stderr)
        return 1
    saved = f"{a.output}/archive"
    if not a.resume or a.clear_checkpoint:
        for at in (state, *([] if a.resume else [saved])):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    ingest.Checkpoint(a.user, None).save(mark)
    ingest.new_posts(ingest.read_pages(spark, a.pages), saved, state).awaitTermination()
    if not any(n.startswith("batch=") for n in (os.listdir(saved) if os.path.isdir(saved) else ())):
        print("no posts", file=sys.stderr)
        return 1
    posts = P.newest_by_id(spark.read.parquet(saved).withColumnRenamed("user", "author"), F.col("batch")).drop("page", "i", "j", "batch")
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    for kind in a.format or ("json", "csv", "markdown", "html"):
        if kind == "json":
            sinks.write_json(posts, f"{a.output}/likes.json")
        elif kind == "markdown":
            sinks.write_markdown(posts, f"{a.output}/likes.md", now) if a.single_file else sinks.write_months(posts, f"{a.output}/by_month")
        elif kind == "html":
            sinks.write_html(posts, f"{a.output}/likes.html", now)
        else:
            sinks.write_flat(posts, f"{a.output}/likes.{'xlsx' if kind == 'excel' else kind}", kind)
    print(json.dumps(P.stats(posts).first().asDict()) if a.stats else f"{posts.count()} posts")
    return 0


if __name__ == "__main__":
    sys.exit(main())
