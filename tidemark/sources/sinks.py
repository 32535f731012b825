"""Writing an archive: flat tables, JSON, Markdown by month, HTML, caches."""

from __future__ import annotations

import os
import uuid

from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import ordering
from tidemark.operators import posts as P

FORMATS = ("csv", "parquet", "json", "markdown", "html", "excel")


def write_flat(posts: DataFrame, path: str, format: str) -> None:
    """The flat table as csv (with a header), parquet or excel (where openpyxl is there; one sheet, so at most its million rows)."""
    flat = P.flat(posts)
    if format == "csv":
        flat.write.mode("overwrite").csv(path, header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif format == "parquet":
        flat.write.mode("overwrite").parquet(path)
    elif format == "excel":
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise RuntimeError("Excel needs openpyxl") from e
        if flat.limit(1_048_576).count() == 1_048_576:
            raise ValueError("too many rows for a sheet")
        flat.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"unknown format: {format!r}")


def write_json(posts: DataFrame, path: str) -> None:
    """One JSON post to a line; nulls, such as absent quoted posts, are left out."""
    posts.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def json_array(posts: DataFrame, ident: str = "id") -> DataFrame:
    """(seq, line) of a JSON array: the lines of all posts and, first and last, its brackets; sorted by seq they are the file."""
    # commas stand before all posts but the first by id
    first = posts.agg(F.min(ident)).first()[0]
    body = posts.select(F.lit(1).alias("seq"), F.col(ident).alias("k"), F.concat(F.when(F.col(ident) == first, "  ").otherwise(" ,"), F.to_json(F.struct(*posts.columns))).alias("line"))
    ends = posts.sparkSession.createDataFrame([(0, "", "["), (2, "", "]")], "seq int, k string, line string")
    return ends.unionByName(body).orderBy("seq", "k").select("seq", "line")


def markdown_block(posts: DataFrame, include_media: bool = True, base: str | None = None) -> Column:
    """The Markdown of one post, from its columns."""
    c = F.col
    handle = F.coalesce(c("author.screen_name"), F.lit(""))
    moment = F.coalesce(F.date_format(dates.post_time(c("created_at")), "yyyy-MM-dd HH:mm:ss"), c("created_at"), F.lit(""))

    def medium(m: Column) -> Column:
        path = text.relative_path(m["local_path"], base) if base else m["local_path"]
        kept = F.when(m["type"] == "photo", F.concat(F.lit("![Image]("), path, F.lit(")\n"))).when(m["type"] == "video", F.concat(F.lit("🎥 [Video]("), path, F.lit(")\n"))).when(m["type"] == "animated_gif", F.concat(F.lit("![GIF]("), path, F.lit(")\n")))
        linked = F.when((m["type"] == "photo") & (m["media_url"] != ""), F.concat(F.lit("![Image]("), m["media_url"], F.lit(")\n"))).when(m["url"] != "", F.concat(F.lit("🔗 ["), m["type"], F.lit("]("), m["url"], F.lit(")\n")))
        return F.when(F.coalesce(m["local_path"], F.lit("")) != "", kept).otherwise(linked)

    none = F.array().cast("array<string>")
    media = F.filter(F.transform("media", medium), lambda x: x.isNotNull())
    media_lines = F.when(F.coalesce(F.size("media"), F.lit(0)) > 0, F.concat(F.array(F.lit("**Media:**\n")), media)).otherwise(none) if include_media else none
    stat = lambda sign, name: F.when(F.coalesce(c(name), F.lit(0)) > 0, F.concat(F.lit(sign + " "), c(name).cast("string")))
    stats = F.concat_ws(" • ", stat("🔄", "retweet_count"), stat("❤️", "favorite_count"), stat("💬", "reply_count"), stat("👁️", "view_count"))
    tags = F.when(F.coalesce(F.size("hashtags"), F.lit(0)) > 0, F.concat(F.lit("\n**Tags:** "), F.array_join(F.transform("hashtags", lambda t: F.concat(F.lit("#"), t)), " ")))
    plain_url = F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), c("id"))
    lines = F.concat(
        F.array(
            F.concat(F.lit("\n### [@"), handle, F.lit("](https://x.com/"), handle, F.lit(")")),
            F.concat(F.lit("**"), F.coalesce(c("author.name"), F.lit("")), F.lit("** "), F.when(c("author.verified"), "✓").otherwise("")),
            F.concat(F.lit("*"), moment, F.lit("*")),
            F.concat(F.lit("\n"), F.coalesce(c("text"), F.lit("")), F.lit("\n")),
        ),
        media_lines,
        F.array(F.when(stats != "", F.concat(F.lit("\n*"), stats, F.lit("*"))), F.concat(F.lit("\n🔗 [View on X]("), plain_url, F.lit(")")), tags, F.lit("\n---")),
    )
    return F.array_join(lines, "\n")


def markdown_rows(posts: DataFrame, include_media: bool = True, base: str | None = None) -> DataFrame:
    """(year_month, id, line): every post's Markdown, and before each month's posts (id '') its heading; months that can't be read are ``unknown``."""
    month = F.coalesce(dates.month_key(F.col("created_at")), F.lit("unknown"))
    rows = posts.select(month.alias("year_month"), "id", markdown_block(posts, include_media, base).alias("line"))
    title = F.when(F.col("year_month") == "unknown", "Unknown Date").otherwise(F.col("year_month"))
    heads = rows.groupBy("year_month").agg(F.count("*").alias("n")).select("year_month", F.lit("").alias("id"), F.concat(F.lit("\n## "), title, F.lit(" ("), F.col("n").cast("string"), F.lit(" tweets)\n")).alias("line"))
    return heads.unionByName(rows)


def write_months(posts: DataFrame, folder: str, include_media: bool = True) -> None:
    """likes_<month>.md files in a folder that all executors share.

    Rows are range-partitioned by month and post, so a large month is written by
    several tasks, each a piece; then the pieces of each month are joined to its
    file, as bytes, one month to a task, and take its name when it is whole.
    """
    spark = posts.sparkSession
    target = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    pieces = f"{target}/.pieces-{uuid.uuid4().hex}"
    rows = markdown_rows(posts, include_media).repartitionByRange("year_month", "id").sortWithinPartitions("year_month", "id")

    def write(part) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(pieces)
        number, out, month = TaskContext.get().partitionId(), None, None
        for r in part:
            if r.year_month != month:
                if out:
                    out.close()
                month = r.year_month
                system.create_dir(f"{at}/{month}")
                out = system.open_output_stream(f"{at}/{month}/{number:08d}")
            out.write((r.line + "\n").encode())
        if out:
            out.close()

    rows.foreachPartition(write)

    def join(part) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(target)
        _, of = fs.FileSystem.from_uri(pieces)
        for r in part:
            with system.open_output_stream(f"{at}/.likes_{r.year_month}.md") as out:
                for f in sorted(system.get_file_info(fs.FileSelector(f"{of}/{r.year_month}")), key=lambda f: f.path):
                    with system.open_input_stream(f.path) as piece:
                        while raw := piece.read(1 << 20):
                            out.write(raw)
            system.move(f"{at}/.likes_{r.year_month}.md", f"{at}/likes_{r.year_month}.md")

    months = [(r.year_month,) for r in rows.select("year_month").distinct().collect()]  # a few hundred at most
    if months:
        spark.createDataFrame(months, "year_month string").repartition(len(months), "year_month").foreachPartition(join)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pieces)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_markdown(posts: DataFrame, path: str, exported: str, include_media: bool = True) -> None:
    """One Markdown file in parts: a header, then months from the newest."""
    n = posts.count()
    head = posts.sparkSession.createDataFrame([("~~", "", f"# X (Twitter) Liked Tweets\n\n**Exported:** {exported}\n\n**Total Tweets:** {n}\n\n---\n")], "year_month string, id string, line string")
    head.unionByName(markdown_rows(posts, include_media)).orderBy(F.desc("year_month"), "id").select("line").write.mode("overwrite").text(path)


def html_block() -> Column:
    """The HTML of one post; its text is escaped."""
    c = F.col
    images = F.transform("media", lambda m: F.when((m["local_path"] != "") & (m["type"] == "photo"), m["local_path"]).when((F.coalesce(m["local_path"], F.lit("")) == "") & (m["media_url"] != ""), m["media_url"]))
    shown = F.array_join(F.transform(F.filter(images, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("<img src='"), x, F.lit("' alt='Tweet image'>"))), "")
    n = lambda name: F.coalesce(c(name), F.lit(0)).cast("string")
    handle = F.coalesce(c("author.screen_name"), F.lit(""))
    return F.concat(
        F.lit("<div class='tweet'><div class='user'><strong>"),
        F.coalesce(c("author.name"), F.lit("")),
        F.lit("</strong> @"),
        handle,
        F.lit("</div><div class='text'>"),
        text.html_escaped(F.coalesce(c("text"), F.lit(""))),
        F.lit("</div>"),
        F.when(F.coalesce(F.size("media"), F.lit(0)) > 0, F.concat(F.lit("<div class='media'>"), shown, F.lit("</div>"))).otherwise(""),
        F.lit("<div class='stats'><span>🔄 "),
        n("retweet_count"),
        F.lit("</span><span>❤️ "),
        n("favorite_count"),
        F.lit("</span><span>💬 "),
        n("reply_count"),
        F.lit("</span><a href='https://x.com/"),
        handle,
        F.lit("/status/"),
        c("id"),
        F.lit("' target='_blank'>View on X</a></div></div>"),
    )


def write_html(posts: DataFrame, path: str, exported: str) -> None:
    """One HTML page in parts, posts from the newest."""
    n = posts.count()
    head = f"<!DOCTYPE html><html lang='en'><head><meta charset='UTF-8'><title>X Liked Tweets</title></head><body><div class='container'><h1>X (Twitter) Liked Tweets</h1><p class='meta'>Exported: {exported} • Total: {n} tweets</p>"
    ends = posts.sparkSession.createDataFrame([(0, None, head), (2, None, "</div></body></html>")], "seq int, at timestamp, line string")
    body = posts.select(F.lit(1).alias("seq"), dates.post_time(F.col("created_at")).alias("at"), html_block().alias("line"))
    ends.unionByName(body).orderBy("seq", F.desc_nulls_last("at")).select("line").write.mode("overwrite").text(path)


def export_all(posts: DataFrame, folder: str, exported: str) -> dict[str, str]:
    """JSON, CSV, Markdown and HTML below folder; (format, path)."""
    out = {k: f"{folder}/likes.{e}" for k, e in (("json", "json"), ("csv", "csv"), ("markdown", "md"), ("html", "html"))}
    write_json(posts, out["json"])
    write_flat(posts, out["csv"], "csv")
    write_markdown(posts, out["markdown"], exported)
    write_html(posts, out["html"], exported)
    return out


def save_corpus(vectors: DataFrame, path: str, model: str, version: int = 1) -> None:
    """A corpus of vectors (id, v) with what it was made by in each row."""
    vectors.select("id", "v", F.lit(model).alias("model"), F.lit(version).alias("version")).write.mode("overwrite").parquet(path)


def corpus_valid(saved: DataFrame, posts: DataFrame, model: str, dims: int, version: int = 1) -> bool:
    """Whether a saved corpus is of this model, version and size, and of exactly these ids."""
    bad = saved.where((F.col("model") != model) | (F.col("version") != version) | (F.size("v") != dims)).limit(1)
    ids, want = saved.select("id").distinct(), posts.select("id").distinct()
    return bad.isEmpty() and ids.exceptAll(want).isEmpty() and want.exceptAll(ids).isEmpty()


def shown_hits(hits: DataFrame) -> DataFrame:
    """(query_id, rnk, line): hits as lines of JSON."""
    return hits.select("query_id", "rnk", F.to_json(F.struct(*[c for c in hits.columns if c not in ("query_id", "rnk")])).alias("line"))


def newest_first(posts: DataFrame) -> DataFrame:
    """posts with ``place``: by month and time, newest first, unreadable dates last."""
    at = -F.unix_micros(dates.post_time(F.col("created_at")))
    keyed = posts.withColumn("_month", dates.month_key(F.col("created_at"))).withColumn("_last", at.isNull()).withColumn("_at", at)
    return ordering.numbered(keyed, ["_month"], ["_last", "_at", "id"]).drop("_month", "_last", "_at")


def hits_as_text(hits: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, rnk, line): hits (query_id, id, rnk, score) as lines to read: place, handle, address, score, and the text with its links."""
    slim = posts.select("id", "text", "urls", F.col("author.screen_name").alias("handle"))
    shown = hits.select("query_id", "id", "rnk", "score").join(slim, "id", "left")
    said = text.expanded_links(F.coalesce(F.col("text"), F.lit("")), F.coalesce("urls", F.array().cast("array<string>")), distinct=False)
    head = F.concat(F.col("rnk").cast("string"), F.lit(". @"), F.coalesce("handle", F.lit("")), F.lit(" "), text.status_url(F.col("handle"), F.col("id")), F.lit(" ["), F.when(F.col("score").isNotNull(), F.format_string("%.3f", "score")).otherwise("-"), F.lit("]"))
    return shown.select("query_id", "rnk", F.concat(head, F.lit("\n   "), said).alias("line"))


def open_or_build_corpus(posts: DataFrame, path: str, model: str, dims: int, build: Callable[[DataFrame], DataFrame], version: int = 1) -> DataFrame:
    """The saved corpus of vectors (id, v) if it is of these posts, this model and size; else one that is built, saved and read.

    build(posts) -> (id, v).  An archive without posts has an empty corpus, of
    which nothing is saved.
    """
    spark = posts.sparkSession
    if posts.isEmpty():
        return spark.createDataFrame([], "id string, v array<float>")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not (at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) and corpus_valid(spark.read.parquet(path), posts, model, dims, version)):
        save_corpus(build(posts), path, model, version)
    return spark.read.parquet(path).select("id", "v")
