import json
import os

import pytest
from helpers import frame, photo, post
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import posts as P
from tidemark.sources import archive, sinks
from tidemark.streaming import ingest


def saved(ident, **extra):
    return {"id": ident, "text": "hi", "created_at": "Sun Nov 09 11:05:17 +0000 2025", "user": {"id": "1", "screen_name": "ann", "name": "Ann"}} | extra


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8")
    return str(path)


def test_load_export(spark, tmp_path):
    quoted = saved("9", quoted_tweet=saved("10"))
    f = write(tmp_path / "a.json", [saved("1", media=[{"type": "photo", "url": "u", "width": 3}], urls=["x"], raw_data={"a": [1]}), saved("2", quoted_tweet=quoted, is_quote=True)])
    got = {r.id: r for r in archive.load_export(spark, f).collect()}
    assert got["1"].media[0].width == 3 and got["1"].lang == "en" and got["1"].view_count == 0 and got["1"].hashtags == []
    assert got["2"].quoted_tweet.id == "9" and json.loads(got["2"].quoted_tweet.quoted_tweet.toJson())["id"] == "10"


@pytest.mark.parametrize("bad", ["{}", "[1", [{"id": "1"}], [saved("1", media=[{"type": "photo"}])], "", [saved("1") | {"user": {"id": "1"}}]])
def test_load_export_strict(spark, tmp_path, bad):
    with pytest.raises(archive.ExportError):
        archive.load_export(spark, write(tmp_path / "a.json", bad))


def page(posts, cursor=None):
    entries = [{"content": {"entryType": "TimelineTimelineItem", "itemContent": {"tweet_results": {"result": p}}}} for p in posts]
    if cursor:
        entries += [{"content": {"entryType": "TimelineTimelineCursor", "cursorType": "Top", "value": "t"}}, {"content": {"entryType": "TimelineTimelineCursor", "cursorType": "Bottom", "value": cursor}}]
    return json.dumps({"data": {"user": {"result": {"timeline": {"timeline": {"instructions": [{"type": "Other"}, {"type": "TimelineAddEntries", "entries": entries}]}}}}}})


def raw(ident, **legacy):
    return {"rest_id": ident, "legacy": {"full_text": f"t{ident}", "created_at": "c"} | legacy, "core": {"user_results": {"result": {"rest_id": "5", "core": {"screen_name": "new"}, "legacy": {"screen_name": "old", "name": "Old", "followers_count": 7}}}}, "views": {"count": "12"}}


def test_pages(spark):
    p = page([raw("1", entities={"urls": [{"expanded_url": "e"}], "hashtags": [{"text": "h"}]}, extended_entities={"media": [{"type": "video", "media_url_https": "m", "original_info": {"width": 4}}]}, retweeted_status_result={}), {"rest_id": "2"}, raw("3") | {"views": {"count": "many"}}], "next")
    df = spark.createDataFrame([("a", p), ("b", "{}"), ("c", "broken"), ("d", page([]))], "page string, json string")
    got = {r.id: r for r in archive.page_posts(df).collect()}
    assert set(got) == {"1", "3"}
    one = got["1"]
    assert (one.user.screen_name, one.user.name, one.user.followers_count, one.view_count) == ("new", "Old", 7, 12)
    assert (one.urls, one.hashtags, one.is_retweet, one.is_quote) == (["e"], ["h"], True, False)
    assert (one.media[0].type, one.media[0].media_url, one.media[0].width) == ("video", "m", 4)
    assert got["3"].view_count == 0
    assert rows(archive.page_cursors(df)) == [("a", "next")]


MONTH = """## 2025-01 (2 tweets)

### [@ann](https://x.com/ann)
**Ann**

text one

🔗 [View on X](https://x.com/ann/status/1001)

---

### @bob
see https://twitter.com/zed/status/7 and https://x.com/bob/status/8

### [@nobody](https://x.com/nobody)
no address
"""


def test_markdown(spark, tmp_path):
    write(tmp_path / "likes_2025-01.md", MONTH)
    write(tmp_path / "likes_2025-02.md", "nothing")
    write(tmp_path / "likes_unknown.md", MONTH)
    files = archive.month_files(spark, str(tmp_path))
    assert [r.year_month for r in files.collect()] == ["2025-02", "2025-01"]
    got = archive.sections(files).orderBy("seq").collect()
    assert [(r.tweet_id, r.handle) for r in got] == [("1001", "ann"), ("7", "bob")]
    assert got[0].text == "**Ann**\n\ntext one\n\n\n---"
    with pytest.raises(FileNotFoundError):
        archive.month_files(spark, str(tmp_path / "none"))
    (tmp_path / "void").mkdir()
    assert archive.month_files(spark, str(tmp_path / "void")).count() == 0
    months = P.list_months(files, frame(spark, post("1", created="Wed Jan 01 00:00:00 +0000 2025"))).collect()
    assert [(r.year_month, r.tweet_count) for r in months] == [("2025-02", None), ("2025-01", 1)]


def test_media_on_disk(spark, tmp_path):
    (tmp_path / "1_0.png").write_bytes(b"x")
    df = frame(spark, post("1", media=[photo(), photo(media_url="https://m.example/b.jpg?y")]), post("2", media=None))
    assert rows(archive.media_to_fetch(df, archive.local_media(spark, str(tmp_path))), "tweet_id", "pos", "url") == [("1", 1, "https://m.example/b.jpg?format=jpg&name=orig")]


def test_page_cache(spark):
    schema = "url_key string, url string, final_url string, content_type string, sanitized_markdown string, fetched_at double"
    cache = spark.createDataFrame([], schema)
    new = spark.createDataFrame([("u", "f", "text/html", "old", 0.0), ("v", "f", "text/html", "v", 90000.0)], schema.split(", ", 1)[1])
    cache = archive.put_pages(cache, new)
    cache = archive.put_pages(cache, new.where("url = 'v'").withColumn("sanitized_markdown", F.lit("v2")))
    asked = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    assert rows(archive.cached(cache, asked, F.lit(100000.0), 1), "url", "sanitized_markdown") == [("v", "v2")]


def test_cookies(spark):
    got = archive.cookies(spark.createDataFrame([(1, "ct0", "a"), (2, "ct0", "b")], "seq int, name string, value string")).first()
    assert (got.cookies, got.missing) == ({"ct0": "b"}, ["auth_token"])


def test_flat_and_stats(spark):
    df = frame(spark, post("1", media=[photo(), photo(kind="video")], hashtags=["a", "b"], verified=True), post("2", author=None, handle=None), post("2", author="", media=[]))
    flat = {r.tweet_id: r for r in P.flat(df).collect()}
    assert len(P.flat(df).columns) == 23
    assert (flat["1"].media_types, flat["1"].hashtags, flat["1"].media_count, flat["1"].has_media) == ("photo,video", "a,b", 2, True)
    assert flat["2"].user_verified is False
    s = P.stats(df).first()
    assert (s.total, s.with_media, s.total_media, s.unique_authors, s.verified_authors) == (3, 1, 2, 1, 1)
    assert P.stats(frame(spark)).first().total == 0
    assert P.flat(frame(spark)).count() == 0


def test_latest_and_merge(spark):
    from datetime import datetime

    df = frame(spark, post("1", fav=1), post("1", fav=5, fetched=datetime(2025, 12, 9)), post("1", fav=3), post(None), post("2"))
    assert rows(P.latest(df), "id", "favorite_count") == [("1", 5), ("2", 0)]
    assert rows(P.new_only(frame(spark, post("2"), post("3"), post("3")), frame(spark, post("2"))), "id") == [("2",), ("3",), ("3",)]
    assert json.loads(P.read_post(P.latest(df), "1").first().post) == {"tweet_id": "1", "handle": "ann", "display_name": "Ann", "created_at": "Sun Nov 09 11:05:17 +0000 2025", "url": "https://x.com/ann/status/1", "like_count": 5}


def test_exports(spark, tmp_path):
    df = frame(spark, post("1", "a <b>", media=[photo()], fav=2), post("2", "x", created="bad", media=[photo(local="media/1_0.png")]))
    out = sinks.export_all(df, str(tmp_path), "now")
    assert set(out) == {"json", "csv", "markdown", "html"}
    assert spark.read.csv(out["csv"], header=True).count() == 2
    html = "".join(r.value for r in spark.read.text(out["html"]).collect())
    assert "a &lt;b&gt;" in html and "<img src='https://media.example/a.png'" in html and "Total: 2" in html
    sinks.write_months(df, str(tmp_path / "months"))
    assert sorted(os.listdir(tmp_path / "months")) == ["likes_2025-11.md", "likes_unknown.md"]
    body = (tmp_path / "months/likes_2025-11.md").read_text()
    assert "## 2025-11 (1 tweets)" in body and "*❤️ 2*" in body and "![Image](https://media.example/a.png)" in body
    assert [r.tweet_id for r in archive.sections(archive.month_files(spark, str(tmp_path / "months"))).collect()] == ["1"]
    text = "\n".join(r.line for r in sinks.json_array(df.select("id", "text")).orderBy("seq").collect())
    assert [p["id"] for p in json.loads(text)] == ["1", "2"]
    with pytest.raises(ValueError):
        sinks.write_flat(df, str(tmp_path / "x"), "dbf")


def test_corpus_cache(spark, tmp_path):
    v = spark.createDataFrame([("1", [1.0, 0.0])], "id string, v array<float>")
    sinks.save_corpus(v, str(tmp_path / "c"), "m")
    got = spark.read.parquet(str(tmp_path / "c"))
    ids = v.select("id")
    assert sinks.corpus_valid(got, ids, "m", 2)
    assert not sinks.corpus_valid(got, ids, "other", 2)
    assert not sinks.corpus_valid(got, ids, "m", 3)
    assert not sinks.corpus_valid(got, ids.unionByName(spark.createDataFrame([("2",)], "id string")), "m", 2)


def test_page_stream(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    write(folder / "p1.json", page([raw("1"), raw("2")], "c1"))
    write(folder / "p2.json", page([raw("2"), raw("3")], "c2"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        ingest.new_posts(ingest.read_pages(spark, str(folder), 1), out, check).awaitTermination()
        return rows(spark.read.parquet(out), "id")

    assert run() == [("1",), ("2",), ("3",)]
    write(folder / "p3.json", page([raw("3"), raw("4")]))
    assert run() == [("1",), ("2",), ("3",), ("4",)]


def test_paging():
    asked = []

    def call(cursor):
        asked.append(cursor)
        return {None: page([raw("1")], "a"), "a": page([raw("2")], "b"), "b": page([], "c")}[cursor]

    assert [c for c, _ in ingest.pages(call)] == [None, "a", "b"] == asked
    assert len(list(ingest.pages(call, 1))) == 1
    assert len(list(ingest.pages(lambda c: "broken"))) == 1


def test_checkpoint(tmp_path):
    path = str(tmp_path / "c.json")
    ingest.Checkpoint("u", "c").save(path)
    assert ingest.Checkpoint.load(path, "u").cursor == "c"
    assert ingest.Checkpoint.load(path, "v") is None
    ingest.Checkpoint.clear(path)
    assert ingest.Checkpoint.load(path, "u") is None
