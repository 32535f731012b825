import json

import pytest
from helpers import frame, post

from tidemark import api, export
from test_archive import page, raw


@pytest.fixture(scope="module")
def tweets(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("posts") / "t")
    frame(spark, post("1", "cat and dog #pets", urls=["https://a.example/x"]), post("2", "cat #pets @bob"), post("3", "bird")).write.parquet(path)
    return path


def own(spark, tweets, **kwargs):
    return api.Archive.of_tweets(spark.read.parquet(tweets), **kwargs)


def test_reasons(spark, tweets):
    asked = []

    def chat(prompt):
        asked.append(prompt)
        return '[{"id": "1", "relevance": 0.5, "why": "both"}, {"id": "9", "relevance": 1}]'

    got = {r["tweet_id"]: r["why"] for r in own(spark, tweets, chat=chat).search_likes("cat dog", with_why=True)}
    assert got == {"1": "both", "2": ""} and "[id=1]" in asked[0]
    assert all(r["why"] == "" for r in own(spark, tweets, chat=lambda p: 1 / 0).search_likes("cat", with_why=True))


def test_pages_are_fetched_once(spark, tweets):
    a = own(spark, tweets, fetch=lambda u: (u + "/", "text/html; charset=utf-8", "a body"))
    assert a.synthesize_likes("cat", fetch_urls=True)["fetched_url_count"] == 1
    a.fetch = lambda u: (u, "image/png", "no")
    assert a.synthesize_likes("cat", fetch_urls=True)["fetched_url_count"] == 1
    assert own(spark, tweets).synthesize_likes("cat", fetch_urls=True)["fetched_url_count"] == 0


def test_entities_judged(spark, tweets):
    said = own(spark, tweets, judge=lambda q, names: ["hashtag:pets"]).mindmap("cat")
    assert "pets" in said and "bob" not in said


def test_kept_index(spark, tweets, tmp_path):
    path = str(tmp_path / "index")
    want = own(spark, tweets, index_path=path).search_likes("cat")
    again = own(spark, tweets, index_path=path)
    assert again.index.postings.inputFiles()[0].startswith(f"file:{path}") or path in again.index.postings.inputFiles()[0]
    assert again.search_likes("cat") == want


def test_command_line(spark, tweets, tmp_path, capsys):
    index = str(tmp_path / "index")
    assert api.main([tweets, "--init"], spark) == 2
    assert api.main([tweets, "--init", "--index", index], spark) == 0
    assert api.main([tweets, "--search", "cat", "--json", "--index", index], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["handle"] == "ann"
    assert api.main([tweets, "--kg", "cat", "--json"], spark) == 0
    assert {n["kind"] for n in json.loads(capsys.readouterr().out)["nodes"]} >= {"query", "tweet", "hashtag"}
    assert api.main([tweets, "--search", " "], spark) == 2
    assert api.main([tweets, "--search", "a", "--kg", "b"], spark) == 2
    demo = tmp_path / "demos.json"
    demo.write_text(json.dumps([{"query": "q", "fenced_context_raw": "c", "expected_outputs": {"a": 1}}, {"query": "q"}]))
    assert api.main([tweets, "--report-optimize", str(demo)], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"examples": 1}


def test_export_command_line(spark, tmp_path, capsys):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p1.json").write_text(page([raw("1"), raw("2")]))
    out = str(tmp_path / "out")
    args = [str(pages), "--user", "u", "--output", out, "--format", "json", "--format", "csv"]
    assert export.main(args, spark) == 0 and capsys.readouterr().out.strip() == "2 posts"
    (pages / "p2.json").write_text(page([raw("2"), raw("3")]))
    assert export.main([*args, "--resume", "--stats"], spark) == 0
    assert json.loads(capsys.readouterr().out)["total"] == 3
    assert sorted(r.id for r in spark.read.json(f"{out}/likes.json").collect()) == ["1", "2", "3"]
    assert export.main([str(pages), "--user", "other", "--output", out, "--resume"], spark) == 1
    bad = tmp_path / "cookies.json"
    bad.write_text(json.dumps([{"name": "ct0", "value": "x"}]))
    assert export.main([*args, "--cookies", str(bad)], spark) == 1
    assert export.main([str(tmp_path / "none"), "--user", "u", "--output", out], spark) == 1
