import json
from datetime import UTC, datetime

import pytest
from helpers import frame, post

from conftest import rows
from tidemark import api
from tidemark.operators import network, reports, walking

NODES = [{"id": "handle:a", "kind": "handle", "label": "a(b)", "weight": 3.0}, {"id": "hashtag:x", "kind": "hashtag", "label": "x", "weight": 1.0}, {"id": "tweet:1", "kind": "tweet", "label": "1", "weight": 1.0}]
EDGES = [{"src": "tweet:1", "dst": "handle:a", "kind": "mentions"}]


def test_mindmap():
    assert reports.mindmap("q", NODES, EDGES) == "```mermaid\nmindmap\n  root((q))\n    Handles\n      ab\n```"
    assert "        1" in reports.mindmap("q", NODES, EDGES, reverse=True)
    assert reports.mindmap("", [], []) == "```mermaid\nmindmap\n  root((unnamed))\n```"


def test_context_budget():
    hits = [reports.Hit(str(i), snippet="x" * 300) for i in range(5)]
    blob, known = reports.context("brief", hits, [("https://a.example", "y" * 500), ("ftp://b", "z")], NODES, EDGES)
    assert known == {"tweet:0", "tweet:1", "tweet:2", "tweet:3", "tweet:4", "url:https://a.example"} and blob.startswith("SHAPE: brief")
    blob, known = reports.context("brief", hits, [("https://a.example", "y" * 500)], [], [], reports.Budget(total=1200))
    assert len(blob.encode()) <= 1200 and known == {"tweet:0", "tweet:1", "tweet:2"}


def test_render():
    hits = [reports.Hit("1", "ann", "see https://t.co/x", ["https://a.example"], "2025-02"), reports.Hit("2", "", "two", [], "2025-01")]
    r = reports.Report(claims=[("A claim", ["tweet:1", "url:https://u.example", "other"])], entities=["x"], sections=[("Head", [("C", ["tweet:2"])])], clusters={"k": ["tweet:1", "9"]})
    brief = reports.render("brief", "q", hits, NODES, EDGES, r)
    assert "A claim (see: [tweet:1](https://x.com/ann/status/1), [url:https://u.example](https://u.example), other)" in brief
    assert "- [1](https://x.com/ann/status/1): see  https://a.example" in brief
    full = reports.render("synthesis", "q", hits, NODES, EDGES, r)
    assert "## Head" in full and "- 9 (no matching hit)" in full and "### Cluster: k" in full
    trend = reports.render("trend", "q", hits, NODES, EDGES)
    assert trend.index("## 2025-01") < trend.index("## 2025-02")
    months = reports.render("trend", "q", hits, [], [], reports.Report(months=[("2025-03", "s", ["tweet:1"])]))
    assert "## 2025-03\n\ns\n\n- [1](" in months
    assert "No matching tweets" in reports.render("brief", "q", [], [], [], filters={"year": 2025})
    with pytest.raises(ValueError):
        reports.render("poem", "q", hits, [], [])
    assert reports.within_words(["a b", "c d e", "f"], 4) == ["a b"]
    assert reports.unknown_sources(r, {"tweet:1"}) == ["url:https://u.example", "other", "tweet:2"]


@pytest.mark.parametrize(
    ("ip", "want"),
    [("8.8.8.8", "open"), ("10.1.2.3", "private"), ("127.0.0.1", "never"), ("169.254.169.254", "never"), ("224.0.0.1", "never"), ("0.0.0.0", "never"), ("255.255.255.255", "never"), ("fd00::1", "private"), ("::1", "never"), ("2606:4700::1", "open"), ("fe80::1", "private"), ("x", "never"), (None, "never")],
)
def test_addresses(ip, want):
    assert network.verdict(ip) == want


def test_allowlist(spark):
    assert network.parse_allowlist(" 10.1.0.0/16,, 10.2.3.4 ") == ["10.1.0.0/16", "10.2.3.4/32"]
    with pytest.raises(ValueError):
        network.parse_allowlist("nonsense")
    assert network.verdict("10.1.2.3", ["10.1.0.0/16"]) == "open"
    assert network.verdict("127.0.0.1", ["127.0.0.0/8"]) == "never"
    urls = spark.createDataFrame([("https://A.example/x",), ("http://b.example",), ("ftp://c",)], "url string")
    resolved = spark.createDataFrame([("a.example", "10.0.0.1", 0), ("a.example", "8.8.8.8", 1), ("b.example", "127.0.0.1", 0)], "host string, ip string, place int")
    assert rows(network.pinned(urls, resolved)) == [("https://A.example/x", "a.example", "8.8.8.8")]
    df = spark.createDataFrame([(["8.8.8.8"], "text/html; charset=x"), (["8.8.8.8", "10.0.0.1"], "text/html"), (["8.8.8.8"], "image/png"), (["8.8.8.8"] * 5, "text/html"), (None, "text/html"), ([None, "8.8.8.8"], "text/html")], "h array<string>, t string")
    got = network.chain_allowed(spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(df.collect())], "k int, h array<string>, t string"), "k", "h", "t")
    assert [a for _, a in rows(got)] == [True, False, False, False, False, False]


def test_fetch(spark):
    def call(u):
        if "bad" in u:
            raise OSError
        return (u + "/", "text/html", "body")

    urls = spark.createDataFrame([("https://a",), ("https://a",), ("https://bad",), (None,)], "url string")
    assert rows(network.fetch(urls, call), "url", "final_url") == [("https://a", "https://a/")]


def test_answers():
    assert walking.parse_answer('```json\n[1]\n```') == [1]
    assert walking.parse_answer('so: {"hits": []} ok') == {"hits": []}
    for bad in (None, " ", "none"):
        with pytest.raises(ValueError):
            walking.parse_answer(bad)
    given = [{"id": 1, "relevance": 0.5, "why": "w" * 300}, {"id": "2", "relevance": True}, {"id": "3", "relevance": 2}, {"id": "9", "relevance": 1}, {"relevance": 1}, 5, {"id": "4", "relevance": float("nan")}, {"id": "5", "relevance": 1, "why": None}]
    assert walking.valid_hits({"results": given}, {"1", "2", "3", "4", "5"}) == [("1", 0.5, "w" * 240), ("5", 1.0, "")]


def test_walk(spark):
    def call(prompt):
        if "[id=3]" in prompt:
            return "sorry"
        return json.dumps([{"id": "1", "relevance": 1, "why": "cat"}, {"id": "7", "relevance": 1}])

    s = spark.createDataFrame([("2025-01", 0, "1", "a", "cat"), ("2025-01", 1, "2", "b", "x"), ("2025-01", 2, "3", "b", "x"), ("2025-02", 0, "4", "b", "x")], "year_month string, seq int, tweet_id string, handle string, text string")
    assert rows(walking.walk(s, "cat", call, ["2025-01"], size=2), "id", "why") == [("1", "cat")]
    assert walking.chunks(s, None, 2).count() == 3
    h = spark.createDataFrame([("1", 1, ""), ("2", 2, "")], "id string, rnk int, why string")
    assert rows(walking.explained(h, spark.createDataFrame([("1", "w"), ("2", "v")], "id string, why string"), 1), "id", "why") == [("1", "w"), ("2", "")]


def test_tools(spark, tmp_path):
    df = frame(spark, post("1", "cat #pets", urls=["https://a.example"]), post("2", "dog #pets"), post("3", "bird"))
    a = api.Archive.of_tweets(df, now=lambda: datetime(2026, 1, 1, tzinfo=UTC))
    got = api.call_tool(a, "search_likes", {"query": "cat"})["results"]
    assert [r["tweet_id"] for r in got] == ["1"] and got[0]["urls"] == ["<<<URL>>>https://a.example<<<END_URL>>>"]
    assert api.call_tool(a, "search_likes", {"query": "cat", "year": 2024})["results"] == []
    for bad in ({"query": " "}, {"query": "x", "year": 1999}, {"query": "x", "month_start": "1"}, {"query": "x", "year": 2025, "month_end": "02"}, {"query": "x", "year": True}):
        assert api.call_tool(a, "search_likes", bad)["error"]["category"] == "invalid_input"
    assert api.call_tool(a, "read_tweet", {"tweet_id": "9"})["error"]["category"] == "not_found"
    assert api.call_tool(a, "read_tweet", {"tweet_id": "x"})["error"]["category"] == "invalid_input"
    assert api.call_tool(a, "get_month", {"year_month": "2025-01"})["error"]["category"] == "not_found"
    assert api.call_tool(a, "nonsense", {})["error"]["category"] == "not_found"
    assert api.call_tool(a, "search_likes", {"wrong": 1})["error"]["category"] == "upstream_failure"
    assert api.call_tool(a, "list_months", {}) == {"months": []}
    pages = spark.createDataFrame([("https://a.example", "https://a.example/", "body")], "url string, final_url string, sanitized_markdown string")
    asked = []

    def model(query, shape, context):
        asked.append(context)
        return reports.Report(claims=[("Cats", ["tweet:99" if len(asked) == 1 else "tweet:1"])])

    out = api.call_tool(a, "synthesize_likes", {"query": "cat", "hops": 2, "pages": pages, "model": model})
    assert "Cats (see: [tweet:1]" in out["markdown"] and out["fetched_url_count"] == 1 and len(asked) == 2 and "dog" in asked[0]
    assert api.call_tool(a, "synthesize_likes", {"query": "zebra"})["markdown"].startswith("# Synthesis report — zebra")
    assert api.call_tool(a, "synthesize_likes", {"query": "cat", "hops": 3})["error"]["category"] == "invalid_input"


def test_failing_vectors(spark):
    def embed(texts):
        raise OSError("down")

    df = frame(spark, post("1", "cat"))
    rows_ = spark.createDataFrame([("1", [1.0, 0.0])], "id string, v array<float>")
    assert [r["tweet_id"] for r in api.Archive.of_tweets(df, rows=rows_, embed=embed).search_likes("cat")] == ["1"]
    near = api.Archive.of_tweets(df, rows=rows_, embed=lambda t: [[1.0, 0.0]] * len(t)).search_likes("zebra")
    assert near[0]["walker_relevance"] == pytest.approx(1.0)


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "posts")
    frame(spark, post("1", "cat")).write.parquet(path)
    assert api.main([path, "--search", "cat", "--json"], spark) == 0
    assert '"tweet_id": "1"' in capsys.readouterr().out
    assert api.main([path, "--stats"], spark) == 0
    assert api.main([path, "--read", "x"], spark) == 2
    assert api.main([path], spark) == 2
    assert api.main([path, "--report", "poem"], spark) == 2
    assert api.main([path, "--report", "brief", "--query", "cat"], spark) == 0
