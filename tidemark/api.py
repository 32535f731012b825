"""The tools of the archive for programs, with their errors: an Archive over tables, and a command line."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import bm25, entities, graph, network, posts as P, reports, search, walking
from tidemark.sources import archive
from tidemark.storage import materialize


#: Results that reasons are asked for.
EXPLAINED = 20


class ToolError(Exception):
    """category: invalid_input, not_found or upstream_failure."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def _invalid(what: str, why: str) -> ToolError:
    return ToolError("invalid_input", f"{what}: {why}")


def check_query(query) -> str:
    if not isinstance(query, str) or not query.strip():
        raise _invalid("query", "must not be blank")
    return query.strip()


def check_filter(year=None, month_start=None, month_end=None) -> None:
    if year is not None and (isinstance(year, bool) or not isinstance(year, int) or not 2006 <= year <= 9999):
        raise _invalid("year", "must be from 2006 to 9999")
    for name, m in (("month_start", month_start), ("month_end", month_end)):
        if m is not None and not (isinstance(m, str) and re.fullmatch("0[1-9]|1[0-2]", m)):
            raise _invalid(name, "must be 01 to 12")
    try:
        dates.months_of(year, month_start, month_end)
    except ValueError as e:
        raise _invalid("filter", str(e)) from None


@dataclass
class Archive:
    """The tables tools work on, and the calls they may make.

    embed turns texts into vectors, rows holds (id, v); without them search is
    by words.  chat answers a prompt, fetch gets a page (final URL, content
    type, body), judge names the entities of a list that matter to a query.
    pages are saved bodies (url_key, url, final_url, content_type,
    sanitized_markdown, fetched_at), index_path is where the index is kept.
    """

    posts: DataFrame
    deliveries: DataFrame
    files: DataFrame | None = None
    rows: DataFrame | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    tree: DataFrame | None = None
    now: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))
    chat: Callable[[str], str] | None = None
    fetch: Callable[[str], tuple[str, str, str] | None] | None = None
    judge: Callable[[str, list[str]], list[str]] | None = None
    pages: DataFrame | None = None
    index_path: str | None = None
    _index: bm25.Index | None = None

    @staticmethod
    def of_tweets(tweets: DataFrame, **kwargs) -> Archive:
        return Archive(materialize(P.latest(tweets), "posts"), tweets, **kwargs)

    @property
    def index(self) -> bm25.Index:
        """The index: of this archive object, else the one kept at index_path if it is of as many posts, else a new one, which is kept."""
        if self._index is None and self.index_path:
            try:
                kept = bm25.load(self.posts.sparkSession, self.index_path)
                self._index = kept if kept.docs == self.posts.count() else None
            except AnalysisException:  # none is kept
                pass
        if self._index is None:
            self._index = bm25.build(self.posts)
            if self.index_path:
                bm25.save(self._index, self.index_path)
        return self._index

    def _queries(self, texts: list[str], year, month_start, month_end) -> DataFrame:
        rows = [(i, t, year, month_start, month_end) for i, t in enumerate(texts)]
        return self.posts.sparkSession.createDataFrame(rows, "query_id bigint, query_text string, year_filter int, month_start string, month_end string")

    def find(self, queries: DataFrame, top: int = search.TOP) -> DataFrame:
        """Ranked posts of a table of queries; a failing embedding call leaves the search by words."""
        vectors = None
        if self.embed and self.rows is not None:
            asked = queries.select("query_id", "query_text").collect()  # the few queries of one call
            try:
                got = self.embed([r.query_text for r in asked])
                vectors = queries.sparkSession.createDataFrame([(r.query_id, [float(x) for x in v]) for r, v in zip(asked, got, strict=True)], "query_id bigint, v array<double>")
            except Exception as e:
                print(f"search: no vectors ({e}); by words only", file=sys.stderr)
        return search.search(queries, self.posts, self.index, P.author_affinity(self.deliveries), self.now(), vectors, self.rows, top)

    def search_likes(self, query: str, year=None, month_start=None, month_end=None, with_why: bool = False, top: int = search.TOP) -> list[dict]:
        """Posts for a query, best first; with_why asks the chat call for reasons of the first twenty, and goes without if it fails."""
        check_filter(year, month_start, month_end)
        hits = self.find(self._queries([check_query(query)], year, month_start, month_end), top)
        shown = search.shaped(hits, self.posts, self.tree).orderBy("rnk").drop("query_id", "rnk")
        results = [r.asDict(recursive=True) for r in shown.collect()]  # at most top rows
        if with_why and results:
            said = self._reasons(query, results[:EXPLAINED])
            for r in results[:EXPLAINED]:
                r["why"] = said.get(r["tweet_id"], r["why"])
        return results

    def _reasons(self, query: str, results: list[dict]) -> dict[str, str]:
        """Reasons by id; none where the call is missing, fails, or answers something else."""
        if self.chat:
            part = "\n".join(f"[id={r['tweet_id']}] @{r['handle']}: {r['snippet']}" for r in results)
            try:
                hits = walking.valid_hits(walking.parse_answer(self.chat(walking.prompt(query, part))), {r["tweet_id"] for r in results})
                return {i: why for i, _, why in hits}
            except Exception as e:
                print(f"search: no reasons ({e})", file=sys.stderr)
        return {}

    def list_months(self) -> list[dict]:
        """Months that have a file, newest first, with their posts."""
        if self.files is None:
            return []
        return [r.asDict() for r in P.list_months(self.files, self.deliveries).collect()]

    def get_month(self, year_month: str) -> str:
        """One month's Markdown."""
        if not isinstance(year_month, str) or not re.fullmatch(r"\d{4}-\d{2}", year_month):
            raise _invalid("year_month", "must be YYYY-MM")
        row = self.files.where(F.col("year_month") == year_month).select("markdown").first() if self.files is not None else None
        if row is None:
            raise ToolError("not_found", f"no month {year_month}")
        return row.markdown

    def read_tweet(self, tweet_id: str) -> dict:
        """One post's filled fields."""
        if not isinstance(tweet_id, str) or not re.fullmatch("[0-9]+", tweet_id):
            raise _invalid("tweet_id", "must be digits")
        row = P.read_post(self.posts, tweet_id).first()
        if row is None:
            raise ToolError("not_found", f"no post {tweet_id}")
        return json.loads(row.post)

    def graph_of(self, query: str, hits: DataFrame) -> tuple[list[dict], list[dict]]:
        """Nodes and edges of a search, without the entities that the judging call leaves out."""
        q = self._queries([query], None, None, None)
        g = graph.build(q, hits, self.posts)
        if self.judge:
            named = [r.id for r in g.nodes.where(F.col("kind").isin(list(entities.KINDS))).orderBy("seq").select("id").collect()]  # of one search
            if len(named) > 1:
                try:
                    keep = set(self.judge(query, named))
                    rows = [(0, i) for i in named if i in keep] or [(0, "")]
                    g = graph.relevant(g, q.sparkSession.createDataFrame(rows, "query_id bigint, id string"))
                except Exception as e:
                    print(f"report: all entities stay ({e})", file=sys.stderr)
        nodes = [r.asDict() for r in g.nodes.orderBy("seq").drop("seq", "query_id").collect()]  # of one search
        edges = [r.asDict() for r in g.edges.orderBy("seq").drop("seq", "query_id").collect()]
        return nodes, edges

    def synthesize_likes(self, query: str, report_shape: str = "brief", hops: int = 1, year=None, month_start=None, month_end=None, limit: int = 50, fetch_urls: bool = False, pages: DataFrame | None = None, model: Callable[[str, str, str], reports.Report] | None = None) -> dict:
        """A report of a search: its Markdown, and what it used.

        pages (url, final_url, sanitized_markdown) are bodies of resolved URLs; with
        fetch_urls they are the saved ones and those the fetch call gets; model makes
        a Report of (query, shape, context), and is asked once more if it cites
        sources the context doesn't have.
        """
        query = check_query(query)
        check_filter(year, month_start, month_end)
        try:
            reports.check_shape(report_shape)
            reports.check_hops(hops)
        except ValueError as e:
            raise _invalid("report", str(e)) from None
        asked = self._queries([query], year, month_start, month_end)
        hits = materialize(self.find(asked, limit), "hits")
        filters = {"year": year, "month_start": month_start, "month_end": month_end}
        if hops == 2:
            g = graph.build(asked, hits, self.posts)
            both = search.second_round(hits, asked, g.nodes, lambda q: self.find(q, limit))
            again = both.where("round = 2").select("query_id", "id", (F.col("rnk") + 1_000_000).cast("int").alias("rnk"))
            hits = materialize(hits.select("query_id", "id", F.col("rnk").cast("int").alias("rnk")).unionByName(again), "hits")
        slim = hits.select("id", "rnk").join(self.posts.select("id", "text", "urls", F.col("author.screen_name").alias("handle"), dates.month_key(F.col("created_at")).alias("m")), "id").orderBy("rnk")
        shown = [reports.Hit(r.id, r.handle or "", r.text or "", list(r.urls or []), r.m or "") for r in slim.collect()]  # at most a few hundred
        if not shown:
            return {"markdown": reports.empty(query, filters), "shape": report_shape, "used_hops": 1, "fetched_url_count": 0}
        nodes, edges = self.graph_of(query, hits)
        bodies = []
        urls = network.distinct_urls(hits.join(self.posts.select("id", "urls"), "id")).orderBy("place").select("url", "place")
        if pages is None and fetch_urls:
            pages = self.bodies(urls)
        if pages is not None:
            bodies = [(r.final_url, r.sanitized_markdown) for r in urls.join(pages, "url").orderBy("place").collect()]
        made = None
        if model:
            context, known = reports.context(report_shape, shown, bodies, nodes, edges)
            made = model(query, report_shape, context)
            if unknown := reports.unknown_sources(made, known):
                made = model(query, report_shape, f"{context}\n\nThese sources do not exist: {', '.join(unknown)}")
                if unknown := reports.unknown_sources(made, known):
                    raise ToolError("upstream_failure", f"unknown sources: {', '.join(unknown)}")
        return {"markdown": reports.render(report_shape, query, shown, nodes, edges, made, filters), "shape": report_shape, "used_hops": hops, "fetched_url_count": len(bodies)}


    def bodies(self, urls: DataFrame) -> DataFrame | None:
        """(url, final_url, sanitized_markdown): saved pages of these URLs that are not too old, and those the fetch call gets, which are saved too."""
        spark, moment = self.posts.sparkSession, self.now().timestamp()
        saved = archive.cached(self.pages, urls, F.lit(moment)) if self.pages is not None else None
        if self.fetch is None:
            return saved
        asked = urls.select("url") if saved is None else urls.select("url").join(saved.select("url"), "url", "left_anti")
        got = materialize(network.fetch(asked, self.fetch), "pages")
        kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
        good = got.where(kind.isin(list(network.CONTENT_TYPES)))
        new = good.select(F.sha2("url", 256).alias("url_key"), "url", "final_url", "content_type", text.sanitized(F.col("body")).alias("sanitized_markdown"), F.lit(moment).alias("fetched_at"))
        if self.pages is None:
            self.pages = materialize(new, "cache")
        else:
            self.pages = materialize(archive.put_pages(self.pages, new.drop("url_key")), "cache")
        return archive.cached(self.pages, urls, F.lit(moment)).select("url", "final_url", "sanitized_markdown")

    def mindmap(self, query: str, year=None, month_start=None, month_end=None, as_json: bool = False) -> str:
        """The graph of a search, as a mind map or as JSON."""
        check_filter(year, month_start, month_end)
        query = check_query(query)
        nodes, edges = self.graph_of(query, materialize(self.find(self._queries([query], year, month_start, month_end)), "hits"))
        if as_json:
            return json.dumps({"nodes": sorted(nodes, key=lambda n: n["id"]), "edges": edges}, ensure_ascii=False)
        return reports.mindmap(query, nodes, edges)


def call_tool(archive: Archive, name: str, arguments: dict) -> dict:
    """A tool's result, or {error: {category, message}}; what is no ToolError counts as upstream_failure."""
    tools = {
        "search_likes": lambda **a: {"results": archive.search_likes(**a)},
        "list_months": lambda: {"months": archive.list_months()},
        "get_month": lambda **a: {"markdown": archive.get_month(**a)},
        "read_tweet": archive.read_tweet,
        "synthesize_likes": archive.synthesize_likes,
    }
    try:
        if name not in tools:
            raise ToolError("not_found", f"no tool {name}")
        return tools[name](**arguments)
    except ToolError as e:
        return {"error": {"category": e.category, "message": str(e)}}
    except Exception as e:
        return {"error": {"category": "upstream_failure", "message": str(e)}}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Command line over a Parquet table of posts: one of init, search, kg, report, report-optimize, months, read, stats, export.  0, or 2 for bad input."""
    from tidemark.session import local
    from tidemark.sources import sinks

    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("posts", help="Parquet table of posts (deliveries)")
    mode = parser.add_mutually_exclusive_group(required=True)
    mode.add_argument("--init", action="store_true", help="build the index and keep it at --index")
    mode.add_argument("--search", metavar="QUERY")
    mode.add_argument("--kg", metavar="QUERY", help="the graph of a search, as a mind map or (--json) as JSON")
    mode.add_argument("--report", metavar="SHAPE", choices=reports.SHAPES)
    mode.add_argument("--report-optimize", metavar="DEMOS", help="check the labelled examples of a file; fitting needs a model")
    mode.add_argument("--read", metavar="ID")
    mode.add_argument("--stats", action="store_true")
    mode.add_argument("--export", metavar="FOLDER")
    parser.add_argument("--query", metavar="QUERY")
    parser.add_argument("--index", metavar="FOLDER")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--with-why", action="store_true")
    parser.add_argument("--fetch-urls", action="store_true")
    parser.add_argument("--hops", type=int, default=1)
    parser.add_argument("--year", type=int)
    parser.add_argument("--month-start")
    parser.add_argument("--month-end")
    parser.add_argument("--limit", type=int, default=10)
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or local()
    tweets = spark.read.parquet(a.posts)
    own = Archive.of_tweets(tweets, index_path=a.index)
    span = {"year": a.year, "month_start": a.month_start, "month_end": a.month_end}
    if a.init:
        if not a.index:
            parser.print_usage(sys.stderr)
            return 2
        out = {"posts": own.index.docs, "index": a.index}
    elif a.search:
        out = call_tool(own, "search_likes", {"query": a.search, "top": a.limit, "with_why": a.with_why, **span})
        if "results" in out:
            for n, r in enumerate(out["results"], 1):
                print(json.dumps(r, ensure_ascii=False, default=str) if a.json else f"{n}. @{r['handle']} {r['tweet_url']} [{r['score']:.3f}]\n   {r['snippet']}" + (f"\n   {r['why']}" if r["why"] else ""))
            return 0
    elif a.kg:
        try:
            out = {"markdown": own.mindmap(a.kg, **span, as_json=a.json)}
        except ToolError as e:
            out = {"error": {"category": e.category, "message": str(e)}}
    elif a.report:
        out = call_tool(own, "synthesize_likes", {"query": a.query or "", "report_shape": a.report, "hops": a.hops, "fetch_urls": a.fetch_urls, **span})
    elif a.report_optimize:
        out = {"examples": archive.load_demos(spark, a.report_optimize).count()}
        if not out["examples"]:
            out = {"error": {"category": "invalid_input", "message": "no labelled examples"}}
    elif a.read:
        out = call_tool(own, "read_tweet", {"tweet_id": a.read})
    elif a.stats:
        out = P.stats(tweets).first().asDict()
    else:
        out = sinks.export_all(own.posts, a.export, own.now().strftime("%Y-%m-%d %H:%M:%S"))
    if "error" in out:
        print(json.dumps(out), file=sys.stderr)
        return 2
    print(out["markdown"] if "markdown" in out else json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
