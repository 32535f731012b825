"""Reports of one search: fenced context within a budget, mind map, and Markdown.

A report has a few hundred rows at most (50 hits and their graph): they are
collected once and rendered on the driver.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import re
from collections import defaultdict

from tidemark.functions.text import ANSI, FENCES, NEUTRAL

#: The shapes of reports.  Headings and the sentences that stand for missing parts below are fixed output, too.
SHAPES = ("brief", "synthesis", "trend")
CATEGORIES = (("Handles", "handle"), ("Hashtags", "hashtag"), ("Domains", "domain"), ("Concepts", "concept"))
_ANSI = re.compile(ANSI)
_DROP = {c: None for c in [*range(0, 9), *range(11, 32), *range(127, 160), *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFEFF]}


def clean(s) -> str:
    """The driver's twin of text.sanitized."""
    if not isinstance(s, str):
        return ""
    return _ANSI.sub("", unicodedata.normalize("NFKC", s)).translate(_DROP).encode("utf-8", "replace").decode()


def _fence(family: str, body: str) -> str:
    begin, end = FENCES[family]
    for pair in FENCES.values():
        for m in pair:
            body = body.replace(m, NEUTRAL)
    line = "\n" if family in ("tweet", "url_body") else ""
    return f"{begin}{line}{body}{line}{end}"


def _bytes(s: str, limit: int) -> str:
    return clean(s).encode()[:limit].decode("utf-8", "ignore")


@dataclass(frozen=True)
class Budget:
    """Bytes of each kind of body, and of the whole context."""

    tweet: int = 1024
    url_body: int = 4096
    entity: int = 128
    label: int = 128
    total: int = 32768
    nodes: int = 50
    edges: int = 100


@dataclass
class Hit:
    tweet_id: str
    handle: str = ""
    snippet: str = ""
    urls: list[str] = field(default_factory=list)
    year_month: str = ""


@dataclass
class Report:
    """What a model made of the context; all parts may be missing."""

    claims: list[tuple[str, list[str]]] = field(default_factory=list)
    sections: list[tuple[str, list[tuple[str, list[str]]]]] = field(default_factory=list)
    months: list[tuple[str, str, list[str]]] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    clusters: dict[str, list[str]] = field(default_factory=dict)


def context(shape: str, hits: list[Hit], pages: list[tuple[str, str]], nodes: list[dict], edges: list[dict], budget: Budget = Budget()) -> tuple[str, set[str]]:
    """(context, known source ids): everything fenced, URL bodies dropped from the last, then posts, until it fits."""
    check_shape(shape)
    tweets = [(f"tweet:{h.tweet_id}", _fence("tweet", _bytes(h.snippet, budget.tweet))) for h in hits]
    safe = [(u, b) for u, b in pages if re.match(r"(?i)https?://", clean(u).strip())]
    urls = [(f"url:{u}", _fence("url", clean(u).strip()), _fence("url_body", _bytes(b, budget.url_body))) for u, b in safe]
    tops = [n for _, kind in CATEGORIES for n in top(nodes, kind, 8)]
    ents = [_fence("entity", x) for n in tops if (x := _bytes(n["label"], budget.entity).strip())]
    labels = [_fence("kg_node", _bytes(n["label"], budget.label)) for n in nodes[: budget.nodes]]
    links = [_fence("kg_edge", _bytes(f"{e['src']} {e['kind']} {e['dst']}", budget.label)) for e in edges[: budget.edges]]

    def blob() -> str:
        parts = {"TWEETS": [t for _, t in tweets], "URLS": [u for _, u, _ in urls], "URL_BODIES": [b for *_, b in urls], "ENTITIES": ents, "KG_NODES": labels, "KG_EDGES": links}
        return "\n\n".join([f"SHAPE: {shape}", *["\n".join([f"{k}:", *v]) for k, v in parts.items() if v]])

    for some in (urls, tweets):
        while some and len(blob().encode()) > budget.total:
            some.pop()
    return blob(), {i for i, *_ in tweets} | {i for i, *_ in urls}


def unknown_sources(report: Report, known: set[str]) -> list[str]:
    """Sources that claims cite and the context doesn't have."""
    cited = [s for _, ss in report.claims for s in ss] + [s for _, cs in report.sections for _, ss in cs for s in ss]
    return [s for s in dict.fromkeys(cited) if s not in known]


def top(nodes: list[dict], kind: str, n: int) -> list[dict]:
    return sorted((x for x in nodes if x["kind"] == kind), key=lambda x: (-x["weight"], x["id"]))[:n]


def _label(s: str) -> str:
    return " ".join(re.sub(r'[()\[\]{}"/@:]', "", clean(s)).split()) or "unnamed"


def mindmap(query: str, nodes: list[dict], edges: list[dict], depth: int = 4, per_kind: int = 8, least: float = 2.0, reverse: bool = False) -> str:
    """A mind map in Mermaid: kinds, their heaviest nodes (the floor applies to the first per_kind), and posts these lead to."""
    lines = ["```mermaid", "mindmap", f"  root(({_label(query)}))"]
    by_id = {n["id"]: n for n in nodes}
    near, far = ("dst", "src") if reverse else ("src", "dst")
    for name, kind in CATEGORIES if depth > 1 else ():
        some = [n for n in top(nodes, kind, per_kind) if n["weight"] >= least or least <= 0]
        if not some:
            continue
        lines.append(f"    {name}")
        for n in some if depth > 2 else ():
            lines.append(f"      {_label(n['label'])}")
            leads = dict.fromkeys(e[far] for e in edges if e[near] == n["id"]) if depth > 3 else ()
            lines += [f"        {_label(by_id[i]['label'])}" for i in leads if i in by_id and by_id[i]["kind"] == "tweet"]
    return "\n".join([*lines, "```"])


def _address(handle: str, ident: str) -> str:
    if not re.fullmatch(r"[0-9]+", ident or ""):
        return ""
    return f"https://x.com/{handle if re.fullmatch(r'[A-Za-z0-9_]{1,15}', handle or '') else 'i'}/status/{ident}"


def _short(s: str, limit: int = 120) -> str:
    return s if len(s) <= limit else s[: limit - 1].rstrip() + "…"


def _line(h: Hit) -> str:
    words = " ".join(re.sub(r"https?://t\.co/\S+", "", clean(h.snippet)).split())
    safe = [u for u in dict.fromkeys(clean(u).strip() for u in h.urls) if re.match(r"(?i)https?://", u)]
    body = _short("  ".join(x for x in (words, " ".join(safe)) if x))
    url = _address(h.handle, h.tweet_id)
    return f"- [{h.tweet_id}]({url}): {body}" if url else f"- {h.tweet_id}: {body}"


def _claim(claim: tuple[str, list[str]], by_id: dict[str, Hit]) -> str:
    text, sources = claim
    shown = []
    for s in sources:
        kind, _, value = s.partition(":")
        url = _address(by_id[value].handle if value in by_id else "", value) if kind == "tweet" else value if kind == "url" else ""
        shown.append(f"[{s}]({url})" if url else s)
    return clean(text).strip() + (f" (see: {', '.join(shown)})" if shown else "")


def within_words(sentences: list[str], budget: int = 350) -> list[str]:
    """Sentences up to the first that would overflow the budget of words."""
    out, n = [], 0
    for s in sentences:
        n += len(s.split())
        if n > budget:
            break
        out.append(s)
    return out


def check_shape(shape: str) -> None:
    if shape not in SHAPES:
        raise ValueError(f"unknown report shape: {shape!r}")


def check_hops(hops: int) -> None:
    if isinstance(hops, bool) or not isinstance(hops, int) or not 1 <= hops <= 2:
        raise ValueError("hops must be 1 or 2")


def empty(query: str, filters: dict[str, object] | None = None) -> str:
    q = clean(query).strip() or "(empty query)"
    said = ", ".join(f"{k}={v}" for k, v in (filters or {}).items() if v is not None)
    return clean(f"# Synthesis report — {q}\n\nNo matching tweets were found in the corpus for the query {q!r}{f' (filters: {said})' if said else ''}.\n")


def render(shape: str, query: str, hits: list[Hit], nodes: list[dict], edges: list[dict], report: Report | None = None, filters: dict[str, object] | None = None) -> str:
    """The Markdown of a report; without hits, a note that there are none.

    Trend reports of no model are by the hits' own months; citations there may
    carry the ``tweet:`` prefix.
    """
    check_shape(shape)
    if not hits:
        return empty(query, filters)
    r = report or Report()
    by_id = {h.tweet_id: h for h in reversed(hits)}
    find = lambda t: _line(by_id[t]) if t in by_id else f"- {t} (no matching hit)"
    bare = lambda t: t.removeprefix("tweet:")
    out = [f"# Synthesis report — {clean(query).strip() or '(empty query)'}", ""]
    tops = ["## Top entities", *([f"- {clean(e).strip()}" for e in r.entities] or ["- (none)"])]
    if shape == "brief":
        said = " ".join(within_words([_claim(c, by_id) for c in r.claims]))
        if not r.claims:
            said = f"This brief lists the top hits for {query!r}. The synthesizer did not produce a structured summary."
        out += ["## Brief", said or "(no synthesized claims)", "", *tops, "", "## Anchor tweets", *map(_line, hits[:10])]
        return clean("\n".join(out))
    out += ["## Mindmap", "", mindmap(query, nodes, edges), ""]
    if shape == "synthesis":
        for heading, claims in r.sections:
            out += [f"## {clean(heading).strip() or '(untitled section)'}", ""]
            out += ["\n\n".join(_claim(c, by_id) for c in claims) or "(no claims)", ""]
        out += [*tops, ""]
        if r.clusters:
            out += ["## Clusters", ""]
        for name, ids in r.clusters.items():
            out += [f"### Cluster: {clean(name).strip() or '(unnamed)'}", *[find(bare(t)) for t in ids], ""]
        return clean("\n".join(out))
    if r.months:
        for month, summary, ids in sorted(r.months):
            out += [f"## {clean(month).strip() or 'unknown'}", ""]
            out += [clean(summary).strip(), ""] if clean(summary).strip() else []
            out += [*[find(bare(t)) for t in ids], ""]
    else:
        buckets: dict[str, list[Hit]] = defaultdict(list)
        for h in hits:
            buckets[h.year_month or "unknown"].append(h)
        for month in sorted(buckets):
            out += [f"## {month}", "", *map(_line, buckets[month]), ""]
    return clean("\n".join([*out, *tops]))


def rendered(searches, shape: str):
    """(query_id, line, markdown): the report of each search, without a model.

    searches is a DataFrame (query_id, query_text, hits, nodes, edges): arrays of
    at most a few hundred structs of one search each, in order; a search without
    hits has the note that there are none.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            at, number, said = [], [], []
            for i, r in enumerate(b.to_pylist()):
                hits = [Hit(h["id"], h["handle"] or "", h["text"] or "", h["urls"] or [], h["month"] or "") for h in r["hits"] or ()]
                lines = render(shape, r["query_text"] or "", hits, r["nodes"] or [], r["edges"] or []).split("\n")
                at += [i] * len(lines)
                number += range(len(lines))
                said += lines
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(said, pa.string())], ["query_id", "line", "markdown"])

    check_shape(shape)
    return searches.select("query_id", "query_text", "hits", "nodes", "edges").mapInArrow(run, "query_id bigint, line int, markdown string")
