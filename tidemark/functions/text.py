"""String functions on columns, all built-ins but for NFKC normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that fence untrusted text in prompts, by family, and what replaces them inside.
FENCES = {
    "tweet": ("<<<TWEET_BODY>>>", "<<<END_TWEET_BODY>>>"),
    "url": ("<<<URL>>>", "<<<END_URL>>>"),
    "url_body": ("<<<URL_BODY>>>", "<<<END_URL_BODY>>>"),
    "entity": ("<<<ENTITY>>>", "<<<END_ENTITY>>>"),
    "kg_node": ("<<<KG_NODE>>>", "<<<END_KG_NODE>>>"),
    "kg_edge": ("<<<KG_EDGE>>>", "<<<END_KG_EDGE>>>"),
}
NEUTRAL = "[FENCE]"

_WORD = r"\p{L}\p{N}_"
_SPACE = r"(?U)\s+"
#: Fixed value: terminal sequences.
ANSI = r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-_])"
_CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
_FORMAT = r"[​-‏‪-‮⁠⁦-⁩﻿]"
_SHORT_LINK = r"https?://t\.co/\S+"


def tokens(text: Column) -> Column:
    """Words: lower case, cut at white space, without signs at their edges, empty ones dropped; null gives none."""
    bare = F.transform(F.split(F.lower(text), _SPACE), lambda w: F.regexp_replace(w, rf"^[^{_WORD}]+|[^{_WORD}]+$", ""))
    return F.coalesce(F.filter(bare, lambda w: w != ""), F.array().cast("array<string>"))


def index_text(text: Column, urls: Column) -> Column:
    """What is searched of a post: its text and its resolved URLs, blank parts left out."""
    parts = F.concat(F.array(text), F.coalesce(urls, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " ")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition.

    Arrow's own kernel leaves letters and accents apart, so the texts of a batch
    beyond ASCII are normalised at once, joined by a character that keeps them apart.
    """

    @F.arrow_udf("string")
    def run(arr):
        import unicodedata

        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.fill_null(pc.string_is_ascii(arr), True)
        if pc.all(plain).as_py() or len(arr) == 0:
            return arr
        odd = arr.filter(pc.invert(plain)).to_pylist()
        done = unicodedata.normalize("NFKC", "\0".join(odd)).split("\0")
        if len(done) != len(odd):  # texts that hold the separator
            done = [unicodedata.normalize("NFKC", x) for x in odd]
        return pc.replace_with_mask(arr, pc.invert(plain), pa.array(done, pa.string()))

    return run(text)


def sanitized(text: Column) -> Column:
    """Text safe to show: NFKC, then no terminal sequences, control characters (but line break and tab) or invisible marks; null becomes ''."""
    out = nfkc(F.coalesce(text, F.lit("")))
    for pattern in (ANSI, _CONTROL, _FORMAT):
        out = F.regexp_replace(out, pattern, "")
    return out


def safe_http_url(url: Column) -> Column:
    """The sanitised URL if it is http or https, else null."""
    clean = F.regexp_replace(sanitized(url), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(clean).rlike("^https?://"), clean)


def neutralized(text: Column) -> Column:
    """Text without any fence marker."""
    for pair in FENCES.values():
        for marker in pair:
            text = F.replace(text, F.lit(marker), F.lit(NEUTRAL))
    return text


def fenced(text: Column, family: str) -> Column:
    """Sanitised text between the markers of its family.

    Bodies stand on lines of their own; unsafe URLs and empty entities give
    null; nodes and edges are fenced even when empty.
    """
    begin, end = FENCES[family]
    if family == "url":
        body = safe_http_url(text)
    elif family == "entity":
        clean = F.regexp_replace(sanitized(text), r"(?U)^\s+|\s+$", "")
        body = F.when(clean != "", clean)
    else:
        body = sanitized(text)
    line = "\n" if family in ("tweet", "url_body") else ""
    return F.concat(F.lit(begin + line), neutralized(body), F.lit(line + end))


def cut(text: Column, limit: int) -> Column:
    """The first limit characters; null becomes ''."""
    return F.substring(F.coalesce(text, F.lit("")), 1, limit)


def flat_cut(text: Column, limit: int = 280) -> Column:
    """On one line, single blanks, at most limit characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")), 1, limit)


def ellipsis_cut(text: Column, limit: int = 120) -> Column:
    """At most limit characters, the last an ellipsis where text was cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def byte_cut(text: Column, limit: int) -> Column:
    """At most limit bytes of UTF-8, never half a character."""
    raw = F.encode(text, "UTF-8")
    tries = [F.try_validate_utf8(F.substring(raw, 1, max(limit - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*tries))


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(sanitized(text), _SHORT_LINK, ""), _SPACE, " "))


def with_raw_links(text: Column, urls: Column) -> Column:
    """Text without short links, followed by its resolved URLs as they are, blank ones left out."""
    raw = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.trim(u) != "")
    return F.array_join(F.filter(F.concat(F.array(_bare(text)), raw), lambda x: x != ""), " ")


def expanded_links(text: Column, urls: Column, distinct: bool = True) -> Column:
    """Text without short links, followed by its safe resolved URLs (each once if distinct)."""
    clean = _bare(text)
    # one pass over all URLs of a row: line breaks survive sanitising and never stand in a URL
    listed = F.filter(F.transform(F.split(sanitized(F.array_join(urls, "\n")), "\n"), F.trim), lambda u: F.lower(u).rlike("^https?://"))
    listed = F.array_distinct(listed) if distinct else listed
    joined = F.array_join(F.coalesce(listed, F.array().cast("array<string>")), " ")
    return F.when(joined == "", clean).when(clean == "", joined).otherwise(F.concat(clean, F.lit("  "), joined))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def status_url(handle: Column, ident: Column) -> Column:
    """The post's address; the form without a handle where that is malformed; '' where the id is no number."""
    named = F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), ident)
    plain = F.concat(F.lit("https://x.com/i/status/"), ident)
    return F.when(F.coalesce(ident.rlike(r"^[0-9]+$"), F.lit(False)), F.when(F.coalesce(handle.rlike(r"^[A-Za-z0-9_]{1,15}$"), F.lit(False)), named).otherwise(plain)).otherwise(F.lit(""))


def plain_url(handle: Column, ident: Column) -> Column:
    """The post's address as an export writes it: handle and id as they are, absent ones empty."""
    return F.concat(F.lit("https://x.com/"), F.coalesce(handle, F.lit("")), F.lit("/status/"), F.coalesce(ident, F.lit("")))


def node_id(kind: str, value: Column) -> Column:
    """Graph node ids: kind and normalised value."""
    if kind == "handle":
        value = F.lower(F.regexp_replace(value, "^@+", ""))
    elif kind == "hashtag":
        value = F.lower(F.regexp_replace(value, "^#+", ""))
    elif kind == "domain":
        value = F.lower(value)
    elif kind == "concept":
        value = F.regexp_replace(F.regexp_replace(F.lower(value), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    elif kind != "tweet":
        raise ValueError(f"unknown kind: {kind}")
    return F.concat(F.lit(f"{kind}:"), value)


def entity_query(ident: Column) -> Column:
    """The search text of an entity id; concepts get their blanks back."""
    value = F.regexp_replace(ident, "^[^:]*:", "")
    return F.when(ident.startswith("concept:"), F.replace(value, F.lit("_"), F.lit(" "))).otherwise(value)


def mindmap_label(label: Column, placeholder: str = "unnamed") -> Column:
    """A label without the signs that end a node in a mind map; the placeholder where nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(sanitized(label), r"[()\[\]{}\"/@:]", ""), _SPACE, " "))
    return F.coalesce(F.when(clean != "", clean), F.lit(placeholder))


def original_photo_url(kind: Column, media_url: Column, url: Column) -> Column:
    """Where a medium is fetched from: photos in original size, else the first address there is."""
    photo = F.regexp_replace(media_url, r"\?.*$", "")
    photo = F.when(photo.endswith(":orig"), photo).otherwise(F.concat(photo, F.lit("?format=jpg&name=orig")))
    has = F.coalesce(media_url, F.lit("")) != ""
    return F.when((kind == "photo") & has, photo).when(has, media_url).otherwise(F.when(url != "", url))


def file_extension(url: Column, content_type: Column, kind: Column) -> Column:
    """The extension of the address's last path segment, else by content type, else by kind, else .jpg."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    own = F.lower(F.regexp_extract(last, r"[^.].*(\.[^.]*)$", 1))
    by_type = F.lit(None).cast("string")
    for name, ext in (("video/mp4", ".mp4"), ("image/webp", ".webp"), ("image/gif", ".gif"), ("image/png", ".png"), ("image/jpg", ".jpg"), ("image/jpeg", ".jpg")):
        by_type = F.when(content_type.contains(name), ext).otherwise(by_type)
    by_kind = F.when(kind == "video", ".mp4").when(kind == "animated_gif", ".gif").otherwise(".jpg")
    return F.coalesce(F.when(F.length(own) > 0, own), by_type, by_kind)


def relative_path(path: Column, base: str) -> Column:
    """path seen from base, or as it is where it isn't below base."""
    root = base.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)
