"""Problem 5: nested JSON records as related flat tables.

Method: adjacency-table shredding.  Each record becomes rows of one adjacency
table: (record, node, parent, type, label, ordinal, name, scalar).  The scalar
children of each object are pivoted into one row (they stand beside each other,
so tasks combine them before the shuffle) and object nodes are joined with these
rows; the entity tables are then joins of objects with their parent objects.

A shape says which labels lead from a type of object to which type, and which
scalars of a type are kept; all else is pruned while shredding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """root: the type of a record (or of each entry of a record that is an array).

    links: (type, label) -> type of the object or objects under that label.
    scalars: type -> labels of the scalars kept.  lists: type -> labels of arrays
    of scalars kept, as JSON text.  text_links: labels under which an object may
    also stand as JSON text.
    """

    root: str
    links: dict[tuple[str, str], str]
    scalars: dict[str, Sequence[str]]
    lists: dict[str, Sequence[str]] = field(default_factory=dict)
    text_links: frozenset[str] = frozenset()


#: The shape of a saved post.
POST = Shape(
    root="post",
    links={
        ("post", "quoted_tweet"): "post",
        ("post", "retweeted_tweet"): "post",
        ("post", "user"): "user",
        ("post", "media"): "media",
        ("user", "core"): "core",
        ("user", "legacy"): "legacy",
    },
    scalars={
        "post": ("id", "text", "created_at", "lang", *(f"{c}_count" for c in ("favorite", "retweet", "reply", "quote", "view")), "is_retweet", "is_quote", "conversation_id", "in_reply_to_user_id"),
        "user": ("id", "rest_id", "screen_name", "name", "profile_image_url", "verified", "followers_count", "following_count"),
        "core": ("screen_name", "name"),
        "legacy": ("screen_name", "name", "profile_image_url_https", "verified", "followers_count", "friends_count"),
        "media": ("type", "url", "media_url", "media_url_https", "preview_image_url", "width", "height", "local_path"),
    },
    lists={"post": ("hashtags", "urls", "mentions")},
    text_links=frozenset(("quoted_tweet", "retweeted_tweet")),
)

NODES = "node int, parent int, type string, label string, ordinal int, name string, scalar string"


def _refuse(token: str):
    raise ValueError(f"{token} is not JSON")


class _Number(str):
    """A number as it is written."""


_decode = json.JSONDecoder(parse_constant=_refuse, parse_int=_Number, parse_float=_Number).decode


def parse(text: str | None):
    """(True, value) of a text that is one whole JSON value, else (False, None)."""
    if text is None:
        return False, None
    try:
        return True, _decode(text)
    except (ValueError, RecursionError):
        return False, None


def _scalar(v) -> str | None:
    if v is True or v is False:
        return "true" if v else "false"
    return str(v) if isinstance(v, str) else None


def shred_value(value, shape: Shape) -> Iterator[tuple]:
    """Adjacency rows (node, parent, type, label, ordinal, name, scalar) of one record.

    An object's own row has a null name; the row of a scalar has the node and
    type of its object, and a name, but neither parent, label nor ordinal.  Nodes are numbered in order of appearance;
    the parent of a root is -1.  The ordinal is the place in the array the
    object stands in, null entries counting, or 0.
    """
    number = 0
    todo = [(v, -1, shape.root, "", i) for i, v in reversed(list(enumerate(value if isinstance(value, list) else [value])))]
    while todo:
        obj, parent, kind, label, ordinal = todo.pop()
        if not isinstance(obj, dict):
            continue
        node, number = number, number + 1
        yield node, parent, kind, label, ordinal, None, None
        for name in shape.scalars.get(kind, ()):
            if name in obj and (s := _scalar(obj[name])) is not None:
                yield node, None, kind, None, None, name, s
        for name in shape.lists.get(kind, ()):
            if isinstance(obj.get(name), list):
                yield node, None, kind, None, None, name, json.dumps(obj[name], ensure_ascii=False)
        for (of, name), to in shape.links.items():
            if of != kind or name not in obj:
                continue
            child = obj[name]
            if isinstance(child, str) and not isinstance(child, _Number) and name in shape.text_links:
                child = parse(child)[1]
            if isinstance(child, list):
                todo += [(c, node, to, name, i) for i, c in reversed(list(enumerate(child)))]
            else:
                todo.append((child, node, to, name, 0))


def shred(df: DataFrame, key: str, payload: str, shape: Shape = POST) -> DataFrame:
    """The adjacency table of df: (record, node, parent, type, label, ordinal, name, scalar).

    Payloads that are null, empty, cut off or otherwise not one whole JSON value
    give no row, nor do null entries and entries that are no objects.  Of a
    repeated name in an object the last counts.  Other columns are ignored.
    """
    rows = df.select(F.col(key).alias("record"), F.col(payload).cast("string").alias("payload")).where("record IS NOT NULL AND payload IS NOT NULL")
    kind = rows.schema["record"].dataType.simpleString()
    names = [c.split()[0] for c in NODES.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int32() for c in NODES.split(", ")]

    def run(batches):
        for b in batches:
            at: list[int] = []
            columns: list[list] = [[] for _ in names]
            for i, text in enumerate(b.column(1).to_pylist()):
                ok, value = parse(text)
                if not ok:
                    continue
                for row in shred_value(value, shape):
                    at.append(i)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            try:
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            except UnicodeEncodeError:  # halves of surrogate pairs, written as escapes
                columns[-1] = [s if s is None else s.encode("utf-8", "replace").decode() for s in columns[-1]]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], ["record", *names])

    return rows.mapInArrow(run, f"record {kind}, {NODES}")


def objects(nodes: DataFrame, types: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row (record, node, parent, type, label, ordinal, *names) for each object of the types: object rows joined with their pivoted scalar children."""
    some = nodes.where(F.col("type").isin(list(types)))
    own = some.where("name IS NULL").select("record", "node", "parent", "type", "label", "ordinal")
    scalars = some.where(F.col("name").isin(list(names))).groupBy("record", "node").agg(*[F.max(F.when(F.col("name") == n, F.col("scalar"))).alias(n) for n in names])
    return own.join(scalars, ["record", "node"], "left")


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def users(nodes: DataFrame) -> DataFrame:
    """(record, post_node, user_id, screen_name, name, profile_image_url, verified, followers_count, following_count): each post's user.

    screen_name and name come from the newer block if it has them, else from the
    user itself, else from the older block, else ''; the other fields from the
    user itself, else from the older block, else null.
    """
    every = objects(nodes, ("user", "core", "legacy"), ("id", "rest_id", "screen_name", "name", "profile_image_url", "profile_image_url_https", "verified", "followers_count", "following_count", "friends_count"))
    # a user and its blocks stand on the user's node
    home = F.when(F.col("type") == "user", F.col("node")).otherwise(F.col("parent"))
    part = lambda t, c: F.max(F.when(F.col("type") == t, F.col(c)))
    either = lambda a, b: F.coalesce(part("user", a), part("legacy", b))
    one = every.groupBy("record", home.alias("node")).agg(
        part("user", "parent").alias("post_node"),
        _filled(part("user", "id"), part("user", "rest_id")).alias("user_id"),
        _filled(part("core", "screen_name"), part("user", "screen_name"), part("legacy", "screen_name")).alias("screen_name"),
        _filled(part("core", "name"), part("user", "name"), part("legacy", "name")).alias("name"),
        either("profile_image_url", "profile_image_url_https").alias("profile_image_url"),
        either("verified", "verified").try_cast("boolean").alias("verified"),
        either("followers_count", "followers_count").try_cast("bigint").alias("followers_count"),
        either("following_count", "friends_count").try_cast("bigint").alias("following_count"),
    )
    return one.where("post_node IS NOT NULL").drop("node")


_COUNTS = tuple(f"{c}_count" for c in ("favorite", "retweet", "reply", "quote", "view"))


def posts(nodes: DataFrame) -> DataFrame:
    """(record, node, parent_node, parent_tweet_id, tweet_id, relation, ordinal, text, created_at, lang, counts, flags, conversation_id, in_reply_to_user_id, hashtags, urls, mentions).

    parent_tweet_id is the enclosing post's id, '' at the top; relation is the
    label that leads to the post, '' at the top.  Fields a post doesn't have
    are null.
    """
    p = objects(nodes, ("post",), (*POST.scalars["post"], *POST.lists["post"]))
    up = p.select("record", F.col("node").alias("parent"), F.coalesce("id", F.lit("")).alias("parent_tweet_id"))
    return p.join(up, ["record", "parent"], "left").select(
        "record",
        "node",
        F.when(F.col("parent") >= 0, F.col("parent")).alias("parent_node"),
        F.coalesce("parent_tweet_id", F.lit("")).alias("parent_tweet_id"),
        F.coalesce("id", F.lit("")).alias("tweet_id"),
        F.col("label").alias("relation"),
        "ordinal",
        "text",
        "created_at",
        "lang",
        *[F.col(c).try_cast("bigint").alias(c) for c in _COUNTS],
        *[F.col(c).try_cast("boolean").alias(c) for c in ("is_retweet", "is_quote")],
        "conversation_id",
        "in_reply_to_user_id",
        *[F.from_json(c, "array<string>").alias(c) for c in POST.lists["post"]],
    )


def media(nodes: DataFrame) -> DataFrame:
    """(record, post_node, media_pos, kind, url, media_url, preview_image_url, width, height, local_path): each media entry that is an object.

    media_url falls back to its older name; '' where neither is filled.
    """
    names = ("type", "url", "media_url", "media_url_https", "preview_image_url", "width", "height", "local_path")
    m = objects(nodes.withColumn("name", F.when(F.col("name") == "type", "kind").otherwise(F.col("name"))), ("media",), ("kind", *names[1:]))
    return m.select(
        "record",
        F.col("parent").alias("post_node"),
        F.col("ordinal").alias("media_pos"),
        "kind",
        "url",
        _filled(F.col("media_url"), F.col("media_url_https")).alias("media_url"),
        "preview_image_url",
        F.col("width").try_cast("int").alias("width"),
        F.col("height").try_cast("int").alias("height"),
        "local_path",
    )


def media_of_posts(nodes: DataFrame) -> DataFrame:
    """(record, parent_tweet_id, tweet_id, media_pos, screen_name, media_url) of each media entry with a URL, at any depth."""
    p = posts(nodes).select("record", F.col("node").alias("post_node"), "parent_tweet_id", "tweet_id")
    u = users(nodes).select("record", "post_node", "screen_name")
    m = media(nodes).where("media_url <> ''").select("record", "post_node", "media_pos", "media_url")
    on = ["record", "post_node"]
    return m.join(p, on).join(u, on, "left").select("record", "parent_tweet_id", "tweet_id", "media_pos", F.coalesce("screen_name", F.lit("")).alias("screen_name"), "media_url")
