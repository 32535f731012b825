import json

import pytest

from conftest import rows
from tidemark.operators import shredding as S


def user(**x):
    return {"id": "u", "screen_name": "ann"} | x


def records(spark, *payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, p in enumerate(payloads)], "record_id bigint, payload string, node string")


def found(spark, *payloads):
    return rows(S.media_of_posts(S.shred(records(spark, *payloads), "record_id", "payload")))


def media(*urls):
    return [None if u is None else {"type": "photo", "media_url": u} for u in urls]


def test_nested(spark):
    deep = {"id": 3, "user": {"rest_id": "9", "core": {"screen_name": ""}, "legacy": {"screen_name": "old"}}, "media": {"media_url_https": "c"}}
    top = {"id": "1", "user": user(), "media": media(None, "a", ""), "quoted_tweet": json.dumps({"id": "2", "media": media("b"), "retweeted_tweet": deep}), "raw_data": {"media": media("no")}}
    assert found(spark, [None, top, 5]) == [(0, "", "1", 1, "ann", "a"), (0, "1", "2", 0, "", "b"), (0, "2", "3", 0, "old", "c")]


@pytest.mark.parametrize("bad", [None, "", "{", '{"id": "1", "media": [{"media_url": "a"}]', '{"id": NaN}', '{} {}', "[]", "null", "5", '"x"'])
def test_bad_payloads(spark, bad):
    assert S.shred(records(spark, bad), "record_id", "payload").count() == 0


def test_tables(spark):
    r = records(spark, {"id": 12345678901234567890, "text": "\ud83d x", "favorite_count": 3, "hashtags": ["a"], "user": user(name=None), "media": media("a")}, {"id": "1", "quoted_tweet": "not json", "user": None})
    nodes = S.shred(r, "record_id", "payload")
    p = {x.record: x for x in S.posts(nodes).collect()}
    assert (p[0].tweet_id, p[0].favorite_count, p[0].hashtags, p[0].parent_node) == ("12345678901234567890", 3, ["a"], None)
    assert p[1].tweet_id == "1" and len(p) == 2
    assert [(u.record, u.screen_name, u.name) for u in S.users(nodes).collect()] == [(0, "ann", "")]
    assert rows(S.media(nodes), "record", "media_pos", "kind", "media_url") == [(0, 0, "photo", "a")]


def test_redelivery_and_empty(spark):
    one = {"id": "1", "user": user(), "media": media("a")}
    assert [r[0] for r in found(spark, one, one)] == [0, 1]
    assert found(spark) == []


def test_partitions_do_not_matter(spark):
    payloads = [{"id": str(i), "user": user(), "media": media("a", "b"), "quoted_tweet": {"id": f"q{i}", "media": media("c")}} for i in range(40)]
    r = records(spark, *payloads)
    want = rows(S.media_of_posts(S.shred(r.repartition(1), "record_id", "payload")))
    assert len(want) == 120
    assert rows(S.media_of_posts(S.shred(r.repartition(16), "record_id", "payload"))) == want
