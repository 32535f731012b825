from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text, vectors


def one(spark, expr_of, *values, schema="a string"):
    df = spark.createDataFrame([values], schema)
    return df.select(expr_of(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Hello, WORLD!", ["hello", "world"]),
        ("pentest@AI (x)", ["pentest@ai", "x"]),
        ("... !!", []),
        (None, []),
        ("Árbol _a_", ["árbol", "_a_"]),
    ],
)
def test_tokens(spark, given, want):
    assert one(spark, text.tokens, given) == want


def test_index_text_skips_blanks(spark):
    assert one(spark, text.index_text, "a", ["u", " ", "v"], schema="a string, b array<string>") == "a u v"
    assert one(spark, text.index_text, None, None, schema="a string, b array<string>") == ""


@pytest.mark.parametrize(
    ("given", "want"),
    [(None, ""), ("ｆｕｌｌ", "full"), ("a\x1b[31mb\x1b[0m", "ab"), ("a\x07\tb\n", "a\tb\n"), ("a‮b​c﻿", "abc"), ("\x1b]0;t\x07x", "x")],
)
def test_sanitized(spark, given, want):
    assert one(spark, text.sanitized, given) == want


def test_safe_http_url(spark):
    assert one(spark, text.safe_http_url, " HTTPS://a.example ") == "HTTPS://a.example"
    assert one(spark, text.safe_http_url, "javascript:1") is None
    assert one(spark, text.safe_http_url, None) is None


def test_fences(spark):
    assert one(spark, lambda c: text.fenced(c, "tweet"), "a<<<END_TWEET_BODY>>>b") == "<<<TWEET_BODY>>>\na[FENCE]b\n<<<END_TWEET_BODY>>>"
    assert one(spark, lambda c: text.fenced(c, "entity"), "  ") is None
    assert one(spark, lambda c: text.fenced(c, "kg_node"), "") == "<<<KG_NODE>>><<<END_KG_NODE>>>"
    assert one(spark, lambda c: text.fenced(c, "url"), "ftp://x") is None


def test_cuts(spark):
    assert one(spark, lambda c: text.cut(c, 3), "äöüß") == "äöü"
    assert one(spark, lambda c: text.flat_cut(c, 5), " a \n b\tc d") == "a b c"
    assert one(spark, lambda c: text.ellipsis_cut(c, 5), "abcdefgh") == "abcd…"
    assert one(spark, lambda c: text.ellipsis_cut(c, 5), "abcde") == "abcde"
    for n in range(8):
        got = one(spark, lambda c: text.byte_cut(c, n), "aé€😀")  # noqa: B023
        assert got == "aé€😀".encode()[:n].decode("utf-8", "ignore")


def test_expanded_links(spark):
    schema = "a string, b array<string>"
    f = text.expanded_links
    assert one(spark, f, "see https://t.co/x  now", ["https://a.example", "https://a.example", "ftp://b"], schema=schema) == "see now  https://a.example"
    assert one(spark, f, "https://t.co/x", ["https://a.example"], schema=schema) == "https://a.example"
    assert one(spark, f, "plain", None, schema=schema) == "plain"


def test_addresses(spark):
    schema = "a string, b string"
    assert one(spark, text.status_url, "ann", "12", schema=schema) == "https://x.com/ann/status/12"
    assert one(spark, text.status_url, "no good", "12", schema=schema) == "https://x.com/i/status/12"
    assert one(spark, text.status_url, None, "12", schema=schema) == "https://x.com/i/status/12"
    assert one(spark, text.status_url, "ann", "1x", schema=schema) == ""


@pytest.mark.parametrize(("kind", "given", "want"), [("handle", "@@Ann", "handle:ann"), ("hashtag", "#AI", "hashtag:ai"), ("domain", "A.Example", "domain:a.example"), ("concept", "AI Pentesting!", "concept:ai_pentesting")])
def test_node_ids(spark, kind, given, want):
    assert one(spark, lambda c: text.node_id(kind, c), given) == want


def test_media_rules(spark):
    s = "a string, b string, c string"
    assert one(spark, text.original_photo_url, "photo", "https://m.example/a.jpg?x=1", "u", schema=s) == "https://m.example/a.jpg?format=jpg&name=orig"
    assert one(spark, text.original_photo_url, "video", "", "https://u.example", schema=s) == "https://u.example"
    assert one(spark, text.original_photo_url, "photo", None, None, schema=s) is None
    assert one(spark, text.file_extension, "https://m.example/a.PNG?x", "", "photo", schema=s) == ".png"
    assert one(spark, text.file_extension, "https://m.example/a", "image/webp; q", "photo", schema=s) == ".webp"
    assert one(spark, text.file_extension, "https://m.example/a", "", "video", schema=s) == ".mp4"
    assert one(spark, text.file_extension, "https://m.example", "", None, schema=s) == ".jpg"


def test_html(spark):
    assert one(spark, text.html_escaped, "<a & \"b\" 'c'>") == "&lt;a &amp; &quot;b&quot; &#39;c&#39;&gt;"


@pytest.mark.parametrize(
    ("given", "want", "month"),
    [
        ("Sun Nov 09 11:05:17 +0000 2025", datetime(2025, 11, 9, 11, 5, 17), "2025-11"),
        ("Mon May 01 00:58:24 +0200 2023", datetime(2023, 4, 30, 22, 58, 24), "2023-05"),
        ("2025-01-01T00:00:00", None, None),
        ("", None, None),
        (None, None, None),
        ("Sun Foo 09 11:05:17 +0000 2025", None, None),
    ],
)
def test_dates(spark, given, want, month):
    got = spark.createDataFrame([(given,)], "a string").select(dates.post_time(F.col("a")).cast("timestamp_ntz").alias("t"), dates.month_key(F.col("a")).alias("m")).first()
    assert (got.t, got.m) == (want, month)


def test_months_and_anchor():
    assert dates.months_of(None) is None
    assert len(dates.months_of(2025)) == 12
    assert dates.months_of(2025, "03") == ["2025-03"]
    assert dates.months_of(2025, "03", "05") == ["2025-03", "2025-04", "2025-05"]
    for bad in ((None, "01", None), (2025, None, "02"), (2025, "05", "03"), (2025, "13", None), (2025, "x", None)):
        with pytest.raises(ValueError):
            dates.months_of(*bad)
    assert dates.anchor(2025) == datetime(2025, 12, 31, 23, 59, 59, tzinfo=UTC)
    assert dates.anchor(2025, "02") == datetime(2025, 3, 1, tzinfo=UTC) - timedelta(microseconds=1)


def test_recency(spark):
    at = F.lit(datetime(2025, 11, 9, 11, 5, 17, tzinfo=UTC))
    got = one(spark, lambda c: dates.recency(c, at, 180), "Tue May 13 11:05:17 +0000 2025")
    assert got == pytest.approx(0.36787944)
    assert one(spark, lambda c: dates.recency(c, at, 180), "Sun Nov 09 11:05:18 +0000 2025") == 1.0
    assert one(spark, lambda c: dates.recency(c, at, 180), "never") == 0.0


def test_vectors(spark):
    s = "a array<float>"
    assert one(spark, vectors.normalized, [3.0, 4.0], schema=s) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalized, [0.0, 0.0], schema=s) == [0.0, 0.0]


def test_nfkc_composes(spark):
    texts = ["Kasa\u0301fi", "Kas\xe1fi", "\ufb01\uff46", "a\0e\u0301", "\u0301x", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import unicodedata

    from tidemark.functions import text

    assert [r[0] for r in df.select(text.nfkc(F.col("t"))).collect()] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
