import random
import unicodedata

import pyarrow as pa
import pytest

from conftest import rows
from tidemark.llm import canon, textform as tf, words


def form(*texts):
    return tf.consistent_array(pa.array(list(texts), pa.string())).to_pylist()


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Zoë", "Zoë"),
        ("Ｚａｐｙｔａłｅｍ　x", "Zapytałem x"),
        ("a​b­c⁠d‮e", "abcde"),
        ("👩‍💻x", "👩‍💻x"),
        ("👩‌‍​💻", "👩‍💻"),
        ("a‍b", "ab"),
        ("❤️", "❤️"),
        ("Нer ﬁrst notеbook quietlу", "Her first notebook quietly"),
        ("𝐝𝐢𝐠𝐞𝐬𝐭", "digest"),
        ("Νο", "No"),
        ("сор", "cop"),
        ("День с мaмa", "День с мама"),
        ("a  b \n c ", "a b\nc"),
        ("x² ½ ①", "x² ½ ①"),
        ("q̣́", "q̣́"),
        ("각", "각"),
        ("", ""),
        (" ​ ", ""),
        (None, None),
    ],
)
def test_forms(given, want):
    assert form(given) == [want]
    assert form("plain", given, "Ａ")[1] == want
    if want:
        assert form(want) == [want]


def test_differences_stay():
    kept = ["Cafe", "Café", "cafe", "Cafe.", "Cafe!", "Wandá", "Wanda"]
    assert form(*kept) == kept


def test_composition_is_nfc():
    random.seed(3)
    pool = [chr(c) for c in [*range(0x300, 0x345), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x5B4, 0x5BC, *range(97, 123)]]
    texts = ["".join(random.choices(pool, k=random.randint(0, 12))) for _ in range(3000)]
    t = tf.tables()
    cps, off = tf._expanded(*tf.decode(pa.array(texts)), t)
    cps, off = tf._composed(tf._ordered(cps, off, t), off, t)
    want = [unicodedata.normalize("NFC", "".join("" if t.length[ord(x)] == 0 else tf._expand(x) for x in s)) for s in texts]
    assert tf.encode(cps, off).to_pylist() == want


def test_slices_and_chunks():
    a = pa.array(["x", None, "Ａ", "", "é", "b​"])
    assert tf.consistent_array(a[1:5]).to_pylist() == [None, "A", "", "é"]
    assert tf.consistent_array(pa.chunked_array([a[:2], a[2:]])).to_pylist() == ["x", None, "A", "", "é", "b"]
    assert tf.consistent_array(pa.array([], pa.string())).to_pylist() == []


def test_portions(monkeypatch):
    texts = ["Ａ", None, "é" * 30, "", "b​", "ｃ" * 9] * 5
    want = tf.consistent_array(pa.array(texts)).to_pylist()
    monkeypatch.setattr(tf, "PORTION", 20)
    parts = list(tf.portions(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0))
    assert len(parts) > 5 and sum(b.num_rows for b in parts) == len(texts)
    assert tf.consistent_array(pa.array(texts)).to_pylist() == want


def test_long_text():
    assert form("é" * 300_000 + "​")[0] == "é" * 300_000


def test_words():
    v, r = words.word_sets(pa.array(["A b a, B! é", "e", None, "hello_world 12"]))
    assert r.tolist() == [0, 3, 4, 4, 7]
    assert v[3] not in v[:3]


def test_pairs(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "а b"), ("3", "a  b"), ("4", "a b"), ("5", "A b"), ("2", "а b"), (None, "а b"), ("", "a​ b"), ("6", None), ("7", ""), ("8", "​")], "id string, text string")
    assert rows(canon.same_reading_pairs(df, "id", "text")) == [("1", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4"), ("7", "8")]
    assert canon.same_reading_pairs(df.limit(0), "id", "text").count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("1", "a", 1, 2), ("2", "а", 1, 2)], "k string, v string, f1 int, form int")
    assert rows(canon.same_reading_pairs(df, "k", "v")) == [("1", "2")]
