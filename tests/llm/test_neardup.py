import random
import re

import pyarrow as pa
import pytest

from conftest import rows
from tidemark.llm import neardup, textform

VOCAB = [f"w{i}" for i in range(60)]


def brute(texts, t, least):
    forms = textform.consistent_array(pa.array([x for _, x in texts], pa.string())).to_pylist()
    sets = [(i, frozenset(re.findall(r"[^\W_]+", f.lower()))) for (i, _), f in zip(texts, forms, strict=True) if f is not None and i is not None]
    sets = [(i, w) for i, w in sets if len(w) >= least]
    return sorted({(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and len(x & y) >= t * len(x | y) - 1e-12})


@pytest.mark.parametrize(("t", "least"), [(0.7, 8), (0.5, 3), (0.9, 5), (1.0, 8)])
def test_all_pairs(spark, t, least):
    random.seed(int(t * 10))
    texts = []
    for i in range(120):
        w = random.sample(VOCAB, random.randint(4, 20)) + [f"n{i}"]
        texts.append((f"{i:03d}", " ".join(w)))
        for k in range(random.randint(0, 3)):
            v = list(w)
            for _ in range(random.randint(0, 3)):
                v[random.randrange(len(v))] = random.choice(VOCAB)
            random.shuffle(v)
            texts.append((f"{i:03d}-{k}", " ".join(v).upper() if k else " ".join(v)))
    texts += [("same1", texts[0][1]), ("same2", texts[0][1]), (None, texts[0][1]), ("none", None), ("empty", ""), ("short", "a b")]
    df = spark.createDataFrame(texts + texts[:5], "id string, text string")
    want = brute(texts, t, least)
    assert len(want) > 20
    for parts in (1, 9):
        assert rows(neardup.near_duplicate_pairs(df.repartition(parts), "id", "text", t, least)) == want


def test_template_texts(spark):
    """Texts of one template share most words, but few are near: none is lost, none is invented."""
    random.seed(1)
    texts = [(str(i), f"there were {random.randrange(40)} people at the n{random.randrange(30)} meetup with m{random.randrange(30)} today in the hall") for i in range(400)]
    df = spark.createDataFrame(texts, "id string, text string")
    assert rows(neardup.near_duplicate_pairs(df, "id", "text")) == brute(texts, 0.7, 8)


def test_edges(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert neardup.near_duplicate_pairs(df, "id", "text").count() == 0
    long = " ".join(f"x{i}" for i in range(70_000))
    df = spark.createDataFrame([("1", long, "c"), ("2", long + " y", "c"), ("3", "é é a b c d e f g", "c"), ("4", "é a b c d e f g", "c")], "id string, text string, c1 string")
    assert rows(neardup.near_duplicate_pairs(df, "id", "text")) == [("1", "2"), ("3", "4")]
    with pytest.raises(ValueError):
        neardup.near_duplicate_pairs(df, "id", "text", 0)


def test_groups(spark):
    base = "a b c d e f g h i j"
    df = spark.createDataFrame([("1", base), ("2", base), ("3", base + " k"), ("4", base + " k l"), ("9", "nothing like it at all in here my friend now"), ("5", None)], "id string, text string")
    got = {r.id: (r["group"], r.links) for r in neardup.near_duplicate_groups(df, "id", "text", 0.8).collect()}
    assert {got[i][0] for i in "1234"} == {got["1"][0]} and got["9"][0] != got["1"][0] and "5" not in got
    assert got["9"][1] == 0 and got["3"][1] == 2


def test_words_of_either_script(spark):
    """A word of look-alikes alone is the same word in texts of more Latin or more Cyrillic letters, in either case."""
    base = "я спросил у них про вот это и ответа не было"
    names = "Pihadothstrand Zitrastind"
    df = spark.createDataFrame([("1", base), ("2", f"{base} {names}"), ("3", f"{base.replace(' у ', ' y ').replace('вот', 'BOT')} {names}")], "id string, text string")
    assert rows(neardup.near_duplicate_pairs(df, "id", "text", 0.8)) == [("1", "2"), ("1", "3"), ("2", "3")]
