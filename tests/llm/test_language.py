import os

import numpy as np
import pyarrow as pa
import pytest

from conftest import rows
from tidemark.llm import language as L

DATA = "/root/testdata/sf0.01"
SAMPLES = [
    ("en", "the cat was sleeping under the table while we were waiting for the train"),
    ("en", "this is what they thought about the weather and nobody asked them"),
    ("de", "die Katze schlief unter dem Tisch während wir auf den Zug gewartet haben"),
    ("de", "das ist es was sie über das Wetter dachten und niemand hat gefragt"),
    ("ru", "кошка спала под столом пока мы ждали поезд"),
    ("ru", "это то что они думали о погоде и никто не спросил"),
]


@pytest.fixture(scope="module")
def profiles():
    return L.train(SAMPLES)


def test_vectors_are_nearly_orthogonal():
    v = L.letter_vectors(np.arange(97, 123), 2048).astype(float)
    g = v @ v.T / 2048
    assert np.allclose(np.diag(g), 1) and np.abs(g - np.eye(26)).max() < 0.12
    a = np.array([97 << 32 | 98 << 16 | 99, 99 << 32 | 98 << 16 | 97], np.uint64)
    b = L.gram_vectors(a, 3, 2048).astype(float)
    assert abs(b[0] @ b[1]) / 2048 < 0.12  # order counts


def test_table_equals_bundles(profiles):
    cps, off = L.spoken(pa.array(["the weather", "das Wetter und", ""]))
    sums, weight = L.similarities(profiles, cps, off)
    pc, po = L.padded(*L.letters_only(cps, off))
    code, row = L.grams(pc, po, 3)
    for r in (0, 1):
        bundle = L.gram_vectors(code[row == r], 3, profiles.dims).astype(float).sum(axis=0)
        assert np.allclose(sums[r], profiles.prototypes[3] @ bundle, rtol=1e-3, atol=1e-2)
        assert weight[r] == (np.unique(code[row == r], return_counts=True)[1] ** 2).sum()
        assert abs((bundle @ bundle) / (profiles.dims * weight[r]) - 1) < 0.3  # near orthogonality


def test_languages(spark, profiles):
    df = spark.createDataFrame(
        [
            ("1", "We were waiting for the weather under the table. https://t.example/x #tag @who", "en-GB"),
            ("2", "Wir haben unter dem Tisch auf das Wetter gewartet.", None),
            ("3", "We were waiting for the weather under the table. Wir haben unter dem Tisch auf das Wetter gewartet!", "en"),
            ("4", "кошка ждала поезд под столом и никто не спросил", "und"),
            ("5", "the cat", "de"),
            ("6", "", None),
            ("7", None, None),
            ("8", "#a @b https://t.example 😀", None),
            ("9", "We were waiting for the Zabrukel and the Gotrufin under the table", "EN"),
            (None, "We were waiting for the weather under the table", None),
        ],
        "id string, text string, lang string",
    )
    got = rows(L.mislabelled(df.unionByName(df), profiles, "id", "text", "lang"))
    assert got == [("2", "de"), ("3", "de"), ("3", "en"), ("4", "ru")]
    full = {r.id: r for r in L.languages(df, profiles, "id", "text").collect()}
    assert full["7"].lang is None and full["6"].confidence == 0.0 and full["8"].langs == []
    assert full["1"].confidence > 0.9 and full["5"].words == 2
    s = L.language_stretches(df, profiles, "id", "text").where("id = '3'").orderBy("stretch").collect()
    assert [(r.lang, r.content[:3]) for r in s] == [("en", "We "), ("de", "Wir")]
    assert L.languages(df.limit(0), profiles, "id", "text").count() == 0


def test_fit_bounds(spark):
    samples = spark.createDataFrame(SAMPLES, "lang string, text string")
    labelled = spark.createDataFrame([(str(i), "we were waiting for the train under the table", "en_GB") for i in range(50)], "id string, text string, lang string")
    assert L.fit(samples, labelled, "id", "text", "lang", per_language=10).languages == ["de", "en", "ru"]
    assert L.fit(samples, labelled.limit(0), "id", "text", "lang").languages == ["de", "en", "ru"]
    with pytest.raises(ValueError):
        L.fit(samples.limit(0), labelled, "id", "text", "lang")


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
def test_held_out_accuracy(spark):
    """Profiles of two thirds of the sample sentences name the language of the last third."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{DATA}/lang_samples.parquet").to_pylist()
    p = L.train([(r["lang"], r["text"]) for r in t if r["sample_id"] % 3])
    rest = [r for r in t if r["sample_id"] % 3 == 0]
    sums, _ = L.similarities(p, *L.spoken(pa.array([r["text"] for r in rest])))
    right = [p.languages[k] == r["lang"] for k, r in zip(sums.argmax(axis=1), rest, strict=True)]
    assert sum(right) / len(right) >= 0.9


def test_repeats_count_squared(profiles):
    """A text of one word over and over has the norm of its bundle, not that of as many different n-grams."""
    cps, off = L.spoken(pa.array(["bla " * 50]))
    _, weight = L.similarities(profiles, cps, off)
    code, _ = L.grams(*L.padded(*L.letters_only(cps, off)), 3)
    bundle = L.gram_vectors(code, 3, profiles.dims).astype(float).sum(axis=0)
    assert weight[0] > 5 * len(code) and abs((bundle @ bundle) / (profiles.dims * weight[0]) - 1) < 0.3
