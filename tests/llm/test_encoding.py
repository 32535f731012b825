import numpy as np
import pytest

from conftest import rows
from tidemark.llm import encoding as E

CLEAN = [
    "Era così bello che il caffè non è più economico, perché è già finito – “davvero”.",
    "La estación todavía perdía los números; el señor preguntó por el avión… ¿mañana?",
    "Der schöne Käse wäre für die Müllers größer, «über» alles – 5 € und ½ Pfund.",
    "Это длинная ветка и последний ночной поезд уже ищет второе мнение, а мы всё ждали.",
    "Miejska biblioteka wciąż usuwa świeży chleb, a pociąg mógłby zażółcić gęślą jaźń.",
    "L’été de la bibliothèque : ça a été réglé, où êtes-vous ? puis À gauche, Ç et É.",
    "A plain text with no signs at all. 😂 🎉",
]


def corpus(spark, *extra):
    texts = CLEAN * 200 + list(extra)
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, restored string"), len(CLEAN) * 200


GARBLED = [
    (CLEAN[0], "utf-8", "cp1252"),
    (CLEAN[1], "utf-8", "latin-1"),
    (CLEAN[2], "utf-8", "mac_roman"),
    (CLEAN[3], "utf-8", "cp866"),
    ("Это длинная ветка, последний ночной поезд уже ищет второе мнение.", "cp1251", "latin-1"),
    ("Это длинная ветка, последний ночной поезд уже ищет второе мнение.", "koi8-r", "cp1251"),
    (CLEAN[5], "utf-8", "cp437"),
]


def spoil(text, written, read):
    raw = text.encode(written)
    if read == "cp1252":
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    return raw.decode(read)


def test_garbled_texts_are_restored(spark):
    bad = [spoil(t.replace("😂", ""), w, r) for t, w, r in GARBLED]
    df, n = corpus(spark, *bad)
    got = {r.id: r.restored for r in E.garbled_documents(df, "doc_id", "text").collect()}
    assert set(got) == set(range(n, n + len(bad)))
    assert [got[n + i] for i in range(len(bad))] == [t for t, _, _ in GARBLED]


def test_passages_words_and_signs(spark):
    bad = ["Era cosÃ¬ bello che il caffè non è più", "Der schÃ¶ne Käse wäre für", "La estación â€” todavía", "cosÃƒÂ¬ bello", "cost Â£ 30", "ma�ana", "waiting.â€ The", "a party ðŸŽ‰ now"]
    df, n = corpus(spark, *bad)
    got = {r.id - n: r.restored for r in E.garbled_documents(df, "doc_id", "text").collect()}
    assert set(got) == set(range(len(bad)))
    assert got[0] == "Era così bello che il caffè non è più" and got[1] == "Der schöne Käse wäre für"
    assert got[3] == "così bello" and got[4] == "cost £ 30" and got[5] == "ma�ana" and got[7] == "a party 🎉 now"


def test_frequent_garbling_does_not_vouch_for_itself(spark):
    """Pairs of garbled passages that hundreds of texts have are probable ones, but the passages are found."""
    bad = ["Der Käse â€” der Schöne", "Il cafÃ© è già finito", "una maÃ±ana", "ma�ana", "a\x9db", "cut â€ off"] * 300
    df, n = corpus(spark, *["Der Käse – der Schöne — und", "Il café è già finito", "una mañana"] * 1000, *bad)
    model = E.pair_counts(df, "text")
    assert (model.improbable[np.searchsorted(model.keys, [ord("â") << 21 | ord("€"), ord("Ã") << 21 | ord("©"), ord("a") << 21 | 0xFFFD])] < 0).all()
    got = {r.id - n - 3000: r.restored for r in E.garbled_documents(df, "doc_id", "text").collect()}
    assert set(got) == set(range(len(bad)))
    assert [got[i] for i in range(3)] == ["Der Käse — der Schöne", "Il café è già finito", "una mañana"]


def test_frequent_one_byte_garbling(spark):
    """Letters that stand together as in no word are tested however many texts have them."""
    clean = "Это длинная ветка, последний ночной поезд уже ищет второе мнение."
    bad = [spoil(clean, "cp1251", "latin-1"), spoil(clean, "koi8-r", "cp1251")] * 60
    df, n = corpus(spark, *[clean] * 600, *bad)
    got = {r.id - n - 600: r.restored for r in E.garbled_documents(df, "doc_id", "text").collect()}
    assert set(got) == set(range(len(bad)))


def test_signs_alone(spark):
    bad = ["cost \u252c\u00fa 30", "cost \u00ac\u00a3 30", "cost \u00c3\u201a\u00c2\u00a3 30"]
    df, n = corpus(spark, "cost £ 30", *bad)
    assert {r.id - n: r.restored for r in E.garbled_documents(df, "doc_id", "text").collect()} == {1: "cost £ 30", 2: "cost £ 30", 3: "cost £ 30"}


def test_pairs_beyond_the_kept_are_counted(spark, monkeypatch):
    """With few pairs kept, the others are counted in buckets: no pair and no total is lost."""
    df = spark.createDataFrame([("abcdefgh",), ("abcé",), ("xéz",)], "t string")
    whole = E.pair_counts(df, "t")
    monkeypatch.setattr(E, "PAIRS", 3)
    some = E.pair_counts(df, "t")
    assert len(some.keys) == 3 and some.total == whole.total
    assert (some.count(whole.keys) >= whole.counts).all() and some.rest.sum() == whole.total - some.counts.sum()


@pytest.mark.parametrize("kept", [1, 3, 60, 200])
def test_results_are_those_of_all_pairs_however_few_are_sent(spark, monkeypatch, kept):
    """pairs beyond the kept count exactly, for every rule that reads a count, and also where other pairs share their bucket."""
    bad = [spoil(t.replace("😂", ""), w, r) for t, w, r in GARBLED] + ["cosÃƒÂ¬ bello", "cost Â£ 30", "ma\ufffdana", "a party ðŸŽ‰ now", "cost \u252c\u00fa 30", "il cafÃ© e cosÃ¬ Ã¨", "日本語の文", "", None]
    df, n = corpus(spark, *bad)
    df = df.unionByName(df.where(f"doc_id = {n}")).repartition(3)  # a repeated row
    whole = rows(E.garbled_documents(df, "doc_id", "text"))
    assert len(whole) == len(GARBLED) + 7
    exact = E.pair_counts(df, "text")
    monkeypatch.setattr(E, "PAIRS", kept)
    assert rows(E.garbled_documents(df, "doc_id", "text")) == whole
    model = E.pair_counts(df, "text")
    assert model.singles == exact.singles and model.total == exact.total
    model.rest[:] += 1000  # as if every bucket had other pairs too
    assert rows(E.garbled_documents(df, "doc_id", "text", model)) == whole


def test_counts_are_asked_for_and_told(spark, monkeypatch):
    """a pair that was not sent is nowhere taken for its bucket's sum."""
    df = spark.createDataFrame([("abcdefgh",), ("abcé",), ("xéz",)], "t string")
    whole = E.pair_counts(df, "t")
    monkeypatch.setattr(E, "PAIRS", 3)
    some = E.pair_counts(df, "t")
    some.rest[:] += 5
    some.count(whole.keys)
    assert some.asked == set(whole.keys.tolist()) - set(some.keys.tolist())
    assert rows(some.every) == sorted(zip(whole.keys.tolist(), whole.counts.tolist()), key=repr)
    some.told = whole.keys, whole.counts
    some.asked.clear()
    assert (some.count(whole.keys) == whole.counts).all() and not some.asked
    assert np.array_equal(some.improbability(whole.keys, some.count(whole.keys)), whole.improbable)


@pytest.mark.parametrize("name", E.READ_AS)
def test_marked_runs_miss_no_sequence(name):
    """Every run with a whole sequence of a known character is marked, at either end of a row too."""
    sample = "éß—“€я中🎉"
    model = E.PairModel(np.array([ord(ch) << 21 | 32 for ch in sorted(sample)]), np.ones(len(sample), np.int64), len(sample))
    back = E._from_bytes(name)
    for ch in sample:
        raw = ch.encode("utf-8")
        if all(b in back for b in raw):
            cps = np.array([ord(x) for x in "".join(back[b] for b in raw)], np.uint32)
            assert E.broken_runs(model, np.concatenate((cps, cps)), np.array([0, len(cps), 2 * len(cps)])) == [(0, 0, len(cps)), (1, len(cps), 2 * len(cps))]


@pytest.mark.parametrize("text", ["MAÇÃ… foi-se", "«PEQUEÑ…», dijo", "„Ä…“ und", "IRMÃ – IRMÃO", "«ÇÂ», puis «ÂGÉ»", "±3 °C", "© Name", "™ Name", "12 €", "¿Nombre?", "├── a\n│   └── b", "É»", "Ελληνικά", "日本語の文", "", None, "é" * 100_000])
def test_unusual_texts_are_left_alone(spark, text):
    df, n = corpus(spark, text)
    assert E.garbled_documents(df, "doc_id", "text").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert E.garbled_documents(df, "doc_id", "text").count() == 0
    assert E.garbled_documents(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_segments():
    def brute(s):
        """Maximal segments by their definition: repeatedly the best one, then what is left of both sides."""
        if len(s) == 0:
            return []
        best, at = 0.0, None
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if (x := sum(s[i:j])) > best + 1e-9:
                    best, at = x, (i, j)
        if at is None:
            return []
        i, j = at
        return [*brute(s[:i]), (i, j), *[(a + j, b + j) for a, b in brute(s[j:])]]

    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(size=rng.integers(0, 12))
        assert E.segments(s) == brute(s.tolist())


def test_counts(spark):
    df = spark.createDataFrame([("ab",), ("abé",), ("éb",), (None,), ("x",)], "t string").repartition(3)
    m = E.pair_counts(df, "t")
    n = dict(zip(m.keys.tolist(), m.counts.tolist(), strict=True))
    assert n == {ord("a") << 21 | ord("b"): 2, ord("b") << 21 | ord("é"): 1, ord("é") << 21 | ord("b"): 1} and m.total == 4
