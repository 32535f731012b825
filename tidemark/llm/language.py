"""Problem 4: the language of each text, and of each stretch of a mixed text.

Method: hyperdimensional profiles.  Every letter has a random vector of +1 and
-1; an n-gram's vector is the product of its letters' vectors, each rotated by
its place; a profile is the bundle (sum) of n-gram vectors; texts are compared
with the languages' prototypes by cosine.

The cosine's numerator is linear in the text's n-grams, so each n-gram's product
with all prototypes is computed once, kept in a table, and gathered: the sum of
the gathered rows *is* the product of the text's bundle with the prototypes.
The bundle's norm follows from the n-gram vectors' near orthogonality, which is
what the method rests on: its square is dimensions x the sum of squared counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textform as tf
from tidemark.llm import words as w

#: Not language: links, tags, mentions.
ASIDE = r"(?i)\b(?:https?://|www\.)\S+|(?:^|[\s(])(?:rt|via)\s+@[\pL\pN_]+:?|[@#][\pL\pN_]+"
_GAP = 0x20
_MASK = np.uint64(0xFFFF)
_ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)


def letter_vectors(cps: np.ndarray, dims: int) -> np.ndarray:
    """Random +1/-1 vectors of letters, the same in every process."""
    with np.errstate(over="ignore"):
        seed = (cps.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(dims // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
        bits = w.mix(w.mix(seed + np.uint64(0x2545F4914F6CDD1D)))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1)[:, :dims]


def gram_vectors(codes: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Bound vectors of n-grams (n <= 4) given as packed code points (16 bits each, first letter highest)."""
    out = None
    for place in range(n):
        cps = (codes >> np.uint64(16 * (n - 1 - place))) & _MASK
        u, inv = np.unique(cps, return_inverse=True)
        v = np.roll(letter_vectors(u, dims), place, axis=1)[inv]
        out = v if out is None else out * v
    return out


#: Labelled rows of each language that the profiles are fitted on, at most about this many.
SAMPLE = 2500
#: Bytes of the labelled rows of each language that the profiles are fitted on, on average at most.
SAMPLE_BYTES = 4_000_000
#: A sentence needs so many words to count as whole beside the text's main language.
WHOLE = 6
#: A sentence is of another language than its text's if its cosine is larger by so much.
MARGIN = 0.04
#: Scale of cosine differences in confidences.
SCALE = 0.04


@dataclass
class Profiles:
    """Prototypes of languages, and the products of n-grams met so far with them."""

    languages: list[str]
    prototypes: dict[int, np.ndarray]  # by n: (languages, dims), centred, of unit length
    dims: int
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    #: n-grams kept with their products in one process, for each n
    KEEP = 400_000

    def products(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Each n-gram vector's product with each prototype."""
        u, inv = np.unique(codes, return_inverse=True)
        keys, rows = self.known.get(n, (np.zeros(0, np.uint64), np.zeros((0, len(self.languages)), np.float32)))
        at = np.minimum(np.searchsorted(keys, u), max(len(keys) - 1, 0))
        have = keys[at] == u if len(keys) else np.zeros(len(u), bool)
        new = u[~have]
        out = np.empty((len(u), len(self.languages)), np.float32)
        out[have] = rows[at[have]]
        if len(new):
            made = np.concatenate([gram_vectors(new[i : i + 8192], n, self.dims).astype(np.float32) @ self.prototypes[n].T for i in range(0, len(new), 8192)])
            out[~have] = made
            if len(keys) + len(new) > self.KEEP:
                keys, rows = keys[:0], rows[:0]
            keys, rows = np.concatenate((keys, new)), np.concatenate((rows, made))
            order = np.argsort(keys)
            self.known[n] = keys[order], rows[order]
        return out[inv]


def letters_only(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and marks with one blank before, after and between words."""
    kind = tf.tables().kind[cps]
    letter = (kind == tf.LETTER) | (kind == tf.MARK) | (cps == 0x27) | (cps == 0x2019)
    out = np.where(letter, np.where(cps == 0x2019, 0x27, w.lower_table()[cps]), _GAP).astype(np.uint32)
    n = len(out)
    head = tf.row_starts(n, off)
    keep = np.ones(n, bool)
    keep[1:] = (out[1:] != _GAP) | (out[:-1] != _GAP) | head[1:]
    return tf.keep_only(out, off, keep)


def padded(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With a blank before and behind each row."""
    rows = len(off) - 1
    out = np.full(len(cps) + 2 * rows, _GAP, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(off))
    out[np.arange(len(cps)) + 2 * row + 1] = cps
    return out, off + 2 * np.arange(rows + 1)


def grams(cps: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams inside rows that are not split by a blank in their middle, packed, and their rows."""
    m = len(cps) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    code = np.zeros(m, np.uint64)
    for i in range(n):
        code = (code << np.uint64(16)) | (cps[i : i + m].astype(np.uint64) & _MASK)
    ok = row[:m] == row[n - 1 :]
    for i in range(1, n - 1):
        ok &= cps[i : i + m] != _GAP
    return code[ok], row[:m][ok]


def train(samples: Sequence[tuple[str, str]], sizes: Sequence[int] = (3,), dims: int = 2048) -> Profiles:
    """Profiles of (language, text) samples; an n-gram enters a language's bundle with the logarithm of its count."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        if lang and text:
            by.setdefault(lang, []).append(text)
    languages = sorted(by)
    prototypes = {}
    for n in sizes:
        bundles = np.zeros((len(languages), dims), np.float32)
        for k, lang in enumerate(languages):
            code, _ = grams(*padded(*letters_only(*tf.decode(tf.consistent_array(pa.array(by[lang]))))), n)
            u, c = np.unique(code, return_counts=True)
            weight = np.log1p(c * (1e4 / max(c.sum(), 1))).astype(np.float32)
            for i in range(0, len(u), 8192):
                bundles[k] += weight[i : i + 8192] @ gram_vectors(u[i : i + 8192], n, dims).astype(np.float32)
        if len(languages) > 1:
            bundles -= bundles.mean(axis=0)
        prototypes[n] = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
    return Profiles(languages, prototypes, dims)


def _squares(code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Each row's sum of the squared counts of its n-grams; rows rise."""
    # one sort of mixed keys: rows stay apart, equal n-grams of a row stand together (but for chance meetings of 40 bits)
    with np.errstate(over="ignore"):
        key = np.sort((w.mix(code) >> np.uint64(24)) | (row.astype(np.uint64) << np.uint64(40)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.concatenate((new, [len(key)])))
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), (count * count).astype(np.float64), rows)


def similarities(p: Profiles, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, weight): each row's bundle times each prototype, over n-gram sizes, and its n-grams' squared counts; cosine = sums / sqrt(dims * weight)."""
    rows = len(off) - 1
    sums = np.zeros((rows, len(p.languages)))
    total = np.zeros(rows)
    padded_cps, padded_off = padded(*letters_only(cps, off))
    for n in p.prototypes:
        code, row = grams(padded_cps, padded_off, n)
        if len(code) == 0:
            continue
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sums[row[first]] += np.add.reduceat(p.products(code, n), first, axis=0)
        total += _squares(code, row, rows)
    return sums, total


def spoken(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text as read, links, tags and mentions replaced by line breaks."""
    return tf.decode(pc.replace_substring_regex(tf.consistent_array(arr).fill_null(""), ASIDE, "\n"))


def stretches(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of sentences (cut at line breaks and behind closing signs), and each one's row; rows without text have none."""
    n = len(cps)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    gap = np.ones(n, bool)
    gap[:-1] = (cps[1:] == 0x20) | (cps[1:] == 0x0A) | tf.row_starts(n, off)[1:]
    cut = (cps == 0x0A) | (np.isin(cps, _ENDS) & gap)
    at = np.union1d(off, np.flatnonzero(cut) + 1)
    row = np.searchsorted(off, at[:-1], side="right") - 1
    return at, row


def word_counts(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each row: pieces between blanks that hold a letter or digit."""
    n = len(cps)
    if n == 0:
        return np.zeros(len(off) - 1, np.int64)
    kind = tf.tables().kind[cps]
    solid = (kind == tf.LETTER) | (kind == tf.DIGIT)
    blank = (cps == 0x20) | (cps == 0x0A)
    head = tf.row_starts(n, off)
    piece = np.cumsum(blank | head)
    at = np.flatnonzero(solid)
    if len(at) == 0:
        return np.zeros(len(off) - 1, np.int64)
    first = at[np.concatenate(([True], np.diff(piece[at]) > 0))]
    return np.bincount(np.searchsorted(off, first, side="right") - 1, minlength=len(off) - 1)


def judged(p: Profiles, cps: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Sentences (``at`` offsets, ``row``, ``words``, ``lang``, ``sure``) and texts (``main``, ``main_sure``, ``count``)."""
    rows = len(off) - 1
    at, row = stretches(cps, off)
    count = word_counts(cps, off)
    if len(row) == 0:
        z = np.zeros(rows)
        return {"at": at, "row": row, "words": row, "lang": row, "sure": z[:0], "main": z.astype(int), "main_sure": z, "count": count}
    sums, weight = similarities(p, cps, at)
    words = word_counts(cps, at)
    whole, whole_weight = np.zeros((rows, len(p.languages))), np.zeros(rows)
    np.add.at(whole, row, sums)
    np.add.at(whole_weight, row, weight)
    main = whole.argmax(axis=1)
    cos = sums / np.sqrt(p.dims * np.maximum(weight, 1))[:, None]
    best = cos.argmax(axis=1)
    ahead = cos[np.arange(len(row)), best] - cos[np.arange(len(row)), main[row]]
    lang = np.where((words >= WHOLE) & (ahead >= MARGIN), best, main[row])

    def sure(c: np.ndarray, k: np.ndarray) -> np.ndarray:
        e = np.exp((c - c.max(axis=1, keepdims=True)) / SCALE)
        return e[np.arange(len(k)), k] / e.sum(axis=1)

    whole_cos = whole / np.sqrt(p.dims * np.maximum(whole_weight, 1))[:, None]
    return {"at": at, "row": row, "words": words, "lang": lang, "sure": sure(cos, lang), "main": main, "main_sure": np.where(whole_weight > 0, sure(whole_cos, main), 0.0), "count": count}


def primary(label):
    """The language part of a label such as ``pt-BR`` or ``de_DE``, in lower case."""
    return F.lower(F.trim(F.split(label, "[-_]")[0]))


def fit(samples: DataFrame, labelled: DataFrame, ident: str, text: str, lang: str, per_language: int = SAMPLE) -> Profiles:
    """Profiles from sample sentences (lang, text), refined on a bounded sample of labelled rows.

    The bound is per_language rows and SAMPLE_BYTES of each language, taken by a hash of the id;
    of these only sentences count whose label the first profiles agree with.
    """
    first = [(r.lang, r.text) for r in samples.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").collect()]
    if not first:
        raise ValueError("no sample sentences")
    profiles = train(first)
    rows = labelled.select(F.col(ident).alias("id"), F.col(text).alias("text"), primary(F.col(lang)).alias("lang")).where(F.col("lang").isin(profiles.languages) & F.col("text").isNotNull())
    # one row for each language; every step-th row is taken
    per = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    sizes = {r.lang: max(-(-r.n // per_language), -(-r.bytes // SAMPLE_BYTES), 1) for r in per}
    if not sizes:
        return profiles
    step = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)])
    got = rows.where(F.pmod(F.xxhash64("id"), step[F.col("lang")]) == 0).select("lang", "text").toArrow()
    label = np.array(got["lang"].to_pylist(), dtype=object)
    if len(label) == 0:
        return profiles
    cps, off = spoken(got["text"].combine_chunks())
    j = judged(profiles, cps, off)
    agree = (j["words"] >= WHOLE) & (np.array(profiles.languages, dtype=object)[j["lang"]] == label[j["row"]])
    sentences = tf.encode(cps, j["at"]).take(pa.array(np.flatnonzero(agree))).to_pylist()
    return train(first + list(zip(label[j["row"][agree]], sentences, strict=True)))


def languages(df: DataFrame, profiles: Profiles, ident: str, text: str, label: str | None = None) -> DataFrame:
    """(id, label, words, lang, confidence, langs) of each row.

    lang is the text's main language, langs those of its whole sentences, in
    order of appearance.  Null and empty texts and texts without letters have 0
    confidence, no language and no langs; label is null where none is named.
    """
    p = df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        own = p.value
        names = np.array(own.languages, dtype=object)
        for b in (part for every in batches for part in tf.portions(every, 1)):
            cps, off = spoken(b.column(1))
            j = judged(own, cps, off)
            whole = np.flatnonzero((j["words"] >= WHOLE) | (j["lang"] == j["main"][j["row"]]) & (j["words"] > 0))
            code = j["row"][whole] * len(names) + j["lang"][whole]
            _, firsts = np.unique(code, return_index=True)
            firsts = np.sort(firsts)
            row, lang = code[firsts] // len(names), code[firsts] % len(names)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            none = j["main_sure"] == 0
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array(j["count"].astype(np.int32)),
                    pa.array(np.where(none, None, names[j["main"]]), pa.string()),
                    pa.array(j["main_sure"]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(names[lang], pa.string())),
                ],
                ["id", "label", "words", "lang", "confidence", "langs"],
            )

    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).cast("string").alias("text"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    return rows.mapInArrow(run, "id string, label string, words int, lang string, confidence double, langs array<string>")


def language_stretches(df: DataFrame, profiles: Profiles, ident: str, text: str) -> DataFrame:
    """(id, stretch, lang, confidence, words, content): adjoining sentences of one language in each text, numbered from 0."""
    p = df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        own = p.value
        names = np.array(own.languages, dtype=object)
        for b in (part for every in batches for part in tf.portions(every, 1)):
            cps, off = spoken(b.column(1))
            j = judged(own, cps, off)
            some = np.flatnonzero(j["words"] > 0)
            if len(some) == 0:
                continue
            row, lang = j["row"][some], j["lang"][some]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1]))))
            words = np.add.reduceat(j["words"][some], new)
            sure = np.add.reduceat(j["sure"][some] * j["words"][some], new) / words
            row, lang = row[new], lang[new]
            number = np.arange(len(row)) - np.searchsorted(row, row)
            begin = j["at"][some[new]]
            last = np.concatenate((new[1:], [len(some)])) - 1
            end = j["at"][some[last] + 1]
            size = end - begin
            at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            content = pc.utf8_trim_whitespace(tf.encode(cps[at], np.concatenate(([0], np.cumsum(size)))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(names[lang], pa.string()), pa.array(sure), pa.array(words.astype(np.int32)), content],
                ["id", "stretch", "lang", "confidence", "words", "content"],
            )

    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id string, stretch int, lang string, confidence double, words int, content string")


def mislabelled(df: DataFrame, profiles: Profiles, ident: str, text: str, label: str, min_words: int = 5) -> DataFrame:
    """Distinct (id, lang) of rows whose label is missing, no language, or another one than the text's, or whose text is mixed.

    One row for each language in which the text has a whole sentence.  Rows
    with fewer than min_words words or a null id are left out.
    """
    got = languages(df, profiles, ident, text, label).where((F.col("words") >= min_words) & F.col("id").isNotNull() & (F.size("langs") > 0))
    case = (F.size("langs") > 1) | F.col("label").isNull() | (primary(F.col("label")) != F.col("langs")[0])
    return got.where(case).select("id", F.explode("langs").alias("lang")).distinct()
