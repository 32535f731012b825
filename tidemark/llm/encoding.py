"""Problem 9: text that was decoded with a wrong character encoding.

Method: adjacent character pairs are scored by corpus mutual information: a
pair's pointwise mutual information, discounted where the pair is rare (so that
characters that only ever stand in garbled places do not vouch for each other).
The maximum-scoring segments of the improbable pairs are isolated, and inverse
mappings (encode as the encoding the text was read as, decode as the one it was
written in) are tested inside these.  Garbling that is frequent in the corpus
makes its own pairs probable; so runs with a whole or cut UTF-8 sequence, a
replacement character or a control character of the upper half are tested for
UTF-8 whatever their pairs score.  A mapping is taken if it makes the
segment, between the characters around it, so much more probable that chance is
out of question; it is repeated for text that was garbled more than once.

Segments that can't be restored (replacement characters, control characters of
the upper half, cut UTF-8 sequences) are found too, and left as they are.

Pair counts cover all texts, and every count that is used is exact.  The PAIRS
most frequent pairs are sent to the tasks.  Where there are more, the table of
all pairs stays in the shared folder, and REST buckets by a hash of the pair are
sent too: a pair in an empty bucket occurs nowhere, and the others are asked for.
A text that needs pairs that were not sent waits, they are joined with the table
of all pairs, and the text is taken up again with their counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textform as tf
from tidemark.storage import discard, materialize

#: Pairs sent to the tasks with their counts (16 bytes each), and buckets of the counts of all others (8 bytes each).
PAIRS, REST = 1 << 18, 1 << 20
#: Adjoining characters beyond ASCII, of one script other than Latin's plain accents can be, from which a run is tested for one-byte mappings too.
RUN = 4
#: A pair is discounted by n / (n + FEWEST + DISCOUNT x all pairs), and improbable below LEVEL bits.
DISCOUNT, FEWEST, LEVEL = 2e-5, 20, 0.5
#: What a pair of two ASCII characters costs a segment, in bits.
ASCII_COST = 1.5
#: On the scale of log2 of a pair's occurrences in a million pairs, every pair of a restored segment must reach FLOOR.  The
#: mean must rise by SOME where bytes form UTF-8 (chance alone hardly ever does; three sequences or a long one of known
#: characters need no FLOOR), by MORE for one-byte mappings, which are only tried on segments with a mean below COMMON,
#: only taken where the new letters stand in words, and must reach FEW where they change but a few characters, more so if
#: these are usual ones (more than USUAL in a million); where they change more than MANY, the mean may reach TYPICAL instead
#: (so that one rare pair doesn't keep a sentence from being restored).
FLOOR, SOME, MORE, COMMON, FEW, USUAL, MANY, TYPICAL = -4.0, 0.3, 3.0, 2.0, 1.0, 50, 8, 6.0
#: Encodings text is wrongly read as, and those it is written in, by their names in Python.
READ_AS = ("cp1252", "cp1251", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "mac_cyrillic", "mac_latin2", "iso8859-5")
WRITTEN_IN = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1250", "iso8859-2", "cp852", "cp1252", "mac_roman", "cp850", "cp437")


@lru_cache(maxsize=64)
def _to_bytes(name: str) -> dict[str, int]:
    """Characters -> high bytes of an encoding; undefined bytes stand for the control characters of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    if name.startswith("cp125") or name.startswith("iso"):
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=64)
def _from_bytes(name: str) -> dict[int, str]:
    return {b: ch for ch, b in reversed(_to_bytes(name).items())}


def bucket_of(key: np.ndarray) -> np.ndarray:
    """The bucket of REST that counts a pair which is not kept."""
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - REST.bit_length() + 1)).astype(np.int64)


@dataclass
class PairModel:
    """Pair counts of a corpus: keys a << 21 | b in rising order.

    rest: buckets of the pairs that are not among the keys; every: the table of
    all pairs.  Both are None where the keys are all pairs.  told: pairs and
    counts from that table; asked: pairs whose count was needed and not known.
    """

    keys: np.ndarray
    counts: np.ndarray
    total: int
    rest: np.ndarray | None = None
    singles: dict[int, int] = field(default_factory=dict)
    cache: dict[tuple[str, str, str, bool], tuple[bool, str]] = field(default_factory=dict)
    every: DataFrame | None = None
    told: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    asked: set[int] = field(default_factory=set)

    def __post_init__(self):
        if self.singles:
            return
        left, right = self.keys >> 21, self.keys & 0x1FFFFF
        for side in (left, right):
            u, inv = np.unique(side, return_inverse=True)
            n = np.bincount(inv, self.counts)
            for cp, k in zip(u.tolist(), n.tolist(), strict=True):
                self.singles[cp] = max(self.singles.get(cp, 0), int(k))

    def tell(self, keys: pa.ListArray, counts: pa.ListArray) -> None:
        """Takes these counts instead of those told before."""
        k, first = np.unique(np.asarray(keys.flatten(), np.int64), return_index=True)
        self.told = k, np.asarray(counts.flatten(), np.int64)[first]

    def known_counts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs' counts, and which of them are not known; the bucket's count, which is no less, stands for these."""
        n, unknown = np.zeros(len(key), np.int64), np.ones(len(key), bool)
        for keys, counts in ((self.keys, self.counts), self.told):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                n[hit] = counts[at[hit]]
                unknown &= ~hit
        if self.rest is None:
            return n, np.zeros(len(key), bool)
        bound = self.rest[bucket_of(key)]
        return np.where(unknown, bound, n), unknown & (bound > 0)

    def count(self, key: np.ndarray) -> np.ndarray:
        """The pairs' counts; those that are not known are asked for."""
        if self.rest is None and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.counts[at], 0)
        n, unknown = self.known_counts(key)
        self.asked.update(key[unknown].tolist())
        return n

    @property
    def known(self) -> np.ndarray:
        """Whether the corpus has a character, by its number."""
        out = np.zeros(1 << 21, bool)
        out[list(self.singles)] = True
        return out

    @cached_property
    def single(self) -> np.ndarray:
        """The characters' counts, by their numbers."""
        out = np.zeros(1 << 21)
        out[list(self.singles)] = list(self.singles.values())
        return out

    def improbability(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """LEVEL minus the discounted mutual information of pairs with such counts, in bits; LEVEL for those that don't occur."""
        n = count.astype(np.float64)
        mi = np.log2(np.maximum(n, 1) * max(self.total, 1) / (np.maximum(self.single[key >> 21], 1) * np.maximum(self.single[key & 0x1FFFFF], 1)))
        return LEVEL - np.maximum(mi, 0) * n / (n + FEWEST + DISCOUNT * self.total)

    @property
    def improbable(self) -> np.ndarray:
        """The improbability of each of the keys."""
        return self.improbability(self.keys, self.counts)

    def mean(self, text: str, own: bool = False) -> tuple[float, float]:
        """Mean and least log2 of pairs per million of a text's pairs with a character beyond ASCII.

        The least of a text with a pair that was never seen is infinitely low.
        own: the text's pairs are in the counts, and don't count for it.
        """
        c = np.array([ord(x) for x in text], np.int64)
        key = c[:-1] << 21 | c[1:]
        key = key[(c[:-1] > 127) | (c[1:] > 127)]
        if len(key) == 0:  # nothing beside it: is the character itself known?
            return 0.0, 0.0 if all(x < 128 or x in self.singles for x in c.tolist()) else -math.inf
        n = self.count(key)
        if own:
            _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
            n = np.maximum(n - times[inv], 0)
        lp = np.log2((n + 0.05) * 1e6 / max(self.total, 1))
        return float(lp.mean()), float(lp.min()) if n.all() else -math.inf


def pair_counts(df: DataFrame, text: str) -> PairModel:
    """Counts over all texts; each task sends the pairs it met with their numbers."""

    def count(batches):
        ascii_pairs = np.zeros(1 << 14, np.int64)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in (part for whole in batches for part in tf.portions(whole, 0)):
            cps, off = tf.decode(b.column(0))
            if len(cps) < 2:
                continue
            same = ~tf.row_starts(len(cps), off)[1:]
            low = cps < 128
            plain = same & low[1:] & low[:-1]
            c = cps.astype(np.int64)
            ascii_pairs += np.bincount((c[:-1] << 7 | c[1:])[plain], minlength=1 << 14)
            odd = np.flatnonzero(same & ~plain)
            u, n = np.unique(c[odd] << 21 | c[odd + 1], return_counts=True)
            keys, inv = np.unique(np.concatenate((keys, u)), return_inverse=True)
            counts = np.bincount(inv, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        some = np.flatnonzero(ascii_pairs)
        keys = np.concatenate((keys, some >> 7 << 21 | some & 127))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate((counts, ascii_pairs[some])))], ["k", "n"])

    all_pairs = df.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    every = materialize(all_pairs, "pairs")
    kept = every.orderBy(F.desc("n"), "k").limit(PAIRS).toArrow()
    k, n = np.asarray(kept["k"]), np.asarray(kept["n"])
    order = np.argsort(k)
    k, n = k[order], n[order]
    if len(k) < PAIRS:
        discard(every)
        return PairModel(k, n, int(n.sum()))

    def buckets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(np.asarray(b.column(0)))), b.column(1)], ["b", "n"])

    got = every.mapInArrow(buckets, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most REST rows
    rest = np.zeros(REST, np.int64)
    rest[np.asarray(got["b"])] = np.asarray(got["n"])
    total = int(rest.sum())
    np.subtract.at(rest, bucket_of(k), n)
    sides = [every.groupBy(c.alias("c")).agg(F.sum("n").alias("n")) for c in (F.shiftright("k", 21), F.col("k").bitwiseAND(0x1FFFFF))]
    chars = sides[0].unionByName(sides[1]).groupBy("c").agg(F.max("n").alias("n")).toArrow()  # at most one row a character of Unicode
    return PairModel(k, n, total, rest, dict(zip(chars["c"].to_pylist(), chars["n"].to_pylist(), strict=True)), every=every)


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments (start, end) of a sequence of scores (Ruzzo and Tompa), with positive sum."""
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to its end
    total = 0.0
    for i, s in enumerate(score.tolist()):
        if s <= 0:
            total += s
            continue
        start, before = i, total
        total += s
        upto = total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= upto:
                break
            start, before = out[j][0], out[j][2]
            del out[j:]
        out.append((start, i + 1, before, upto))
    return [(a, b) for a, b, _, _ in out]


def _utf8_inside(text: str, name: str) -> tuple[str, list[str], list[str]] | None:
    """text with every whole UTF-8 sequence of its bytes in this encoding replaced by its character, these characters and the sequences; None if there is none."""
    table = _to_bytes(name)
    raw = [table.get(ch, -1) if ord(ch) > 127 else -1 for ch in text]
    out, i, n, found, sources = [], 0, len(text), [], []
    while i < n:
        b = raw[i]
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if size and i + size <= n and all(0x80 <= x <= 0xBF for x in raw[i + 1 : i + size]):
            try:
                found.append(bytes(raw[i : i + size]).decode("utf-8"))
                out.append(found[-1])
                sources.append(text[i : i + size])
                i += size
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return ("".join(out), found, sources) if found else None


def _byte_by_byte(text: str, read: str, written: str) -> str | None:
    a, b = _to_bytes(read), _from_bytes(written)
    out = []
    for ch in text:
        if ord(ch) > 127:
            x = a.get(ch)
            if x is None or x not in b:
                return None
            ch = b[x]
        out.append(ch)
    return "".join(out)


def _foreign_run(text: str) -> int:
    """How many letters must change in a text with adjoining letters as in no word of a living language, 0 for other texts: RUN where there are so many of Latin-1, 3 where a small Cyrillic letter stands before a capital."""
    run = 0
    for i, ch in enumerate(text):
        run = run + 1 if "\xc0" <= ch <= "\xff" else 0
        if i and ch.isupper() and text[i - 1].islower() and ord(ch) > 0x3FF:
            return 3
        if run == RUN:
            return RUN
    return 0


def _in_words(before: str, old: str, new: str, after: str) -> bool:
    """Whether the changed characters are letters beside letters of their own script: all of up to three, most of more (words may be a letter long)."""
    wide = (before or " ") + new + (after or " ")
    changed = astray = 0
    for i, (x, y) in enumerate(zip(old, new, strict=True), 1):
        if x != y:
            changed += 1
            astray += not (y.isalpha() and any(z.isalpha() and (ord(z) >= 0x370) == (ord(y) >= 0x370) for z in (wide[i - 1], wide[i + 1])))
    return astray <= (0 if changed <= 3 else 0.2 * changed)


def _lone_sign(text: str) -> str | None:
    """The sign of Latin-1 that two characters are, the first being the lead byte that all these signs have, in an encoding that has no letter for it or an accented capital."""
    for name in ("cp1252", "cp437", "mac_roman"):
        raw = [_to_bytes(name).get(ch, 0) for ch in text]
        if raw[0] == 0xC2 and 0xA1 <= raw[1] <= 0xBF:
            return chr(raw[1])
    return None


def _cut_sequence(text: str) -> bool:
    """A three- or four-byte sequence in cp1252 that breaks off behind its second byte."""
    table = _to_bytes("cp1252")
    raw = [table.get(ch, -1) if ord(ch) > 127 else -1 for ch in text] + [-1, -1, -1]
    for i, b in enumerate(raw[:-3]):
        if b in (0xE2, 0xEF) and 0x80 <= raw[i + 1] <= 0xBF and text[i + 1] not in "»«“”‘’…–—" or b == 0xF0 and raw[i + 1] in (0x9F, 0x90):
            return True
    return False


def restored(model: PairModel, before: str, text: str, after: str, usual: bool = False) -> tuple[bool, str]:
    """(garbled, text as it was or as it is) of a segment between two characters.

    usual: the segment's pairs are probable ones in the corpus, so it may be a
    proper word; then only UTF-8 is tested, and a long sequence of known
    characters is enough only where a letter is followed by a sign.
    Where the model has asked for pairs, nothing is decided before they are told.
    """
    key = (before, text, after, usual)
    if key in model.cache:
        return model.cache[key]
    now, garbled = text, False
    while True:  # each round makes the text shorter or more probable
        score, _ = model.mean(before + now + after, own=now == text)
        best, best_score = None, score + SOME
        for name in READ_AS:
            got: str | None = now
            while inside := _utf8_inside(got, name):  # each one makes it shorter
                old, (got, made, sources) = got, inside
                s, least = model.mean(before + got + after)
                known = all(ord(ch) in model.singles for ch in made)
                # chance makes no three sequences in a row, nor two that leave nothing over
                in_a_row = any("".join(sources[i : i + 3]) in old for i in range(len(sources) - 2))
                if known and (in_a_row or len(made) > 1 and sum(map(len, sources)) == sum(ord(ch) > 127 for ch in old)):
                    s = max(s, best_score)
                if known and any(ord(ch) >= 0x800 and not (usual and (not x[0].isalpha() or x[1].isalpha())) for ch, x in zip(made, sources, strict=True)):
                    s = max(s, best_score)
                elif least < FLOOR and not (known and len(made) >= 3):
                    continue
                if s >= best_score:
                    best, best_score = got, s
        if best is None and len(now) == 2 and not before.isalnum() and (sign := _lone_sign(now)) and (not before.strip() or sign not in "«»"):
            best = sign
        plain = score < COMMON and not usual
        foreign = 0 if plain else _foreign_run(now)
        if best is None and (plain or foreign):
            best_score = score + (MORE if plain else 1.0)
            for read in READ_AS:
                for written in WRITTEN_IN:
                    got = _byte_by_byte(now, read, written) if read != written else None
                    if got is not None and got != now and _in_words(before, now, got, after):
                        s, least = model.mean(before + got + after)
                        new = [x for x, y in zip(now, got, strict=True) if x != y]
                        if not plain and not (len(new) >= foreign and least >= FLOOR and s >= TYPICAL - 1):
                            continue
                        if plain and len(new) <= 3:
                            common = all(model.singles.get(ord(x), 0) * 1e6 > USUAL * model.total for x in new)
                            if least < FEW or common and (not before or not after or s < score + MORE + 2):
                                continue
                        if s >= best_score and (least >= FLOOR or len(new) > MANY and s >= TYPICAL):
                            best, best_score = got, s
        if best is None or model.asked:
            break
        now, garbled = best, True
    if model.asked:
        return False, text
    if not garbled:
        garbled = any(ch == "�" or "\x80" <= ch <= "\x9f" for ch in now) or _cut_sequence(now)
    if len(model.cache) > 200_000:
        model.cache.clear()
    model.cache[key] = garbled, now
    return garbled, now


@lru_cache(maxsize=64)
def _byte_table(name: str) -> np.ndarray:
    """The high byte of each character up to U+FFFF in an encoding, 0 where it has none."""
    out = np.zeros(1 << 16, np.uint8)
    for ch, b in _to_bytes(name).items():
        out[ord(ch)] = b
    return out


def broken_runs(model: PairModel, cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the runs of characters beyond ASCII with a mark of garbling, however frequent their pairs are.

    Marks are letters that stand together as in no word (RUN of Latin-1's, or a
    small Cyrillic one before a capital), replacement characters, control characters of the upper half, cut
    sequences, and whole UTF-8 sequences in an encoding of READ_AS whose
    character the corpus knows or that encoding has (for text garbled twice);
    others are never accepted.
    """
    at = np.flatnonzero(cps > 127)
    if len(at) == 0:
        return []
    c = cps[at].astype(np.int64)
    row = np.searchsorted(off, at, side="right") - 1
    m = len(at)
    joined = np.zeros(m + 3, bool)  # whether the next one follows in the same row
    joined[: m - 1] = (np.diff(at) == 1) & (row[1:] == row[:-1])
    mark = (c == 0xFFFD) | (c < 0xA0)
    known = model.known
    for name in READ_AS:
        b = np.zeros(m + 3, np.int64)
        b[:m] = np.where(c < 1 << 16, _byte_table(name)[np.minimum(c, 0xFFFF)], 0)
        tail = (b >= 0x80) & (b < 0xC0)
        lead = np.flatnonzero((b[:m] >= 0xC2) & (b[:m] <= 0xF4) & joined[:m] & tail[1 : m + 1])
        x, y = b[lead], b[lead + 1]
        third = joined[lead + 1] & tail[lead + 2]
        fourth = third & joined[lead + 2] & tail[lead + 3]
        z, w = b[lead + 2] & 63, b[lead + 3] & 63
        cp = np.where(x < 0xE0, (x & 31) << 6 | y & 63, np.where(x < 0xF0, (x & 15) << 12 | (y & 63) << 6 | z, (x & 7) << 18 | (y & 63) << 12 | z << 6 | w))
        whole = (x < 0xE0) | (x < 0xF0) & third & (cp >= 0x800) | (x >= 0xF0) & fourth & (cp >= 0x10000) & (cp < 0x110000)
        cp = np.where(whole, cp, 0)
        mark[lead[whole & (known[cp] | ((cp < 1 << 16) & (_byte_table(name)[np.minimum(cp, 0xFFFF)] > 0)))]] = True
        if name == "cp1252":
            mark[lead[(x == 0xE2) | (x == 0xEF) | (x == 0xF0)]] = True  # maybe cut
    first = np.flatnonzero(np.concatenate(([True], ~joined[: m - 1])))
    # runs that a one-byte mapping may have made, however frequent: RUN letters of Latin-1, or a small letter before a capital
    latin1, n = (c >= 0xC0) & (c <= 0xFF), max(m - RUN + 1, 0)
    run = latin1[:n].copy()
    for i in range(1, RUN):
        run &= latin1[i : n + i] & joined[i - 1 : n + i - 1]
    mark[:n] |= run
    small, capital = (c >= 0x430) & (c <= 0x45F), (c >= 0x400) & (c <= 0x42F)
    mark[:-1] |= small[:-1] & capital[1:] & joined[: m - 1]
    last = np.concatenate((first[1:], [m])) - 1
    hit = np.flatnonzero(np.logical_or.reduceat(mark, first))
    return list(zip(row[first[hit]].tolist(), at[first[hit]].tolist(), (at[last[hit]] + 1).tolist(), strict=True))


def _odd_pairs(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the second characters of pairs with a character beyond ASCII are, their rows, and the pairs."""
    c = cps.astype(np.int64)
    # a row is also a pair with a line break before and behind it
    prev = np.concatenate(([10], c[:-1]))
    prev[tf.row_starts(len(c), off)] = 10
    odd = np.flatnonzero((c > 127) | (prev > 127))
    return odd, np.searchsorted(off, odd, side="right") - 1, prev[odd] << 21 | c[odd]


def unknown_pairs(model: PairModel, cps: np.ndarray, off: np.ndarray) -> dict[int, set[int]]:
    """The pairs of each row whose counts must be told before it can be examined."""
    out: dict[int, set[int]] = defaultdict(set)
    if len(cps) and model.rest is not None:
        _, row, key = _odd_pairs(cps, off)
        unknown = model.known_counts(key)[1]
        for r, k in zip(row[unknown].tolist(), key[unknown].tolist(), strict=True):
            out[r].add(k)
    return out


def suspicious(model: PairModel, scores: np.ndarray, cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the maximum-scoring segments of improbable pairs, as characters."""
    if len(cps) == 0:
        return []
    high = cps > 127
    odd, row, key = _odd_pairs(cps, off)
    if len(odd) == 0:
        return []
    at = np.minimum(np.searchsorted(model.keys, key), max(len(model.keys) - 1, 0))
    s = np.where(model.keys[at] == key, scores[at], LEVEL) if len(model.keys) else np.full(len(odd), LEVEL)
    if model.rest is not None:
        other = np.flatnonzero(model.keys[at] != key)
        s[other] = model.improbability(key[other], model.known_counts(key[other])[0])
    hot = np.unique(row[s > 0])
    out = []
    lo, hi = np.searchsorted(row, hot), np.searchsorted(row, hot, side="right")
    for r, a, b in zip(hot.tolist(), lo.tolist(), hi.tolist(), strict=True):
        where, score = odd[a:b], s[a:b]
        gap = np.diff(where) - 1
        seq = np.empty(2 * len(where) - 1)
        seq[0::2] = score
        seq[1::2] = -ASCII_COST * gap
        for i, j in segments(seq):
            start, end = int(where[(i + 1) // 2]), int(where[(j - 1) // 2]) + 1
            if not high[start]:
                start = start - 1
            while start > off[r] and high[start - 1]:  # whole runs of characters beyond ASCII
                start -= 1
            while end < off[r + 1] and high[end - 1] and high[end]:
                end += 1
            if not high[end - 1]:
                end -= 1
            start, end = max(start, int(off[r])), end
            if out and out[-1][0] == r and start < out[-1][2]:
                out[-1] = (r, out[-1][1], max(end, out[-1][2]))
            elif end > start:
                out.append((r, start, end))
    return out


def passages(model: PairModel, scores: np.ndarray, cps: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(row, start, end, usual) in order: segments of improbable pairs, and marked runs outside them, whose pairs are usual ones."""
    out = [(*s, False) for s in suspicious(model, scores, cps, off)]
    taken = np.array([(s, e) for _, s, e, _ in out], np.int64).reshape(-1, 2)
    for r, start, end in broken_runs(model, cps, off):
        i = int(np.searchsorted(taken[:, 0], end))  # segments that start before its end
        if i == 0 or taken[i - 1, 1] <= start:
            out.append((r, start, end, True))
    return sorted(out)


def examined(model: PairModel, scores: np.ndarray, cps: np.ndarray, off: np.ndarray) -> tuple[dict[int, tuple[str, int]], dict[int, set[int]]]:
    """(text as restored, number of passages) of each row with garbled ones, and the pairs of each row that can't be decided before their counts are told."""
    found: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    asks: dict[int, set[int]] = defaultdict(set)
    for r, start, end, usual in passages(model, scores, cps, off):
        piece = "".join(map(chr, cps[start:end].tolist()))
        before = chr(cps[start - 1]) if start > off[r] else ""
        after = chr(cps[end]) if end < off[r + 1] else ""
        model.asked.clear()
        bad, now = restored(model, before, piece, after, usual)
        if model.asked:
            asks[r] |= model.asked
        elif bad:
            found[r].append((start, end, now))
    out = {}
    for r in (r for r in found if r not in asks):
        text, at = [], int(off[r])
        for start, end, now in found[r]:
            text += ["".join(map(chr, cps[at:start].tolist())), now]
            at = end
        text.append("".join(map(chr, cps[at : off[r + 1]].tolist())))
        out[r] = "".join(text), len(found[r])
    return out, asks


def garbled_documents(df: DataFrame, ident: str, text: str, model: PairModel | None = None) -> DataFrame:
    """(id, restored, passages) of the rows in which a passage shows wrongly decoded characters.

    restored is the text with every passage that can be restored put right;
    passages counts the garbled ones.  Null and empty texts are never affected;
    repeated rows give repeated rows; an empty table gives none.
    """
    given, model = model, model or pair_counts(df, text)
    shared = df.sparkSession.sparkContext.broadcast(replace(model, every=None))
    rows = df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    if model.every is not None:
        found = _found_in_rounds(rows, kind, shared, model.every)
        if given is None:
            discard(model.every)
        return found

    def run(batches):
        own = shared.value
        scores = own.improbable
        for b in (part for whole in batches for part in tf.portions(whole, 1)):
            found, _ = examined(own, scores, *tf.decode(b.column(1)))
            if found:
                texts, numbers = zip(*found.values(), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(list(found))), pa.array(texts), pa.array(numbers, pa.int32())], ["id", "restored", "passages"])

    return rows.mapInArrow(run, f"id {kind}, restored string, passages int")


def _found_in_rounds(rows: DataFrame, kind: str, shared: Broadcast[PairModel], every: DataFrame) -> DataFrame:
    """:func:`garbled_documents` where not all pairs were sent: texts that need others wait for the next round, which has their counts."""

    def run(batches):
        own = shared.value
        scores = own.improbable
        number = TaskContext.get().partitionId() << 33  # of the rows that wait, in the first round
        for b in (part for whole in batches for part in tf.portions(whole, 2)):
            own.tell(b.column(3), b.column(4))
            waiting = unknown_pairs(own, *tf.decode(b.column(2)))
            ready = np.setdiff1d(np.arange(b.num_rows), list(waiting))
            found, asks = examined(own, scores, *tf.decode(b.column(2).take(pa.array(ready))))
            waiting |= {int(ready[r]): keys for r, keys in asks.items()}
            if found:
                texts, numbers = zip(*found.values(), strict=True)
                yield step(b.take(pa.array(ready[list(found)])), pa.array(texts), pa.array(numbers, pa.int32()), None)
            if waiting:
                part = b.take(pa.array(list(waiting)))
                if part.column(0).null_count:
                    part = part.set_column(0, "r", pa.array(np.arange(number, number + len(waiting))))
                    number += len(waiting)
                yield step(part, part.column(2), None, pa.array([sorted(keys) for keys in waiting.values()], pa.list_(pa.int64())))

    def step(part, texts, numbers, asks):
        empty = pa.nulls(part.num_rows, pa.list_(pa.int64()))
        told = (empty, empty) if asks is None else (part.column(3), part.column(4))
        columns = [part.column(0), part.column(1), texts, *told, pa.nulls(part.num_rows, pa.int32()) if numbers is None else numbers, empty if asks is None else asks]
        return pa.RecordBatch.from_arrays(columns, ["r", "id", "t", "k", "n", "passages", "asks"])

    none = F.array().cast("array<bigint>")
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows that wait are much work: these aren't to be one task
    todo, found, last = rows.select(F.lit(None).cast("bigint").alias("r"), "id", "t", none.alias("k"), none.alias("n")), [], None
    while True:
        now = materialize(todo.mapInArrow(run, f"r bigint, id {kind}, t string, k array<bigint>, n array<bigint>, passages int, asks array<bigint>"), "round")
        if last is not None:
            discard(last)
        found.append(materialize(now.where("asks IS NULL").select("id", F.col("t").alias("restored"), "passages"), "found"))
        left, last = now.where("asks IS NOT NULL"), now
        if left.isEmpty():
            discard(now)
            return reduce(DataFrame.unionByName, found)
        answers = left.select("r", F.explode("asks").alias("k")).join(every.withColumnRenamed("n", "m"), "k", "left")
        answers = answers.groupBy("r").agg(F.collect_list(F.struct("k", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"))).alias("a"))
        todo = left.repartition(parts, "r").join(answers, "r").select("r", "id", "t", F.concat("k", F.col("a.k")).alias("k"), F.concat("n", F.col("a.m")).alias("n"))
