"""One consistent form for text that reads the same but is written with other characters.

The work is done on whole Arrow batches: the UTF-8 buffer becomes one array of
code points, table gathers with expansion offsets replace or delete characters,
look-alike letters are settled word by word, and combining marks are ordered
and composed with array operations.  No string method is called for a row.

The consistent form of a text
  * has compatibility forms a reader cannot tell apart resolved (full-width,
    ligatures, letters of mathematical alphabets, non-breaking blanks); forms
    that read differently (superscripts, fractions, circled signs) stay,
  * has no invisible characters (zero width, soft hyphen, direction marks),
    except a joiner between two pictographs, where it changes what is seen,
  * has every blank as U+0020, runs of blanks as one, none at the ends,
  * has each word in one script: a look-alike letter takes the script of the
    unmistakable letters of its word, else that of its text, else Latin,
  * is composed (accent and letter are one character where Unicode has it).

Letter case, accents and visible punctuation stay as they are.  null stays
null, an empty text stays empty, a text of invisible characters becomes empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters that look alike, as Unicode's confusable data pairs them
# (other script, Latin), single letters without accents.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "Օ": "O", "օ": "o", "ս": "u", "ո": "n", "հ": "h",
    "ɑ": "a", "ɡ": "g",
}
# Signs that look alike.
SIGNS = {"‐": "-", "‑": "-", "⁄": "/", "․": ".", "ʼ": "’"}

# The Cyrillic look-alikes that words of living languages are full of.
_COMMON_CYRILLIC = frozenset("АВЕКМНОРСТУХаеорсух")
_PLANES = ((0, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
_SEEN_DIFFERENT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
_ZWJ = 0x200D
_SIZE = 0x110000
LETTER, MARK, DIGIT = 1, 2, 3
LATIN, CYRILLIC, GREEK = 1, 2, 3


class Tables(NamedTuple):
    """Lookup tables by code point."""

    length: np.ndarray  # of the expansion; 0 deletes
    start: np.ndarray  # of the expansion in pool; -1: the character itself
    pool: np.ndarray
    ccc: np.ndarray  # canonical combining class
    pair: np.ndarray  # sorted keys (first << 21 | second) of composable pairs
    made: np.ndarray  # what they compose to
    second: np.ndarray  # may be the second of a pair
    kind: np.ndarray  # LETTER, MARK, DIGIT or 0
    script: np.ndarray  # of an unmistakable letter, else 0
    latin: np.ndarray  # look-alike -> Latin
    foreign: np.ndarray  # look-alike that is neither Latin nor a common Cyrillic letter
    cyrillic: np.ndarray  # Latin look-alike -> Cyrillic
    picture: np.ndarray  # pictographs
    plain: np.ndarray  # never changed, whatever stands beside it


def _ignorable(cp: int) -> bool:
    """Default-ignorable code points, apart from the joiner and variation selectors."""
    return (
        cp in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or 0x180B <= cp <= 0x180F
        or (0x200B <= cp <= 0x200F and cp != _ZWJ)
        or 0x202A <= cp <= 0x202E
        or 0x2060 <= cp <= 0x206F
        or 0xFFF9 <= cp <= 0xFFFB
        or 0xE0000 <= cp <= 0xE0FFF
    )


def _expand(ch: str) -> str:
    d = unicodedata.decomposition(ch)
    if not d:
        return SIGNS.get(ch, ch)
    parts = d.split(" ")
    if parts[0][0] == "<":
        if parts[0] in _SEEN_DIFFERENT or (parts[1] == "0020" and len(parts) > 2):
            return ch
        parts = parts[1:]
    return "".join(_expand(chr(int(x, 16))) for x in parts)


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Built once per process, from the Unicode data of Python's standard library."""
    length, start = np.ones(_SIZE, np.int8), np.full(_SIZE, -1, np.int32)
    ccc, kind, script = (np.zeros(_SIZE, np.uint8) for _ in range(3))
    picture, foreign, second = (np.zeros(_SIZE, bool) for _ in range(3))
    pool: list[int] = []
    at: dict[str, int] = {}
    pairs: dict[int, int] = {}
    kinds = {"L": LETTER, "M": MARK, "N": DIGIT}
    for lo, hi in _PLANES:
        for cp in range(lo, hi):
            if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
                kind[cp] = LETTER
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if _ignorable(cp):
                length[cp] = 0
                continue
            if cat in ("Cn", "Cs", "Co"):
                continue
            kind[cp] = kinds.get(cat[0], 0)
            ccc[cp] = unicodedata.combining(ch)
            if cat == "Zs" or ch in "\t\x0b\x0c\x85":
                to = " "
            elif ch == "\r" or cat in ("Zl", "Zp"):
                to = "\n"
            else:
                to = _expand(ch)
            if to != ch:
                if to not in at:
                    at[to] = len(pool)
                    pool.extend(map(ord, to))
                length[cp], start[cp] = len(to), at[to]
                d = unicodedata.decomposition(ch)
                if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
                    a, b = (int(x, 16) for x in d.split(" "))
                    pairs[a << 21 | b] = cp
            picture[cp] = (cat == "So" and cp >= 0x2190) or 0x1F3FB <= cp <= 0x1F3FF or cp in (0x2640, 0x2642)
    latin = np.arange(_SIZE, dtype=np.uint32)
    cyrillic = latin.copy()
    for lo, hi, which in ((0, 0x250, LATIN), (0x1E00, 0x1F00, LATIN), (0x370, 0x400, GREEK), (0x1F00, 0x2000, GREEK), (0x400, 0x530, CYRILLIC)):
        script[lo:hi][kind[lo:hi] == LETTER] = which
    for other, lat in LOOKALIKES.items():
        latin[ord(other)] = ord(lat)
        if script[ord(other)] == CYRILLIC and cyrillic[ord(lat)] == ord(lat):
            cyrillic[ord(lat)] = ord(other)
        foreign[ord(other)] = other not in _COMMON_CYRILLIC
        if other in _COMMON_CYRILLIC:
            script[ord(lat)] = 0
    script[[ord(x) for x in LOOKALIKES]] = 0
    plain = (length == 1) & (ccc == 0) & (start < 0) & (kind != MARK) & (script != CYRILLIC) & (script != GREEK) & (latin == np.arange(_SIZE))
    plain[sorted(pairs.values())] = True
    plain[[_ZWJ, 0xFE0E, 0xFE0F]] = plain[0x370:0x530] = plain[0x1100:0x1200] = plain[0x1F00:0x2000] = False
    keys = sorted(pairs)
    second[[k & 0x1FFFFF for k in keys]] = True
    second[0x1161:0x1176] = second[0x11A8:0x11C3] = True
    return Tables(length, start, np.array(pool, np.uint32), ccc, np.array(keys, np.int64), np.array([pairs[k] for k in keys], np.uint32), second, kind, script, latin, foreign, cyrillic, picture, plain)


#: Bytes of text that are worked on at once (whole rows: a longer text stands alone).
PORTION = 4_000_000


def portions(batch: pa.RecordBatch, column: int):
    """The batch in runs of rows whose texts in a column have at most PORTION bytes together."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + PORTION, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def decode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows of a string array, and the rows' offsets into them (null counts as empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    buf = arr.buffers()
    if n == 0 or buf[2] is None:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    off = np.frombuffer(buf[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = buf[2].slice(off[0], off[-1] - off[0]).to_pybytes()
    off = off - off[0]
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, off
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return cps, heads[off]


def encode(cps: np.ndarray, off: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """The string array of such code points; null: a mask of rows that are to be null."""
    raw = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    if len(raw) != len(cps):
        width = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), out=width[1:])
        off = width[off]
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(raw))
    if null is not None and null.true_count:
        out = pc.if_else(null, pa.scalar(None, pa.large_string()), out)
    return out.cast(pa.string())


def keep_only(cps: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marked characters, with the rows' offsets moved."""
    total = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return cps[keep], total[off]


def row_starts(n: int, off: np.ndarray) -> np.ndarray:
    """Which of n characters are the first of a row."""
    h = np.zeros(n + 1, bool)
    h[off] = True
    return h[:n]


def _expanded(cps: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    n = t.length[cps]
    begin = t.start[cps]
    changed = np.flatnonzero((n != 1) | (begin >= 0))
    if len(changed) == 0:
        return cps.copy(), off
    total = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    own = np.ones(len(cps), bool)
    own[changed] = False
    out = np.empty(total[-1], np.uint32)
    out[total[:-1][own]] = cps[own]
    m = n[changed].astype(np.int64)
    each = np.repeat(np.arange(len(m)), m)
    within = np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
    out[total[:-1][changed][each] + within] = t.pool[begin[changed][each] + within]
    return out, total[off]


def _without_joiners(cps: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Drops joiners that are not between pictographs, and variation selectors behind other characters."""
    z = np.flatnonzero(cps == _ZWJ)
    v = np.flatnonzero((cps == 0xFE0E) | (cps == 0xFE0F))
    if len(z) + len(v) == 0:
        return cps, off
    keep = np.ones(len(cps), bool)
    head = row_starts(len(cps), off)
    before = np.concatenate(([0], cps[:-1]))
    before[head] = 0
    keep[v] = t.picture[before[v]] | (before[v] < 0x3A) & (before[v] > 0x22)
    after = np.concatenate((cps[1:], [0]))
    after[:-1][head[1:]] = 0
    selector = (before == 0xFE0F) | (before == 0xFE0E)
    keep[z] = (t.picture[before[z]] | selector[z]) & t.picture[after[z]]
    return keep_only(cps, off, keep)


def _words(cps: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, marks, digits and underscores: the mask, where runs start, and the mask of starts."""
    inside = (t.kind[cps] > 0) | (cps == 0x5F)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | row_starts(len(cps), off)[1:]
    return inside, np.flatnonzero(begin), begin


def _one_script(cps: np.ndarray, off: np.ndarray, t: Tables) -> np.ndarray:
    """Settles look-alike letters word by word; cps are decomposed."""
    unsure = t.latin[cps] != cps
    sc = t.script[cps]
    if not unsure.any() and not (sc == CYRILLIC).any():
        return cps
    inside, starts, begin = _words(cps, off, t)
    if len(starts) == 0:
        return cps
    word = np.cumsum(begin) - 1  # of characters inside words; others are masked below
    word[~inside] = 0

    def count(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask & inside)
        return np.bincount(word[at], minlength=len(starts))

    greek = count(sc == GREEK)
    swap = t.foreign[cps] & inside & ((greek + count(sc == CYRILLIC))[word] == 0)
    if swap.any():
        cps = np.where(swap, t.latin[cps], cps)
        sc = t.script[cps]
    lat, cyr = count(sc == LATIN), count(sc == CYRILLIC)
    row = np.searchsorted(off, starts, side="right") - 1
    row_cyr = np.bincount(row, cyr, len(off)) > np.bincount(row, lat, len(off))
    to_cyr = np.where(lat + cyr > 0, cyr > lat, row_cyr[row])
    to_cyr &= greek == 0
    out = np.where(to_cyr[word], t.cyrillic[cps], np.where(greek[word] == 0, t.latin[cps], cps))
    return np.where(inside, out, cps)


def _ordered(cps: np.ndarray, off: np.ndarray, t: Tables) -> np.ndarray:
    """Canonical order of combining marks, by exchanges of neighbours."""
    head = row_starts(len(cps), off)
    while True:
        ccc = t.ccc[cps]
        bad = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~head[1:]
        at = np.flatnonzero(bad)
        if len(at) == 0:
            return cps
        at = at[np.concatenate(([True], np.diff(at) > 1))]  # exchanges must not overlap
        cps = cps.copy()
        cps[at], cps[at + 1] = cps[at + 1], cps[at].copy()


def _composed(cps: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    while True:
        at = np.flatnonzero(t.second[cps])
        if len(at) == 0:
            return cps, off
        n = len(cps)
        ccc = t.ccc[cps]
        head = row_starts(n, off)
        starter = np.maximum.accumulate(np.where((ccc == 0) | head, np.arange(n), 0))
        s = np.where(head[at], at, starter[np.maximum(at - 1, 0)])
        free = (s < at) & ((s == at - 1) | (ccc[at] > 0) & (ccc[at - 1] < ccc[at]))
        free &= (ccc[s] == 0) & ~head[at]
        at, s = at[free], s[free]
        key = cps[s].astype(np.int64) << 21 | cps[at]
        k = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        hit = t.pair[k] == key
        made = np.where(hit, t.made[k], 0).astype(np.uint32)
        a, b = cps[s].astype(np.int64), cps[at].astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)  # Hangul, by rule
        made = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, made)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b < 0x11C3)
        made = np.where(lvt, a + b - 0x11A7, made)
        hit |= lv | lvt
        if not hit.any():
            return cps, off
        at, s, made = at[hit], s[hit], made[hit]
        s, first = np.unique(s, return_index=True)
        cps = cps.copy()
        cps[s] = made[first]
        keep = np.ones(n, bool)
        keep[at[first]] = False
        cps, off = keep_only(cps, off, keep)


def _single_blanks(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks become one; none at the ends or beside a line break; line breaks at the ends go."""
    for blank in (cps == 0x20, (cps == 0x20) | (cps == 0x0A)):
        n = len(cps)
        if n == 0:
            return cps, off
        blank = blank if len(blank) == n else (cps == 0x20) | (cps == 0x0A)
        head = row_starts(n, off)
        space = cps == 0x20
        drop = np.zeros(n, bool)
        drop[1:] = space[1:] & blank[:-1] & ~head[1:]
        drop[:-1] |= space[:-1] & (cps[1:] == 0x0A) & ~head[1:]
        if drop.any():
            cps, off = keep_only(cps, off, ~drop)
    n = len(cps)
    solid = (cps != 0x20) & (cps != 0x0A)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    at = np.flatnonzero(solid)
    if len(at) == 0:
        return cps[:0], np.zeros_like(off)
    keep = np.zeros(n + 1, np.int64)
    some = total[off[1:]] > total[off[:-1]]
    np.add.at(keep, at[total[off[:-1]][some]], 1)
    np.add.at(keep, at[total[off[1:]][some] - 1] + 1, -1)
    return keep_only(cps, off, np.cumsum(keep)[:n] > 0)


def consistent_codes(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form, on code points and row offsets."""
    t = tables()
    if len(cps) and (cps.max() >= 0x80 or (cps < 0x20).any()):
        cps, off = _expanded(cps, off, t)
        cps, off = _without_joiners(cps, off, t)
        cps = _one_script(cps, off, t)
        cps = _ordered(cps, off, t)
        cps, off = _composed(cps, off, t)
    return _single_blanks(cps, off) if len(cps) else (cps, off)


def consistent_array(arr: pa.Array) -> pa.Array:
    """The consistent form of each row; null stays null.  Rows of plain characters are not touched."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    parts = list(portions(pa.RecordBatch.from_arrays([arr], ["t"]), 0))
    if len(parts) > 1:
        return pa.concat_arrays([consistent_array(b.column(0)) for b in parts])
    cps, off = decode(arr)
    n = len(cps)
    if n == 0:
        return arr.cast(pa.string())
    odd = ~tables().plain[cps]
    blank = (cps == 0x20) | (cps == 0x0A)
    head = row_starts(n, off)
    odd |= blank & head
    odd[1:] |= blank[1:] & blank[:-1] & ((cps[1:] == 0x20) | (cps[:-1] == 0x20))
    odd[:-1] |= blank[:-1] & head[1:]
    odd[-1] |= blank[-1]
    total = np.zeros(n + 1, np.int64)
    np.cumsum(odd, out=total[1:])
    rows = np.flatnonzero(total[off[1:]] > total[off[:-1]])
    if len(rows) == 0:
        return arr.cast(pa.string())
    some = arr.take(pa.array(rows))
    done = encode(*consistent_codes(*decode(some)), null=some.is_null())
    at = np.arange(len(arr))
    at[rows] = len(arr) + np.arange(len(rows))
    return pa.concat_arrays([arr.cast(pa.string()), done]).take(pa.array(at))
