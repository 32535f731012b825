"""Words of whole Arrow batches as 64-bit hashes, without per-row string calls.

A word is a run of letters and digits; a combining mark behind one belongs to
it.  Letter case is ignored.  A word of letters that all look like ones of
another script, in either case, reads as both: it is taken as written in Latin,
so that it is the same word in every text, whatever stands around it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm import textform as tf

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case by code point, where it is one character."""
    out = np.arange(tf._SIZE, dtype=np.uint32)
    for cp in range(0x20000):
        if not 0xD800 <= cp < 0xE000 and 0x41 <= cp:
            low = chr(cp).lower()
            out[cp] = ord(low[0])
    return out


@lru_cache(maxsize=1)
def _either() -> tuple[np.ndarray, np.ndarray]:
    """By lower-case code point: whether it may stand in a word of either script, and the letter it is taken as then."""
    t = tf.tables()
    low = lower_table()
    latin = np.arange(tf._SIZE, dtype=np.uint32)
    both = (t.kind != tf.LETTER).copy()
    same: dict[str, str] = {}  # by lower case, of look-alikes of either case
    for cp in np.flatnonzero(t.cyrillic != np.arange(tf._SIZE)).tolist():
        same[chr(low[t.cyrillic[cp]])] = chr(low[cp])
    for letter, as_latin in same.items():
        latin[ord(letter)] = ord(as_latin)
        both[[ord(letter), ord(as_latin)]] = True
    for cp in range(0xC0, 0x530):  # the same letters with an accent
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        if marks and (base in same or base in same.values()):
            made = unicodedata.normalize("NFC", same.get(base, base) + "".join(marks))
            if len(made) == 1:
                latin[cp] = ord(made)
                both[cp] = True
    return both, latin


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(tf._SIZE, dtype=np.uint64) + _U(1)) * _BASE)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(1 << 16, _BASE | _U(1), np.uint64))


def word_runs(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's offsets into them."""
    n = len(cps)
    kind = tf.tables().kind[cps]
    inside = (kind == tf.LETTER) | (kind == tf.DIGIT)
    mark = kind == tf.MARK
    head = tf.row_starts(n, off)
    while mark.any():
        more = mark.copy()
        more[0] = False
        more[1:] &= inside[:-1] & ~head[1:]
        more &= ~inside
        if not more.any():
            break
        inside |= more
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | head[1:]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | head[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row in order, and each row's offsets into them."""
    starts, ends, rows = word_runs(cps, off)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), rows
    size = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    place = (at - np.repeat(starts, size)) & 0xFFFF
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    low = lower_table()[cps[at]]
    both, latin = _either()
    low = np.where(np.repeat(np.logical_and.reduceat(both[low], first), size), latin[low], low)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_letters()[low] * _powers()[place], first)
        return mix(h + size.astype(np.uint64) * _BASE), rows


def distinct_sorted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in rising order."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.concatenate(([0], np.cumsum(np.bincount(r[new], minlength=len(rows) - 1))))


def word_sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct words, as read (the consistent form)."""
    cps, off = tf.decode(tf.consistent_array(arr))
    return distinct_sorted(*word_hashes(cps, off))
