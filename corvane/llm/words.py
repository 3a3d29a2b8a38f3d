"""Words of whole text batches as 64-bit hashes, computed on code-point arrays.

A word is an unbroken run of letters or digits, read in the consistent form of problem 1 and without regard
to case. Everything here is vectorised over a batch of texts; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .lookalike import _LIMIT, codes_of, lookalikes

BREAK = np.uint32(10)
_DROP = np.uint32(0xFFFFFFFF)

# Small Cyrillic letters whose capitals have a Latin shape, with the small Latin letter.
CASE_SHAPES = "вb нh мm тt кk"


class Tables(NamedTuple):
    fold: np.ndarray  #: code point to code point of the consistent form, or _DROP
    small: np.ndarray  #: code point to small letter, look-alike capitals brought together
    word: np.ndarray  #: whether a code point is a letter or digit


@lru_cache(1)
def tables() -> Tables:
    chars = list(map(chr, range(_LIMIT)))
    fold = np.arange(_LIMIT, dtype=np.uint32)
    for s, r in lookalikes().representative.items():
        if len(s) == 1 and ord(s) < _LIMIT and len(r) <= 1:
            fold[ord(s)] = ord(r) if r else _DROP
    small = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, _LIMIT)
    for a, b in CASE_SHAPES.split():
        small[small == ord(a)] = ord(b)
    word = np.fromiter((c.isalnum() for c in chars), bool, _LIMIT)
    return Tables(fold, small[np.minimum(fold, _LIMIT - 1)], word)


@lru_cache(1)
def _random() -> np.ndarray:
    return _mix(np.arange(_LIMIT, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that scatters neighbouring values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    hashes: np.ndarray  #: uint64 of each word
    text: np.ndarray  #: index of its text, ascending


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step % (1 << 64)
    return out


@lru_cache(1)
def _tables_of_powers(bits: int = 22) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 1 << bits), _powers(_INVERSE, 1 << bits)


def words_of(texts: Sequence[str], piece: int = 1 << 21) -> Words:
    """The words of all texts in order. Texts are taken together up to `piece` code points, longer ones alone."""
    hashes, owners, start, n = [], [], 0, 0
    for i, t in enumerate(texts):
        n += len(t) + 1
        if n >= piece or i == len(texts) - 1:
            w = _words(texts[start : i + 1])
            hashes.append(w.hashes)
            owners.append(w.text + start)
            start, n = i + 1, 0
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Words(np.concatenate(hashes), np.concatenate(owners))


def _composed(t: str) -> str:
    """Texts with accents of their own or ligatures are rewritten first; for the others the tables suffice."""
    return t if t.isascii() or not lookalikes().uneven.search(t) else lookalikes().rewrite(t)


def _words(texts: Sequence[str]) -> Words:
    tab = tables()
    texts = [_composed(t) for t in texts]
    codes = codes_of(t + "\n" for t in texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    clipped = np.minimum(codes, _LIMIT - 1)
    keep = tab.fold[clipped] != _DROP
    if not keep.all():
        clipped, owner = clipped[keep], owner[keep]
    small = tab.small[clipped]
    inside = tab.word[small]
    edge = np.diff(inside, prepend=False, append=False)
    at = np.flatnonzero(edge)
    begin, end = at[::2], at[1::2]
    if not len(begin):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n = len(small)
    up, down = _tables_of_powers()
    if n > len(up):
        up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_random()[small] * up[:n], out=sums[1:])
        value = (sums[end] - sums[begin]) * down[begin]
        return Words(_mix(value + (end - begin).astype(np.uint64)), owner[begin])


def word_hash(word: str) -> int:
    w = words_of([word])
    return int(w.hashes[0])


def runs_of(words: Words, k: int) -> Words:
    """Hashes of all runs of k consecutive words of one text."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if k == 1:
        return words
    with np.errstate(over="ignore"):
        value = np.zeros(n, np.uint64)
        for j in range(k):
            value = _mix(value * np.uint64(_BASE) + words.hashes[j : j + n])
    whole = words.text[:n] == words.text[k - 1 :]
    return Words(value[whole], words.text[:n][whole])


def distinct_runs(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct runs of text i, ascending, are hashes[bounds[i]:bounds[i + 1]]."""
    runs = runs_of(words_of(texts), k)
    cuts = np.searchsorted(runs.text, np.arange(len(texts) + 1))
    parts = [np.unique(runs.hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.concatenate(parts) if parts else runs.hashes, bounds
