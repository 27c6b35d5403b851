"""Blocks that a text repeats three times in a row, found in bounded time."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_CHARS = 500  # up to this length the backtracking expression costs little
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
_CHUNK = 1 << 17


def has_triple(text: str, least: int = 8) -> bool:
    """Whether a line holds a block of ``least`` or more characters three times in a row."""
    return any(_line_has_triple(line, least) for line in text.split("\n"))


def _line_has_triple(text: str, least: int) -> bool:
    """With a block of p characters, every character of the first two equals the one p further on. Such a run covers a
    multiple of p, so only multiples of each p are looked at: n/p of them, n log n in all. Those whose next ``least``
    characters agree p further on are extended to both sides by halving, over hashes of prefixes."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(s)
    if n < 3 * least:
        return False
    grams = np.zeros(n - least + 1, np.uint64)
    for k in range(least):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + s[k : n - least + 1 + k]
    anchors, periods = _anchors(grams, n, least)
    if not len(anchors):
        return False
    power = np.ones(1, np.uint64)
    while len(power) <= n:
        power = np.concatenate([power, power * (power[-1] * np.uint64(_BASE) % np.uint64(_PRIME)) % np.uint64(_PRIME)])
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * power[:n] % np.uint64(_PRIME)) % np.uint64(_PRIME)])

    def agree(start: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
        def part(at: np.ndarray) -> np.ndarray:
            return (prefix[at + length] + np.uint64(_PRIME) - prefix[at]) % np.uint64(_PRIME)

        return part(start) * power[p] % np.uint64(_PRIME) == part(start + p)

    def longest(most: np.ndarray, fits) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = fits(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    for at in range(0, len(anchors), _CHUNK):
        i, p = anchors[at : at + _CHUNK], periods[at : at + _CHUNK]
        ahead = longest(np.minimum(n - p - i, 2 * p), lambda m, i=i, p=p: agree(i, m, p))
        back = longest(np.minimum(i, 2 * p), lambda m, i=i, p=p: agree(i - m, m, p))
        for j in np.flatnonzero(ahead + back >= 2 * p):
            if _run_at(s, int(i[j]), int(p[j])):
                return True
    return False


def _run_at(s: np.ndarray, i: int, p: int) -> bool:
    """Exact: do 2p characters in a row around i equal those p further on?"""
    lo, hi = max(0, i - 2 * p), min(len(s) - p, i + 2 * p)
    differs = np.flatnonzero(s[lo:hi] != s[lo + p : hi + p])
    edges = np.concatenate([[-1], differs, [hi - lo]])
    return bool((np.diff(edges) - 1 >= 2 * p).any())


def _anchors(grams: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (multiple of p, p) whose grams agree. Short periods go one by one, long ones multiple by multiple."""
    top, root = n // 3, max(least, isqrt(n))
    found = []
    for p in range(least, min(root, top) + 1):
        i = np.arange(0, len(grams) - p, p)
        found.append((i[grams[i] == grams[i + p]], p))
    out = [(i, np.full(len(i), p)) for i, p in found if len(i)]
    k = 0
    while root < top and (k + 1) * (root + 1) < len(grams):
        p = np.arange(root + 1, min(top, (len(grams) - 1) // (k + 1)) + 1)
        p = p[grams[k * p] == grams[(k + 1) * p]]
        out.append((k * p, p))
        k += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def repeats_three_times(text: Column, pattern: str) -> Column:
    """Whether ``pattern``, a block and two references to it, is found. Long texts go to ``has_triple``, which agrees
    with the expression and doesn't backtrack; the function gets NULL for all other rows."""

    @F.pandas_udf("boolean")
    def triple(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else has_triple(t) for t in texts], dtype="object")

    long = F.length(text) > SHORT_CHARS
    return F.when(long, triple(F.when(long, text))).otherwise(text.rlike("(?d)" + pattern))
