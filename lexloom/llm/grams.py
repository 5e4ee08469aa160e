"""Character n-grams of many texts at once: case-folded code points, one blank for every run of non-letters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower-case letter for each letter of the two-byte range, the code point for letters beyond it, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def squeezed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, owner of each, its position, all code points as they are) of texts joined with a
    blank before each. Each run of non-letters is one blank (0), and one begins every text."""
    joined = "".join(f" {t or ''}" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = _fold()[raw]
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    keep = codes != 0
    keep[1:] |= keep[:-1].copy()
    keep[starts] = True
    at = np.flatnonzero(keep)
    return codes[at], np.repeat(np.arange(len(texts), dtype=np.int32), np.add.reduceat(keep, starts, dtype=np.int64) if len(at) else 0), at, raw


def gram_hashes(codes: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...]):
    """For each size: 64-bit hashes of the n-grams that lie in one text, and the index of their first code point."""
    h, done = np.zeros(len(codes), np.uint64), 0
    for n in sizes:
        if len(codes) < n:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        m = len(codes) - n + 1
        h = h[:m]
        for k in range(done, n):
            h = (h ^ codes[k : k + m]) * _MIX
            h ^= h >> np.uint64(29)
        done = n
        inside = owner[:m] == owner[n - 1 :]
        yield (h[inside] ^ np.uint64(n)), np.flatnonzero(inside)
