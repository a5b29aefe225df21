"""Cutting texts into runs of word windows that share their least word n-gram.

Equal windows hold the same n-grams, so they choose the same least one. Whatever must bring equal
windows together can therefore deal whole runs by that n-gram instead of single windows by their hash.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def split(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes are divided at ASCII blanks only."""
    return (text or "").encode().split()


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` (a power of two): a polynomial in the hashes, by doubling."""
    span, base = 1, _BASE
    while span < n:
        h = h[:-span] * np.uint64(base) + h[span:]
        base, span = base * base % 2**64, 2 * span
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def _least(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``n`` neighbours, and whether it stands there twice; joined from spans that are powers of two."""
    spans, size, joined, done = (x, np.zeros(len(x), bool)), 1, None, 0

    def join(a: tuple, b: tuple, shift: int) -> tuple:
        (u, s), (v, t) = a, b
        k = max(0, len(v) - shift)
        u, s, v, t = u[:k], s[:k], v[shift:], t[shift:]
        return np.minimum(u, v), (u == v) | (s & (u <= v)) | (t & (v <= u))

    while True:
        if n & size:
            joined, done = (spans, size) if joined is None else (join(joined, spans, done), done + size)
        if done == n:
            return joined
        spans, size = join(spans, spans, size), 2 * size


def runs(docs: list[list[bytes]], window: int, gram: int = 8) -> list[tuple[np.ndarray, ...]]:
    """Per document (least n-gram hash, first window, number of windows, whether the n-gram stands in it twice) of its runs, in order.

    Windows are numbered by their first word; consecutive windows with the same least n-gram make up
    one run. Documents with fewer words than a window have none.
    """
    empty = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool))
    sizes = np.array([len(w) for w in docs])
    flat = np.fromiter((xxhash.xxh64_intdigest(w) for d in docs for w in d), np.uint64, int(sizes.sum()))
    if len(flat) < window:
        return [empty] * len(docs)
    gram = 1 << (min(gram, window).bit_length() - 1)
    wide = window - gram + 1
    least, tied = _least(_sums(flat, gram), wide)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    has = sizes >= window
    # A window is whole where it starts at least ``window`` words before the end of its document.
    doc = np.repeat(np.arange(len(docs)), sizes)[: len(least)]
    whole = np.arange(len(least)) + window <= ends[doc]
    at = np.nonzero(whole)[0]
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(at))).astype(np.int32)
    twice = np.logical_or.reduceat(tied[at], first) | (count > wide) if len(first) else np.empty(0, bool)
    begin = at[first]
    owner = doc[begin]
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    key, place = least[begin].view(np.int64), (begin - starts[owner]).astype(np.int32)
    return [
        (key[a:b], place[a:b], count[a:b], twice[a:b]) if h else empty for h, a, b in zip(has, bounds[:-1], bounds[1:])
    ]
