"""Vectorised word and window hashes over batches of UTF-8 texts (numpy, 64 bits)."""

from __future__ import annotations

import numpy as np

#: Bytes that belong to a word of ``[^\x20\x09-\x0D]+``.
IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``data`` must have eight bytes to spare at its end."""
    eights = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    lengths = ends - starts
    h = lengths.astype(np.uint64) * _M3
    h = mix(h ^ (eights[starts] & _MASK[np.minimum(lengths, 8)]))
    left = np.flatnonzero(lengths > 8)
    at = 8
    while len(left):
        h[left] = mix(h[left] * _M3 ^ (eights[starts[left] + at] & _MASK[np.minimum(lengths[left] - at, 8)]))
        at += 8
        left = left[lengths[left] > at]
    return h


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    inside = IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    places = np.concatenate(([0], np.cumsum(sizes + 1)))
    return hash_spans(data, starts, ends), np.searchsorted(starts, places)


def window_hashes(h: np.ndarray, w: int) -> np.ndarray:
    """Hashes of all runs of ``w`` values, by doubling; entry p is the run that starts at p."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, level, span, at, rest = None, h, 1, 0, w
    while rest:
        if rest & 1:
            part = level[at : at + n]
            out = part if out is None else mix(out * _M3 + part)
            at += span
        rest >>= 1
        if rest:
            level = mix(level[:-span] * _M3 + level[span:])
            span *= 2
    return out


def whole_windows(first: np.ndarray, w: int, n: int) -> np.ndarray:
    """Mask over the ``n`` windows: those that lie within one text. ``first`` is the second result of hashed_words."""
    good = np.ones(max(n, 0), bool)
    for k in range(1, w):
        bad = first[1:-1] - k
        good[bad[(bad >= 0) & (bad < n)]] = False
    return good
