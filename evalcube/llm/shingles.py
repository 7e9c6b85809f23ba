"""Distinct word shingles of texts as 64-bit hashes, vectorised over whole buffers."""

from __future__ import annotations

import numpy as np

from .bytescan import SEPARATOR, WindowHash, mix

U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(texts, size: int = 1 << 16):
    """Lists of whole texts of about ``size`` bytes together: (index of the first, list of bytes).

    A scan holds some ten arrays of 8 bytes for each byte; of 64 kB they stay in a core's cache and a worker small.
    """
    first, part, total = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t)
        total += len(t)
        if total >= size:
            yield first, part
            first, part, total = i + 1, [], 0
    if part:
        yield first, part


def words_of(texts: list[bytes], lower: bool = False):
    """Words of all texts in order: (joined bytes, hash, start, end, number of words before each text and in all)."""
    raw = SEPARATOR.join(texts) + SEPARATOR
    buf = np.frombuffer(raw, np.uint8)
    if lower:
        buf = _LOWER[buf]
    w = np.concatenate([[False], _WORD[buf]])
    edge = np.flatnonzero(w[1:] != w[:-1])
    start, end = edge[::2], edge[1::2]
    h = WindowHash(buf).at(start, end - start) ^ ((end - start).astype(np.uint64) * U(0x9FB21C651E98DF25))
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return raw, mix(h), start, end, np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))


def shingle_sets(texts: list[bytes], width: int = 3, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    _, h, _, _, off = words_of(texts, lower)
    g = h.copy()
    for k in range(1, width):
        g[:len(g) - k] = mix(g[:len(g) - k] * U(0xD1342543DE82EF95) + h[k:]) if len(g) > k else g[:0]
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(g[a:b - width + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * U(0xD1342543DE82EF95) + h[k:k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
