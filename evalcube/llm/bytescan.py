"""Vectorised scans of byte buffers: window minima, prefix sums of a multiplicative hash."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Put between texts that share a buffer; not part of a word.
SEPARATOR = b"\n"
_MASK32 = U(0xFFFFFFFF)
#: Odd multipliers of the two position hashes (arithmetic modulo 2**64) and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Entries of a table that a worker may keep between tasks.
KEPT = 1 << 17
_codes = [np.random.default_rng(7 + k).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for k in (0, 1)]


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _tables.get(k)
    if got is None or len(got[0]) < n:
        size = max(KEPT, 1 << (n - 1).bit_length())  # no larger than its texts ask
        out = []
        for b in (_BASES[k], pow(_BASES[k], -1, 1 << 64)):
            a = np.full(size, U(b))
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        got = _tables[k] = (out[0], out[1])
    return got


def drop_large_tables() -> None:
    """Tables that a long buffer asked for go when its task ends; they are made again in some ten milliseconds."""
    for k in [k for k, t in _tables.items() if len(t[0]) > KEPT]:
        del _tables[k]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the well-mixed high bits over the word."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class WindowHash:
    """Hash of any window of a buffer from prefix sums; equal windows hash alike wherever they start."""

    def __init__(self, buf: np.ndarray, k: int = 0):
        self.inv = _powers(k, len(buf) + 1)[1]
        self.pre = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_codes[k][buf] * _powers(k, len(buf) + 1)[0][:len(buf)], out=self.pre[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.pre[start + length] - self.pre[start]) * self.inv[start])


def gram_keys(buf: np.ndarray) -> np.ndarray:
    """(32-bit hash of the 8 bytes from each position) << 32 | position, for len(buf) - 7 positions."""
    n = len(buf) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    v = np.empty(n, np.uint64)
    raw = buf.tobytes()
    for off in range(8):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - off) // 8, offset=off)
        v[off::8] = part[:len(v[off::8])]
    v ^= v >> U(31)
    v *= U(0x9FB21C651E98DF25)
    v ^= v >> U(35)
    v *= U(0xD6E8FEB86659FD93)
    v >>= U(32)
    v <<= U(32)
    v |= np.arange(n, dtype=np.uint64)
    return v


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` keys; len(keys) - w + 1 values."""
    m, s = keys, 1
    while s < w:
        step = min(s, w - s)
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        s += step
    return m


def anchors(buf: np.ndarray, w: int) -> np.ndarray:
    """For each position p: the place of the (leftmost) smallest 8-byte gram in [p, p + w).

    It depends only on the w + 7 bytes from p, so equal text gets equal anchors.
    """
    return (sliding_min(gram_keys(buf), w) & _MASK32).astype(np.int64)
