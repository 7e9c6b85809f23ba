"""Importance resampling towards a target distribution over hashed n-grams.

Each text becomes a bag of n-grams that fall into a fixed number of buckets
(crc32 of the n-gram modulo ``buckets``). A bucket's gain is the log ratio of
its smoothed shares in the target texts and in all texts; a text's weight is the
sum of its n-grams' gains. Gumbel noise drawn from the id turns the weights into
a weighted sample without replacement: the highest scores are drawn.

N-grams are interned batch by batch in an open-addressed NumPy table: slots are
found by xxhash64 with linear probing, an occupied slot counts as the same n-gram
only if the bytes agree, and each slot holds its n-gram's bucket and count. The
slot ids of a batch's occurrences then gather the gains, so crc32 is worked out
once for each distinct n-gram of a batch.

What is gathered: counts of at most ``buckets`` buckets (partial sums by
partition), and one total for each range of the final order.

Defined cases: null or empty text and text without words has no features and
weight 0; a null id draws its noise from the seed alone and ranks behind equal
scores with ids; repeated rows are drawn one by one; an empty table gives no
rows, an empty target leaves all counts of the target 0; long texts are worked
off in slabs; further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, running_sum, stage, with_uid

U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text worked off at once.
SLAB = 4 << 20

# The primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63),
                           U(0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U(k)) | (x >> U(64 - k))


def _lanes(buf: np.ndarray, at: np.ndarray, width: str) -> np.ndarray:
    """Little-endian words of ``buf`` at any byte offsets."""
    size = np.dtype(width).itemsize
    return np.ndarray((len(buf) - size + 1,), width, buf, strides=(1,))[at].astype(np.uint64)


def xxhash64_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each span of ``buf``, which has at least 8 bytes behind the last span."""
    h = length.astype(np.uint64) + _P5
    short = length < 32
    at, left = start.copy(), np.where(short, length, 0)
    while (i := np.flatnonzero(left >= 8)).size:
        k = _rotl(_lanes(buf, at[i], "<u8") * _P2, 31) * _P1
        h[i] = _rotl(h[i] ^ k, 27) * _P1 + _P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _rotl(h[i] ^ (_lanes(buf, at[i], "<u4") * _P1), 23) * _P2 + _P3
    at[i] += 4
    left[i] -= 4
    while (i := np.flatnonzero(left > 0)).size:
        h[i] = _rotl(h[i] ^ (buf[at[i]].astype(np.uint64) * _P5), 11) * _P1
        at[i] += 1
        left[i] -= 1
    h = (h ^ (h >> U(33))) * _P2
    h = (h ^ (h >> U(29))) * _P3
    h ^= h >> U(32)
    raw = memoryview(buf)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i]:start[i] + length[i]])
    return h


def _same_bytes(buf, start, length, a, b) -> np.ndarray:
    """Whether the spans numbered ``a`` and ``b`` hold the same bytes."""
    same = length[a] == length[b]
    done = 0
    left = np.where(same, length[a], 0)
    while (i := np.flatnonzero(same & (left > done))).size:
        cut = np.minimum(left[i] - done, 8).astype(np.uint64)
        drop = (U(8) - cut) * U(8)
        same[i] = (_lanes(buf, start[a[i]] + done, "<u8") << drop) == (_lanes(buf, start[b[i]] + done, "<u8") << drop)
        done += 8
    return same


class InternTable:
    """Open-addressed table over the n-gram spans of one buffer: ``slot`` of each occurrence, ``bucket`` and ``count`` of each slot."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int, hashes=xxhash64_spans):
        n = len(start)
        size = 1 << max(4, (2 * n - 1).bit_length() if n else 4)
        mask = size - 1
        key = hashes(buf, start, length)
        owner = np.full(size, -1, np.int64)
        self.slot = (key & U(mask)).astype(np.int64)
        todo = np.arange(n)
        while todo.size:
            s = self.slot[todo]
            free = owner[s] < 0
            owner[s[free]] = todo[free]  # of several that claim a slot one stays
            held = owner[s]
            same = key[held] == key[todo]
            i = np.flatnonzero(same & (held != todo))
            same[i] = _same_bytes(buf, start, length, held[i], todo[i])
            todo = todo[~same]
            self.slot[todo] = (self.slot[todo] + 1) & mask
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        raw = memoryview(buf)
        first = owner[self.used]
        self.bucket[self.used] = [zlib.crc32(raw[a:a + k]) % buckets for a, k in zip(start[first].tolist(), length[first].tolist())]


def _slabs(texts, size: int = SLAB):
    """Lists of (text number, bytes, words carried over) of about ``size`` bytes; only texts beyond that are cut, between words."""
    part, total = [], 0
    for i, t in enumerate(texts):
        a = 0
        while a < len(t) or (a == 0 and not t):
            b = min(len(t), a + size)
            while b < len(t) and _WORD[_LOWER[t[b - 1]]] and _WORD[_LOWER[t[b]]]:
                b += 1
            part.append((i, t[a:b], a > 0))
            total += b - a + 1
            a = b
            if total >= size:
                yield part
                part, total = [], 0
            if not t:
                break
    if part:
        yield part


def _features(texts, min_n: int, max_n: int):
    """For each slab: (normalised buffer, starts, lengths, text number of each n-gram, text numbers and words of its pieces)."""
    tail = b""
    for part in _slabs(texts):
        pieces = []
        for i, raw, more in part:
            pieces.append((tail + b" " + raw) if more and tail else raw)
        carried = [len(tail.split()) if more and tail else 0 for _, _, more in part]
        buf = _LOWER[np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)]
        w = np.concatenate([[False], _WORD[buf]])
        edge = np.flatnonzero(w[1:] != w[:-1])
        start, end = edge[::2], edge[1::2]
        length = end - start
        # words side by side, one space between: any run of words is one span
        at = np.concatenate([[0], np.cumsum(length + 1)])
        keep = w[1:].copy()
        keep[end] = True
        text = np.where(w[1:], buf, 0x20)[keep]
        text = np.concatenate([text, np.zeros(8, np.uint8)])
        bounds = np.cumsum([len(p) + 1 for p in pieces])
        piece = np.searchsorted(bounds, start, side="right")
        off = np.searchsorted(piece, np.arange(len(pieces) + 1))
        starts, lengths, owners = [], [], []
        for n in range(min_n, max_n + 1):
            k = np.arange(max(0, len(start) - n + 1))
            last = k + n - 1
            ok = piece[k] == piece[last]
            # an n-gram inside the carried words has been counted with the slab before
            ok &= last - off[piece[last]] >= np.array(carried, np.int64)[piece[last]]
            k, last = k[ok], last[ok]
            starts.append(at[k])
            lengths.append(at[last] + length[last] - at[k])
            owners.append(piece[k])
        own = np.array([i for i, _, _ in part], np.int64)
        yield (text, np.concatenate(starts), np.concatenate(lengths), own[np.concatenate(owners)] if len(start) else np.zeros(0, np.int64),
               own, np.diff(off) - np.array(carried, np.int64))
        if max_n > 1 and pieces:
            a, b = max(off[-2], off[-1] - max_n + 1), off[-1]
            tail = text[at[a]:at[b] - 1].tobytes() if b > a else b""


def _bucket_counts(buckets: int, min_n: int, max_n: int):
    """(text bytes) -> (bucket, n), one set of rows for each partition."""

    def scan(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for buf, start, length, *_ in _features([t or b"" for t in b.column(0).to_pylist()], min_n, max_n):
                table = InternTable(buf, start, length, buckets)
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])
        give_back_memory()
    return scan


def _weights(gains: np.ndarray, min_n: int, max_n: int):
    """(uid, text bytes, id) -> (uid, n_words, n_features, weight, id)."""
    buckets = len(gains)

    def scan(batches):
        for b in batches:
            words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for buf, start, length, owner, own, n in _features([t or b"" for t in b.column(1).to_pylist()], min_n, max_n):
                table = InternTable(buf, start, length, buckets)
                np.add.at(words, own, n)
                features += np.bincount(owner, minlength=b.num_rows)
                np.add.at(weight, owner, gains[table.bucket][table.slot])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(features), pa.array(weight), b.column(2)],
                                             names=["uid", "n_words", "n_features", "weight", "id"])
        give_back_memory()
    return scan


def bucket_gains(texts: DataFrame, target: DataFrame, buckets: int, min_n: int, max_n: int) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of every bucket; both frames have ``raw`` only."""
    count = _bucket_counts(buckets, min_n, max_n)
    both = (texts.mapInArrow(count, "bucket bigint, n bigint").withColumn("side", F.lit(0))
            .union(target.mapInArrow(count, "bucket bigint, n bigint").withColumn("side", F.lit(1))))
    found = both.groupBy("side", "bucket").agg(F.sum("n").alias("n")).toPandas()  # 2 * buckets rows at most
    per = np.zeros((2, buckets))
    per[found["side"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    s, t = per
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
                        min_n: int = 1, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20,
                        percent: int = 10) -> DataFrame:
    """(uid, id, n_words, n_features, weight, score, rank), one row for each row of ``docs``.

    ``rank`` counts the drawn texts from 1: of the N texts of ``min_words`` words
    and more the floor(percent * N / 100) highest scores, ties to smaller ids.
    """
    base = with_uid(docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("raw")))
    gains = bucket_gains(base.select("raw"), target.select(F.encode(F.col(target_col), "UTF-8").alias("raw")), buckets, min_n, max_n)
    kind = dict(base.dtypes)["id"]
    rows = base.select("uid", "raw", "id").mapInArrow(
        _weights(gains, min_n, max_n), f"uid bigint, n_words bigint, n_features bigint, weight bigint, id {kind}")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stage(rows.withColumn("score", F.col("weight") + noise), "ir-weights")
    able = rows.filter(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    # the order needs only narrow rows; equal scores and ids are still dealt out by uid
    order = able.select("uid", (-F.col("score")).alias("down"), F.col("id").isNull().alias("none"), "id", F.lit(1).cast("bigint").alias("one"))
    place = running_sum(order, ["down", "none", "id", "uid"], "one", "before", "ir-order")
    drawn = place.filter(F.col("before") < draw).select("uid", (F.col("before") + 1).alias("rank"))
    return rows.join(drawn, "uid", "left").select("uid", F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
