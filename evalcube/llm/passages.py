"""Passages of words that occur again, whatever their length in bytes.

A passage is any run of ``words`` words that starts at two or more places of the
corpus (the same document included); it covers the bytes from its first to its
last word. Words are compared byte by byte, the space between them isn't.

Method: each run has an anchor, the smallest hashed gram of GRAM words in it, so
equal runs have equal anchors and only texts with an anchor that occurs again
take part. Of those, the hashes of the runs at such anchors are counted (a row
for each batch that holds one) and come back to the texts by part. Equality is
by 64-bit hashes.

Defined cases: null or empty text and text of fewer words has no passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import _powers, mix, sliding_min
from .common import flat, list_array, release, stage
from .shingles import buffers, words_of

U = np.uint64
GRAM = 20


class _Runs:
    """Hash of any run of words of a buffer, from prefix sums of the words' hashes."""

    def __init__(self, h: np.ndarray):
        power, self.inv = _powers(0, len(h) + 1)
        self.pre = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:len(h)], out=self.pre[1:])

    def at(self, start: np.ndarray, many: int) -> np.ndarray:
        return mix((self.pre[start + many] - self.pre[start]) * self.inv[start])


def _anchored(texts: list[bytes], words: int):
    """(runs, starts, print of the anchor of each, text of each, words before each text, first and end byte of each word, first byte of each text)."""
    gram = min(GRAM, words)
    _, h, start, end, off = words_of(texts)
    runs = _Runs(h)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    p = np.arange(max(0, len(h) - words + 1))
    p = p[p + words <= off[doc[p] + 1]]
    prints = runs.at(np.arange(max(0, len(h) - gram + 1)), gram)
    keys = (prints & U(0xFFFFFFFF00000000)) | np.arange(len(prints), dtype=np.uint64)
    at = (sliding_min(keys, words - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return runs, p, prints[at[p]], at[p], doc[p], off, start, end, np.cumsum(size) - size


def _prints(words: int):
    """(uid, raw) -> (f, uid, n): anchors of each text and at how many places it has them."""

    def scan(batches):
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for first, part in buffers([t or b"" for t in b.column(1).to_pylist()]):
                _, _, f, at, doc, *_ = _anchored(part, words)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                f, doc = f[new], doc[new]
                order = np.lexsort((f, doc))
                f, doc = f[order], doc[order]
                one = np.ones(len(f), bool)
                one[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
                place = np.flatnonzero(one)
                n = np.diff(np.concatenate([place, [len(f)]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[place].view(np.int64)), pa.array(uid[first + doc[place]]), pa.array(n.astype(np.int64))], names=["f", "uid", "n"])
    return scan


def _asked(texts: list[bytes], kept: np.ndarray, off: np.ndarray, words: int):
    """For each buffer of texts: (index of its first text, number of texts, starts at kept anchors, hash and text of each, ...)."""
    for first, part in buffers(texts):
        runs, p, f, _, doc, before, start, end, byte = _anchored(part, words)
        mine = kept[off[first]:off[first + len(part)]]
        of = np.repeat(np.arange(len(part)), np.diff(off[first:first + len(part) + 1]))
        # a print and its text as one number; prints of other texts can only ask too much, which the count corrects
        ok = np.isin(mix(f + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)), mix(mine.view(np.uint64) + of.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
        p, doc = p[ok], doc[ok]
        yield first, len(part), p, runs.at(p, words).view(np.int64), doc, before, start, end, byte


def _strings(words: int):
    """(part, raw, kept) -> (part, h, n): hash of every run at a kept anchor, once a batch."""

    def scan(batches):
        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            kept, off = flat(b.column(2))
            parts, hs = [], []
            for first, _, _, h, doc, *_ in _asked(b.column(1).to_pylist(), kept, off, words):
                parts.append(part[first + doc])
                hs.append(h)
            if not hs:
                continue
            q, h = np.concatenate(parts), np.concatenate(hs)
            for x in np.unique(q):
                v, n = np.unique(h[q == x], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), x, np.int32)), pa.array(v), pa.array(n.astype(np.int64))],
                                                 names=["part", "h", "n"])
    return scan


def _spans(words: int):
    """A group of texts and the runs found twice among its own -> covered stretches of bytes."""

    def join(docs: pa.Table, twice: pa.Table) -> pa.Table:
        kept, off = flat(docs.column("kept"))
        again = twice.column("h").to_numpy()
        st, ln, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for _, many, p, h, _, before, start, end, byte in _asked(docs.column("raw").to_pylist(), kept, off, words):
            d = np.zeros(len(start) + 1, np.int64)
            p = p[np.isin(h, again)]
            np.add.at(d, p, 1)
            np.add.at(d, p + words, -1)
            cov = np.concatenate([[0], np.cumsum(d[:-1]) > 0, [0]]).astype(np.int8)
            for i in range(many):  # a stretch ends with its text
                a, z = int(before[i]), int(before[i + 1])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cov[a + 1:z + 1], [0]])))
                s, e = start[a + edge[::2]], end[a + edge[1::2] - 1]
                st.append((s - byte[i]).astype(np.int32))
                ln.append((e - s).astype(np.int32))
                n.append(len(s))
        return pa.table({"uid": docs.column("uid").combine_chunks(), "starts": list_array(np.concatenate(st), n, pa.int32()),
                         "lengths": list_array(np.concatenate(ln), n, pa.int32())})
    return join


def repeated_passages(docs: DataFrame, words: int, part_docs: int = 256) -> DataFrame:
    """(uid, starts array<int>, lengths array<int>) of documents with passages of ``words`` words that occur again; docs: (uid, raw binary)."""
    prints = stage(docs.select("uid", "raw").mapInArrow(_prints(words), "f bigint, uid bigint, n bigint"), "pw-prints")
    again = prints.groupBy("f").agg(F.sum("n").alias("all")).filter("all > 1").select("f")
    kept = prints.join(again, "f", "left_semi").groupBy("uid").agg(F.collect_list("f").alias("kept"))
    kept = stage(kept, "pw-kept")
    release(prints)
    n_parts = max(1, kept.count() // part_docs)
    part = (F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) % n_parts).cast("int")
    work = stage(docs.select("uid", "raw").join(kept, "uid").select("uid", "raw", part.alias("part"), "kept"), "pw-work", "zstd")
    release(kept)
    # a run's rows are one for each batch and part that holds it
    strings = work.select("part", "raw", "kept").mapInArrow(_strings(words), "part int, h bigint, n bigint")
    twice = strings.withColumn("all", F.sum("n").over(Window.partitionBy("h"))).filter("all > 1").select("part", "h")
    out = work.groupBy("part").cogroup(twice.groupBy("part")).applyInArrow(
        _spans(words), "uid bigint, starts array<int>, lengths array<int>")
    out = stage(out.filter(F.size("starts") > 0), "pw-spans")
    release(work)
    return out


def _united(batches):
    """(uid, starts, lengths): overlapping and touching stretches of a text as one, in order."""
    for b in batches:
        at, off = flat(b.column(1))
        size = flat(b.column(2))[0]
        st, ln, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for i in range(b.num_rows):
            s, e = at[off[i]:off[i + 1]], at[off[i]:off[i + 1]] + size[off[i]:off[i + 1]]
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] > e[:-1]
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(s)]])[:len(first)] - 1
            st.append(s[first].astype(np.int32))
            ln.append((e[last] - s[first]).astype(np.int32))
            n.append(len(first))
        yield pa.RecordBatch.from_arrays([b.column(0), list_array(np.concatenate(st), n, pa.int32()), list_array(np.concatenate(ln), n, pa.int32())],
                                         names=["uid", "starts", "lengths"])


def united(one: DataFrame, other: DataFrame) -> DataFrame:
    """Stretches (uid, starts, lengths) that either table covers."""
    both = one.union(other).groupBy("uid").agg(F.collect_list(F.struct("starts", "lengths")).alias("x")).select(
        "uid", F.flatten("x.starts").alias("starts"), F.flatten("x.lengths").alias("lengths"))
    return both.mapInArrow(_united, "uid bigint, starts array<int>, lengths array<int>")
