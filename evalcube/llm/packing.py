"""Best-fit packing of token sequences by non-negative least squares over length patterns.

1. Texts become token ids plus an end id; only those longer than a sequence are
   cut, into full pieces and a last one.
2. The histogram of piece lengths (at most ``size`` numbers, whatever the
   corpus) is all the planner sees. Patterns of few pieces that fill a sequence
   are enumerated on a grid of length classes; non-negative least squares fits
   their repeat counts to the histogram, weighted by length.
3. The counts are rounded down. Each pattern's pieces are taken as exact lengths,
   the last one as the longest that still fits.
4. Residual lengths are packed best-fit, longest first, into the space left and
   into new sequences. Every step handles all equal sequences at once, so the
   plan grows with the number of lengths, not with the corpus.
5. Pieces of one length are numbered across the cluster (counts for each
   partition and length, summed) and look their place up in the plan.

Defined cases: null or empty text is one piece holding the end id; repeated rows
are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back_memory, held, partition_id, stage, with_uid
from .shingles import buffers, words_of

#: Words whose ids a worker remembers before it starts anew.
WORD_CACHE = 700_000
_PLAIN = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}]*)")


class WordIds:
    """Ids of the words of a white-space dropping tokenizer.

    Its pre-tokenizer never joins text across white space, so a text's ids are
    those of its words in turn. Words are told apart by 64-bit hashes; new ones
    are encoded many at a time. A plain word of letters with marks behind them is
    two pieces for the pre-tokenizer, encoded and remembered apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, their numbers
        self.pieces: dict[str, bytes] = {"": b""}
        self.ids = np.zeros(1 << 16, np.uint32)  # grows; self.used of it are filled
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)

    def _one(self, word: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode(self, new: list[str]) -> None:
        """Pieces joined by spaces, told apart by the tokens that end a piece; one by one if those don't add up."""
        for at in range(0, len(new), 4000):
            some = new[at:at + 4000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(some) and end[-1] == len(ids):
                raw, cut = ids.tobytes(), [0, *(4 * end).tolist()]
                self.pieces.update(zip(some, (raw[x:y] for x, y in zip(cut, cut[1:]))))
            else:
                self.pieces.update((w, self._one(w)) for w in some)

    def rest(self) -> None:
        """Between tasks: the pieces go, as the worker may stay idle beside other work; words keep their ids."""
        self.pieces = {"": b""}
        give_back_memory()

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        split = []
        for w in words:
            plain = w.isascii() or (max(w) < "\u0250" and unicodedata.is_normalized("NFC", w))
            m = _PLAIN.fullmatch(w) if plain else None
            split.append((m[1].lower(), m[2]) if m and "<|" not in w else None)
        pieces = self.pieces
        self._encode(list({p for x in split if x for p in x if p not in pieces}))
        ids = [pieces[x[0]] + pieces[x[1]] if x else self._one(w) for w, x in zip(words, split)]
        count = np.array([len(x) // 4 for x in ids], np.int64)
        ids = np.frombuffer(b"".join(ids), "<u4")
        n = len(self.place)
        while n + len(words) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.first[n:n + len(words)] = self.used + np.cumsum(count) - count
        self.count[n:n + len(words)] = count
        self.used += len(ids)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], np.concatenate([self.place, np.arange(n, n + len(words))])[order]

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't known."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.place[at], -1)

    def of_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.place) > WORD_CACHE:
            self._forget()
        raw, h, start, end, off = words_of(texts)
        code, distinct = pd.factorize(h)
        seen = np.zeros(len(distinct), np.int64)
        seen[code[::-1]] = np.arange(len(code))[::-1]  # first word of each hash
        new = np.flatnonzero(self._places(distinct) < 0)
        if len(new):
            self._learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in
                                        zip(start[seen[new]].tolist(), end[seen[new]].tolist())])
        place = self._places(distinct)[code]
        count = self.count[place]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[place] - total[:-1], count) + np.arange(total[-1])]
        cut = total[off].tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


def tokenizer(path: str) -> WordIds:
    return held(("tokenizer", path), lambda: WordIds(path))


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    end = np.array([end_id], np.uint32)

    def scan(batches):
        tok, pid, seen = tokenizer(path), partition_id(), np.zeros(size + 1, np.int64)
        for b in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            texts = b.column(1).to_pylist()
            encoded = (x for _, part in buffers([t or b"" for t in texts], 2 << 20) for x in tok.of_all(part))
            for i, raw in enumerate(encoded):
                raw = np.concatenate([raw, end]).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at:at + 4 * size]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(part)
            cols = [b.column(0).take(pa.array(row, pa.int64())), b.column(2).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(np.array(rank, np.int64)),
                    pa.array(np.full(len(row), pid, np.int32))]
            names = ["uid", "id", "piece", "start", "length", "ids_crc32", "rank", "pid"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        tok.rest()
    return scan


def patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to write ``classes`` as a sum of at most ``parts`` classes, largest first."""
    out = []

    def grow(rest, most, have):
        if rest == 0:
            out.append(tuple(have))
            return
        if len(have) == parts:
            return
        for c in range(min(rest, most), 0, -1):
            if c * (parts - len(have)) < rest:
                break
            grow(rest - c, c, [*have, c])

    grow(classes, classes, [])
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 minimising |a x - b|: an active set that grows by the steepest column and drops negative ones."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tol:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            cut = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += cut * (z - x[on])
            drop = on[low & (x[on] <= 1e-12)] if (low & (x[on] <= 1e-12)).any() else on[low][:1]
            x[drop] = 0
            active[drop] = False
    return x


def plan(hist: np.ndarray, size: int, classes: int = 64, parts: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many alike) that hold every piece of ``hist`` (count by length)."""
    left = hist.astype(np.int64).copy()
    width = -(-size // classes)
    of = -(-np.arange(size + 1) // width)
    pats = patterns(classes, parts)
    a = np.zeros((classes, len(pats)))
    for j, p in enumerate(pats):
        for c in p:
            a[c - 1, j] += 1
    b = np.bincount(of[1:], weights=left[1:], minlength=classes + 1)[1:]
    weight = np.sqrt(np.arange(1, classes + 1) / classes)[:, None]
    fit = np.floor(nnls(a * weight, b * weight[:, 0]) + 1e-6).astype(np.int64)

    lengths = [i for i in range(1, size + 1) if left[i]]  # those still to be placed, ascending
    groups: list[tuple[tuple[int, ...], int]] = []

    def longest(limit: int, least: int) -> int:
        """Longest length of at most ``limit`` and at least ``least`` that is left, or 0."""
        i = bisect_left(lengths, limit + 1) - 1
        while i >= 0 and lengths[i] >= least:
            if left[lengths[i]]:
                return lengths[i]
            lengths.pop(i)
            i -= 1
        return 0

    for j in sorted(np.flatnonzero(fit), key=lambda j: pats[j], reverse=True):
        todo = int(fit[j])
        while todo:
            took: list[int] = []
            for c in pats[j][:-1]:
                n = longest(c * width, (c - 1) * width + 1)
                if not n:
                    break
                took.append(n)
                left[n] -= 1
            else:
                n = longest(size - sum(took), 1)
                if n:
                    took.append(n)
                    left[n] -= 1
            for n in took:
                left[n] += 1
            if len(took) < len(pats[j]):
                break
            many = min(todo, *(int(left[n]) // took.count(n) for n in took))
            for n in took:
                left[n] -= many
            groups.append((tuple(took), many))
            todo -= many

    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(g, many):
        s = size - sum(g)
        if s not in spaces:
            spaces[s] = []
            order.insert(bisect_left(order, s), s)
        spaces[s].append((g, many))

    for g, many in groups:
        put(g, many)
    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            i = bisect_left(order, n)
            while i < len(order) and not spaces[order[i]]:
                del spaces[order[i]], order[i]
            if i == len(order):
                fill = size // n
                if todo >= fill:
                    put((n,) * fill, todo // fill)
                if todo % fill:
                    put((n,) * (todo % fill), 1)
                break
            g, many = spaces[order[i]].pop()
            took = min(todo, many)
            if took < many:
                spaces[order[i]].append((g, many - took))
            put((*g, n), took)
            todo -= took
    return [x for s in order for x in spaces[s]]


def lookup(groups) -> tuple[np.ndarray, ...]:
    """Sorted slot table: key (length << 40 | first rank), first sequence, repeats-free offset."""
    first, key, seq, off = 0, [], [], []
    used: dict[int, int] = {}
    for g, many in groups:
        at = 0
        for n in g:
            r = used.get(n, 0)
            key.append((n << 40) | r)
            seq.append(first - r)
            off.append(at)
            used[n] = r + many
            at += n
        first += many
    key, seq, off = (np.array(x, np.int64) for x in (key, seq, off))
    o = np.argsort(key)
    return key[o], seq[o], off[o]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096,
         end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids binary]): one row for each piece.

    ``ids`` are little-endian unsigned 32-bit numbers; ``tokenizer_path`` names a file on every executor.
    """
    base = with_uid(docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("raw")))
    typ = dict(base.dtypes)["id"]
    schema = (f"uid bigint, id {typ}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, pid int"
              + ", ids binary" * with_ids)
    pieces = stage(base.select("uid", "raw", "id").mapInArrow(
        _pieces(tokenizer_path, size, end_id, with_ids), schema), "pack-pieces")
    counts = stage(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "pack-counts")
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        hist[r["length"]] = r["n"]
    table = docs.sparkSession.sparkContext.broadcast(lookup(plan(hist, size)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")
    offsets = counts.withColumn("before", before).drop("n")

    def place(batches):
        key, seq, off = table.value
        for b in batches:
            rank = b.column("rank").to_numpy(zero_copy_only=False) + b.column("before").to_numpy(zero_copy_only=False)
            n = b.column("length").to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, (n << 40) | rank, side="right") - 1
            keep = [c for c in b.schema.names if c not in ("rank", "before", "pid")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(seq[i] + rank), pa.array(off[i])],
                names=[*keep, "sequence_id", "offset"])

    joined = pieces.join(offsets, ["pid", "length"])
    kept = [c for c in joined.columns if c not in ("rank", "before", "pid")]
    types = dict(joined.dtypes)
    out = joined.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id bigint, offset bigint")
    return out.drop("uid").withColumnRenamed("id", id_col)
