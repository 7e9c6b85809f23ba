"""Repeated byte passages by a distributed difference-cover suffix array.

A passage is any string of ``length`` bytes that starts at two or more places of
the corpus (the same document included); every byte it covers is marked.

Method
0. A text that occurs again as a whole is covered as a whole; one of its rows stands
   for all of them in what follows.
1. Anchors: for each byte position p the smallest hashed 8-byte gram among the
   next ``window`` ones. Equal strings have equal anchors, about 2 / window of
   all positions are one. A string of ``length`` bytes holds the whole prefix of
   length - window + 1 bytes of its anchor, so anchors whose prefix occurs once
   are set aside without loss (one count over 8-byte fingerprints).
2. Suffixes at the remaining anchors are sorted by difference cover. The symbol
   of an anchor is the string of window + 8 bytes from it, named in byte order;
   the next symbol is the anchor of the following position, so chains of symbols
   compare like the bytes. Suffixes whose distance from the end of their chain
   is 1 or 2 modulo 3 are the sample: their triples of names are sorted and
   named, the names are sorted recursively until each one is unique or spans
   ``length`` bytes, and the remaining third is merged in by (symbol, rank) and
   (symbol, symbol, rank).
3. Adjacent suffixes whose first ``length`` bytes agree are repeats; their bytes
   are covered.
4. Strings that start between anchors are the suffixes that remain. Only those
   not already inside covered bytes can change the result; they are compared,
   with every string that has the same anchor prefix and the same distance to
   it, by the hash of their bytes.

Names and ranks are the row numbers of range-sorted written tables; nothing but
one number for each partition reaches the driver. Equality is by 64-bit hashes
of the whole string.

Defined cases: null or empty text has no bytes and no spans; texts shorter than
``length`` lose nothing; a repeated row is a document of its own, so both lose
what they share; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import WindowHash, anchors, sliding_min, gram_keys  # noqa: F401
from .common import flat, list_array, partition_id, release, running_max, running_sum, stage, with_uid
from .passages import repeated_passages, united
from .shingles import buffers

GRAM = 8
#: Bytes scanned at once, few enough that the arrays over them stay in a core's cache; longer texts go in overlapping slabs.
SLAB = 1 << 16
_OPEN = 1 << 30  # span of a chain that has ended: nothing is left to compare


def _slabs(texts, length: int):
    """(row, first byte, buffer, valid starts) of every slab of every text of at least ``length`` bytes."""
    for row, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for s in range(0, len(t) - length + 1, SLAB):
            yield row, s, t[s:s + SLAB + length - 1]


def _buffers(texts, length: int):
    """Slabs joined to buffers of about SLAB bytes: (bytes, list of (row, first byte, place, size))."""
    parts, where, size = [], [], 0
    for row, s, piece in _slabs(texts, length):
        parts.append(piece)
        where.append((row, s, size, len(piece)))
        size += len(piece)
        if size >= SLAB:
            yield b"".join(parts), where
            parts, where, size = [], [], 0
    if parts:
        yield b"".join(parts), where


def _anchor_prints(length: int, window: int):
    """Arrow batches (uid, bytes) -> (f, uid, at): each anchor with its prefix fingerprint."""
    keep = length - window + 1

    def scan(batches):
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for raw, where in _buffers(b.column(1).to_pylist(), length):
                buf = np.frombuffer(raw, np.uint8)
                at = anchors(buf, window)
                w = np.array(where, np.int64)
                # the first start of each slab and every start at which the anchor changes;
                # starts p have p + length inside their own slab
                p = np.union1d(w[:, 2], np.flatnonzero(at[1:] != at[:-1]) + 1)
                slab = np.searchsorted(w[:, 2], p, "right") - 1
                own = p <= (w[:, 2] + w[:, 3] - length)[slab]
                a, slab = at[p[own]], slab[own]
                h = WindowHash(buf).at(a, keep).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(uid[w[slab, 0]]), pa.array((a - w[slab, 2] + w[slab, 1]).astype(np.int32))],
                    names=["f", "uid", "at"])
    return scan


class _Joined:
    """Whole texts in one buffer; places in it are counted from its first byte."""

    def __init__(self, rows: np.ndarray, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.rows, self.raw = rows, b"".join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.end = np.cumsum(size)
        self.start = self.end - size

    def places(self, values: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places in the buffer of the places in its texts, lists of all rows given."""
        return np.concatenate([values[off[r]:off[r + 1]] + s for r, s in zip(self.rows.tolist(), self.start)])

    def text_of(self, place: np.ndarray) -> np.ndarray:
        """Which of the buffer's texts each place is in (no text is empty)."""
        return np.searchsorted(self.start, place, "right") - 1

    def inside(self, n: int, many: int) -> np.ndarray:
        """Mask of the first ``many`` places: those with ``n`` bytes of their text from them on."""
        ok = np.zeros(len(self.buf), bool)
        for s, e in zip(self.start.tolist(), self.end.tolist()):
            ok[s:max(s, e - n + 1)] = True
        return ok[:many]

    def covered(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Mask of the places in [s, s + width) for any s of ``starts``, up to the end of the text."""
        return _ranges(starts, np.minimum(width, self.end[self.text_of(starts)] - starts), len(self.buf))


def _joined(texts: list[bytes], rows=None):
    """Texts of the rows, whole, in buffers of about SLAB bytes: short ones share the cost of a scan."""
    rows = np.arange(len(texts)) if rows is None else rows
    for first, part in buffers([texts[i] for i in rows.tolist()], SLAB):
        yield _Joined(rows[first:first + len(part)], part)


def _kept_prints(length: int, window: int):
    """(uid, bytes, kept anchors) -> (f, uid, at): their prefix fingerprints again."""
    keep = length - window + 1

    def scan(batches):
        for b in batches:
            kept, off = flat(b.column(2))
            f = [WindowHash(t.buf).at(t.places(kept, off), keep).view(np.int64) for t in _joined(b.column(1).to_pylist())]
            uid = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*f, np.zeros(0, np.int64)])), pa.array(uid), pa.array(kept)],
                                             names=["f", "uid", "at"])
    return scan


def _ranges(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Mask of the positions in [s, s + width) for any s of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def _nodes(texts: _Joined, kept: np.ndarray, length: int, window: int):
    """Chains of anchors of the texts: places, index of the next one (-1: chain ends)."""
    at = anchors(texts.buf, window)
    own = texts.inside(window + 7, len(at))  # an anchor is chosen from so many bytes
    region = texts.covered(kept, length)
    pos = np.unique(np.concatenate([at[region[:len(at)] & own], kept]))
    pos = pos[region[pos]]
    nxt = np.full(len(pos), -1, np.int64)
    ok = pos + 1 < len(at)
    ok[ok] = own[pos[ok] + 1]
    ok &= pos + 1 < texts.end[texts.text_of(pos)]
    to = at[pos[ok] + 1]
    j = np.searchsorted(pos, to)
    j[j == len(pos)] = 0
    nxt[ok] = np.where(pos[j] == to, j, -1)
    return pos, nxt


def _symbol_rows(length: int, window: int):
    size = window + GRAM

    def scan(batches):
        for b in batches:
            kept, off = flat(b.column(2))
            for t in _joined(b.column(1).to_pylist()):
                pos, _ = _nodes(t, t.places(kept, off), length, window)
                own = np.minimum(size, t.end[t.text_of(pos)] - pos)
                h, first = np.unique(WindowHash(t.buf).at(pos, own).view(np.int64), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array([t.raw[x:x + n] for x, n in zip(pos[first].tolist(), own[first].tolist())], pa.binary())],
                    names=["sh", "s"])
    return scan


_LEVEL = "uid bigint, pos array<int>, nxt array<int>, sym array<bigint>, cov array<int>"


def _node_rows(length: int, window: int):
    """(uid, pos, nxt, sym, cov, f400): the chains; f400 = hash of the first ``length`` bytes, 0 if fewer."""
    size = window + GRAM

    def scan(batches):
        for b in batches:
            kept, off = flat(b.column(2))
            out, n = [[], [], [], [], []], []
            uid = b.column(0)
            for t in _joined(b.column(1).to_pylist()):
                pos, nxt = _nodes(t, t.places(kept, off), length, window)
                wh, of = WindowHash(t.buf), t.text_of(pos)
                left = t.end[of] - pos
                own = np.minimum(size, left)
                full = left >= length
                f = np.zeros(len(pos), np.int64)
                f[full] = wh.at(pos[full], length).view(np.int64)
                many = np.bincount(of, minlength=len(t.rows))
                n += many.tolist()
                before = (np.cumsum(many) - many)[of]  # a text's chain counts from its own first anchor
                for o, v in zip(out, (pos - t.start[of], np.where(nxt < 0, -1, nxt - before), wh.at(pos, own).view(np.int64),
                                      np.where(own < size, _OPEN, own), f)):
                    o.append(v)
            if not n:
                continue
            typ = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [uid, *(list_array(np.concatenate(o).astype(t.to_pandas_dtype()), n, t) for o, t in zip(out, typ))],
                names=["uid", "pos", "nxt", "sym", "cov", "f400"])
    return scan


def _chains(b):
    """Per document of a level batch: (uid, pos, nxt, sym, cov, depth)."""
    uid = b.column("uid").to_pylist()
    cols = [flat(b.column(c)) for c in ("pos", "nxt", "sym", "cov")]
    off = cols[0][1]
    for i, u in enumerate(uid):
        pos, nxt, sym, cov = (c[0][off[i]:off[i + 1]] for c in cols)
        depth = [0] * len(pos)
        for k, j in zip(range(len(pos) - 1, -1, -1), nxt[::-1].tolist()):
            if j >= 0:
                depth[k] = depth[j] + 1
        yield i, u, pos, nxt, sym, cov, np.array(depth, np.int64)


def _step(nxt: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Next index of each index, -1 where the chain has ended."""
    return np.where(i >= 0, nxt[i], -1) if len(nxt) else i


def _pick(values: np.ndarray, i: np.ndarray) -> np.ndarray:
    """values[i], 0 where the chain has ended (smaller than any name)."""
    return np.where(i >= 0, values[i], 0) if len(values) else i


def _batch(cols, names):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)


def _triples(batches):
    for b in batches:
        out = [[] for _ in range(6)]
        for _, u, pos, nxt, sym, cov, depth in _chains(b):
            i = np.flatnonzero(depth % 3 != 0)
            j = _step(nxt, i)
            k = _step(nxt, j)
            end = np.where(k >= 0, pos[k] - pos[i] + cov[k], _OPEN)
            for o, v in zip(out, (np.full(len(i), u, np.int64), i.astype(np.int32), sym[i], _pick(sym, j),
                                  _pick(sym, k), np.minimum(end, _OPEN).astype(np.int32))):
                o.append(v)
        if out[0]:
            yield _batch(out, ["uid", "i", "t0", "t1", "t2", "cov"])


def _shrink(batches):
    """Level joined with the names of its sample -> the level of the recursion.

    Only suffixes of open names (written as negative numbers) and the sampled one
    after each of them are needed: any other is placed by its name alone, so
    chains end at the first name that is not open.
    """
    for b in batches:
        names, off = flat(b.column("names"))
        out, n, uids = [[] for _ in range(6)], [], []
        for r, u, pos, nxt, sym, cov, depth in _chains(b):
            name = names[off[r]:off[r + 1]]
            is_open = name < 0
            if not is_open.any():
                continue
            i = np.flatnonzero(depth % 3 != 0)
            j = _step(nxt, i)
            k = _step(nxt, j)
            third = _step(nxt, k)
            place = np.full(len(pos) + 1, -1, np.int64)
            place[i] = np.arange(len(i))
            after = np.where(is_open & (third >= 0), place[third], -1)
            keep = is_open.copy()
            keep[after[after >= 0]] = True
            end = np.where(k >= 0, pos[k] - pos[i] + cov[k], _OPEN)
            new = np.full(len(i) + 1, -1, np.int64)
            new[np.flatnonzero(keep)] = np.arange(keep.sum())
            for o, v in zip(out, (pos[i], new[after], np.abs(name), np.where(is_open, np.minimum(end, _OPEN), _OPEN),
                                  np.arange(len(i)), is_open)):
                o.append(v[keep])
            n.append(int(keep.sum()))
            uids.append(u)
        if n:
            typ = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()),
                 *(list_array(np.concatenate(o).astype(t.to_pandas_dtype()), n, t) for o, t in zip(out, typ))],
                names=["uid", "pos", "nxt", "sym", "cov", "place", "open"])


def _merge_rows(batches):
    """Every suffix with the keys that place it: typ 0 is not in the sample, 1 and 2 are."""
    for b in batches:
        names, off = flat(b.column("names"))
        places, offp = flat(b.column("places"))
        ranks = flat(b.column("ranks"))[0]
        out = [[] for _ in range(8)]
        for r, u, pos, nxt, sym, cov, depth in _chains(b):
            i = np.arange(len(pos))
            typ = depth % 3
            rank = np.zeros(len(pos), np.int64)
            sampled = np.abs(names[off[r]:off[r + 1]])
            sampled[places[offp[r]:offp[r + 1]]] = ranks[offp[r]:offp[r + 1]]
            rank[typ != 0] = sampled
            j = _step(nxt, i)
            k = _step(nxt, j)
            for o, v in zip(out, (np.full(len(i), u, np.int64), i.astype(np.int32), typ.astype(np.int32), sym,
                                  _pick(sym, j), _pick(rank, j), _pick(rank, k), rank)):
                o.append(v)
        if out[0]:
            yield _batch(out, ["uid", "i", "typ", "s0", "s1", "r1", "r2", "r"])


def _gathered(rows: DataFrame, value: str, out: str) -> DataFrame:
    """One array of ``value`` for each document, in the order of ``i``."""
    packed = rows.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("i", value))).alias("_a"))
    return packed.select("uid", F.transform("_a", lambda x: x[value]).alias(out))


def _dense(rows: DataFrame, rank: str) -> DataFrame:
    """``rows`` with the row numbers ``rank`` (partition, row in it) made gapless; one count for each partition is collected."""
    part = F.shiftright(rank, 33)
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, carry = 0, []
    for p, n in counts:
        carry.append((p, before - (p << 33)))
        before += n
    prior = rows.sparkSession.createDataFrame(carry or [(-1, 0)], "_p long, _carry long")
    return (rows.withColumn("_p", part).join(F.broadcast(prior), "_p").withColumn(rank, F.col(rank) + F.col("_carry"))
            .drop("_p", "_carry"))


def suffix_order(level: DataFrame, length: int, tag: str = "sa", depth: int = 0) -> DataFrame:
    """(uid, i, rank): all suffixes of the symbol chains of ``level`` in sorted order.

    The order is right up to the first ``length`` bytes, which is what adjacent
    suffixes are compared by; beyond that ties keep the order they happen to have.
    """
    name = f"{tag}{depth}"
    triples = level.mapInArrow(_triples, "uid bigint, i int, t0 bigint, t1 bigint, t2 bigint, cov int")
    t = ["t0", "t1", "t2"]
    # a name is 1 + the number of sampled suffixes of smaller names
    names = running_sum(triples.groupBy(*t).agg(F.count("*").alias("n"), F.min("cov").alias("cov")), t, "n", "before",
                        f"{name}-names")
    is_open = (F.col("n") > 1) & (F.col("cov") < length)
    names_of = names.select(*t, F.when(is_open, -1 - F.col("before")).otherwise(1 + F.col("before")).alias("name"))
    empty = F.array().cast("array<bigint>")
    named = stage(level.join(_gathered(triples.select("uid", "i", *t).join(names_of, t), "name", "names"), "uid", "left")
                  .withColumn("names", F.coalesce("names", empty)), f"{name}-named")
    done = [named]
    if names.filter(is_open).isEmpty():
        placed = named.withColumn("places", F.array().cast("array<int>")).withColumn("ranks", empty)
        release(names)
    else:
        release(names)
        sample = stage(named.mapInArrow(_shrink, _LEVEL + ", place array<int>, open array<boolean>"), f"{name}-sample")
        deeper = suffix_order(sample.drop("place", "open"), length, tag, depth + 1)
        refined = (sample.select("uid", F.posexplode(F.arrays_zip("sym", "place", "open")).alias("i", "x")).filter("x.open")
                   .select("uid", "i", F.col("x.sym").alias("sym"), F.col("x.place").alias("place"))
                   .join(_dense(deeper, "rank"), ["uid", "i"]))
        refined = stage(refined.select("uid", "sym", "place", "rank"), f"{name}-refined")
        release(sample, deeper)
        # suffixes of one name are neighbours in the deeper order: their places there count on from the name
        low = refined.groupBy("sym").agg(F.min("rank").alias("low"))
        over = (refined.join(low, "sym").groupBy("uid")
                .agg(F.sort_array(F.collect_list(F.struct("place", (F.col("sym") + F.col("rank") - F.col("low")).alias("rank")))).alias("o")))
        placed = named.join(over, "uid", "left").select(
            *named.columns, F.coalesce("o.place", F.array().cast("array<int>")).alias("places"),
            F.coalesce("o.rank", empty).alias("ranks"))
        done.append(refined)
    rows = stage(placed.mapInArrow(_merge_rows, "uid bigint, i int, typ int, s0 bigint, s1 bigint, r1 bigint, r2 bigint, "
                                   "r bigint"), f"{name}-rows")
    release(*done)
    # the last sampled suffix before each remaining one: among class 2 and among class 1
    a = running_max(rows.filter("typ <> 1").select("uid", "i", "typ", "s0", "r1", F.when(F.col("typ") == 2, F.col("r")).alias("r")),
                    ["s0", "r1"], "r", "top", f"{name}-a")
    b = running_max(rows.filter("typ <> 2").select("uid", "i", "typ", "s0", "s1", "r2", F.when(F.col("typ") == 1, F.col("r")).alias("r")),
                    ["s0", "s1", "r2"], "r", "top", f"{name}-b")
    rest = (a.filter("typ = 0").select("uid", "i", "s0", "r1", "top")
            .join(b.filter("typ = 0").select("uid", "i", F.col("top").alias("top1")), ["uid", "i"])
            .select("uid", "i", F.greatest("top", "top1").alias("r"), F.lit(1).alias("late"), "s0", "r1"))
    every = (rows.filter("typ <> 0").select("uid", "i", "r", F.lit(0).alias("late"), F.lit(0).cast("bigint").alias("s0"),
                                            F.lit(0).cast("bigint").alias("r1")).union(rest))
    key = ["r", "late", "s0", "r1"]
    out = stage(every.repartitionByRange(*key).sortWithinPartitions(*key)
                .select("uid", "i", (F.monotonically_increasing_id() + 1).alias("rank")), f"{name}-order")
    release(rows, a, b)
    return out


def _adjacent(batches):
    """Sorted (rank, uid, at, f): suffixes whose ``f`` equals the neighbour's; the first and last row of the task as well.

    kind 0: repeated, 1: first row of the task, 2: last row.
    """
    pid, last = partition_id(), None
    held, flag = None, False
    for b in batches:
        if not b.num_rows:
            continue
        f = b.column("f").to_numpy(zero_copy_only=False)
        uid = b.column("uid").to_numpy(zero_copy_only=False)
        at = b.column("at").to_numpy(zero_copy_only=False)
        same = (f[1:] == f[:-1])
        hit = np.zeros(len(f), bool)
        hit[1:] |= same
        hit[:-1] |= same
        rows = [(0, uid[hit], at[hit], f[hit])]
        if held is None:
            rows.append((1, uid[:1], at[:1], f[:1]))
        elif held[2] == f[0]:
            rows.append((0, uid[:1], at[:1], f[:1]))
            rows.append((0, np.array([held[0]]), np.array([held[1]], np.int32), np.array([held[2]])))
        held = (uid[-1], at[-1], f[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows])),
             pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)),
             pa.array(np.concatenate([r[3] for r in rows])),
             pa.array(np.full(sum(len(r[1]) for r in rows), pid, np.int32))], names=["kind", "uid", "at", "f", "pid"])
    if held is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int32()), pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()),
             pa.array([held[2]], pa.int64()), pa.array([pid], pa.int32())], names=["kind", "uid", "at", "f", "pid"])


def repeated_anchors(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """(uid, at): anchors whose first ``length`` bytes equal those of an adjacent suffix."""
    spark = nodes.sparkSession
    flatn = nodes.select("uid", F.posexplode(F.arrays_zip("pos", "f400")).alias("i", "x")).select(
        "uid", "i", F.col("x.pos").alias("at"), F.col("x.f400").alias("f"))
    rows = (order.join(flatn.filter("f <> 0"), ["uid", "i"]).select("rank", "uid", "at", "f"))
    found = stage(rows.repartitionByRange("rank").sortWithinPartitions("rank")
                  .mapInArrow(_adjacent, "kind int, uid bigint, at int, f bigint, pid int"), "sa-adjacent")
    ends = sorted(((r["pid"], r["kind"], r["uid"], r["at"], r["f"]) for r in found.filter("kind > 0").collect()))
    more = set()
    for x, y in zip(ends, ends[1:]):  # the last row of a task and the first of the next one with rows
        if x[1] == 2 and y[1] == 1 and x[4] == y[4]:
            more |= {x[2:4], y[2:4]}
    hits = found.filter("kind = 0").select("uid", "at")
    if more:
        hits = hits.union(spark.createDataFrame(sorted(more), "uid bigint, at int"))
    return hits.distinct()


def _starts(texts: _Joined, kept: np.ndarray, length: int, window: int):
    """Candidate starts and their anchors: those whose anchor prefix occurs again."""
    at = anchors(texts.buf, window)
    good = np.zeros(len(texts.buf) + 1, bool)
    good[kept] = True
    p = np.flatnonzero(good[at] & texts.inside(length, len(at)))
    return p, at[p]


def _mask_names(window: int) -> list[str]:
    """Columns of 64-bit masks, a bit for each distance below ``window``."""
    return [f"m{k}" for k in range(window // 64)]


def _open_masks(length: int, window: int):
    """(uid, text, kept, full) -> (f, m0, m1, ...): distances to the anchor at which some string isn't covered yet."""
    keep = length - window + 1
    names = _mask_names(window)

    def scan(batches):
        for b in batches:
            kept, off = flat(b.column(2))
            full, offf = flat(b.column(3))
            cols = [[] for _ in range(1 + len(names))]
            for t in _joined(b.column(1).to_pylist()):
                p, a = _starts(t, t.places(kept, off), length, window)
                cov = t.covered(t.places(full, offf), length)
                miss = np.concatenate([[0], np.cumsum(~cov)])
                need = miss[p + length] > miss[p]
                p, a = p[need], a[need]
                if not len(p):
                    continue
                d = (a - p).astype(np.uint64)
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                bit, word = np.uint64(1) << (d & np.uint64(63)), d >> np.uint64(6)
                cols[0].append(WindowHash(t.buf).at(a[first], keep).view(np.int64))
                for k in range(len(names)):
                    mask = np.where(word == k, bit, np.uint64(0))
                    cols[1 + k].append(np.bitwise_or.reduceat(mask, first).view(np.int64))
            if cols[0]:
                yield _batch(cols, ["f", *names])
    return scan


def _open_strings(length: int, window: int):
    """(part, text, at[], masks[]...) -> (part, h): hash of every string at an asked distance; twice at most for each part of a batch."""

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0).to_numpy(zero_copy_only=False)
            at, off = flat(b.column(2))
            masks = [flat(b.column(3 + k))[0] for k in range(window // 64)]
            texts = b.column(1).to_pylist()
            order = np.argsort(part, kind="stable")
            cols, held = [[], []], 0
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                hs = []
                for t in _joined(texts, rows):
                    hs.append(WindowHash(t.buf).at(_asked(t, at, off, masks, length, window), length).view(np.int64))
                v, n = np.unique(np.concatenate(hs), return_counts=True)
                v = np.repeat(v, np.minimum(n, 2))
                cols[0].append(np.full(len(v), part[rows[0]], np.int32))
                cols[1].append(v)
                held += len(v)
                if held >= 1 << 18:
                    yield _batch(cols, ["part", "h"])
                    cols, held = [[], []], 0
            if held:
                yield _batch(cols, ["part", "h"])
    return scan


def _asked(texts: _Joined, at, off, masks, length, window):
    """Starts p = anchor - d for every asked d, where the anchor of p is that one; ``at`` and ``masks`` of all rows."""
    mine = texts.places(at, off)
    if not len(mine):
        return np.zeros(0, np.int64)
    masks = [np.concatenate([m[off[r]:off[r + 1]] for r in texts.rows.tolist()]) for m in masks]
    bits = np.unpackbits(np.stack(masks, 1).view(np.uint8), axis=1, bitorder="little")
    r, d = np.nonzero(bits)
    of = texts.text_of(mine)
    p, a = mine[r] - d, mine[r]
    ok = (p >= texts.start[of][r]) & (p + length <= texts.end[of][r])
    p, a = p[ok], a[ok]
    return np.sort(p[anchors(texts.buf, window)[p] == a])


def _spans(length: int, window: int):
    """A group of documents and the strings found twice among its open ones -> maximal removed runs."""

    def join(docs: pa.Table, twice: pa.Table) -> pa.Table:
        at, off = flat(docs.column("at"))
        masks = [flat(docs.column(m))[0] for m in _mask_names(window)]
        full, offf = flat(docs.column("full"))
        texts = docs.column("raw").to_pylist()
        again = np.unique(twice.column("h").to_numpy())
        st, ln, n = [], [], []
        for t in _joined(texts):
            p = _asked(t, at, off, masks, length, window)
            if len(again):
                h = WindowHash(t.buf).at(p, length).view(np.int64)
                p = p[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h]
            else:
                p = p[:0]
            cov = np.zeros(len(t.buf) + len(t.rows) + 1, np.int8)  # a gap before each text ends the runs
            cov[np.arange(len(t.buf)) + np.repeat(np.arange(1, len(t.rows) + 1), t.end - t.start)] = t.covered(
                np.concatenate([p, t.places(full, offf)]), length)
            edge = np.flatnonzero(np.diff(cov, append=np.int8(0))) + 1
            begin, size = edge[::2], edge[1::2] - edge[::2]
            of = np.searchsorted(t.start + np.arange(1, len(t.rows) + 1), begin, "right") - 1
            st.append((begin - of - 1 - t.start[of]).astype(np.int32))
            ln.append(size.astype(np.int32))
            n += np.bincount(of, minlength=len(t.rows)).tolist()
        none = [np.zeros(0, np.int32)]
        out = pa.table({"uid": docs.column("uid").combine_chunks(), "starts": list_array(np.concatenate(st + none), n, pa.int32()),
                        "lengths": list_array(np.concatenate(ln + none), n, pa.int32())})
        return out.filter(pa.compute.invert(docs.column("copied")))
    return join


def repeated_spans(docs: DataFrame, length: int = 400, window: int = 256, part_docs: int = 256) -> DataFrame:
    """(uid, starts array<int>, lengths array<int>) of documents with repeats; docs: (uid, raw binary).

    ``uid`` numbers the rows; documents without repeats have no row.
    """
    if window % 64 or length < window + GRAM:
        raise ValueError("window is a multiple of 64 (64-bit masks hold the distances), length at least window + 8")
    masks = _mask_names(window)
    # texts that occur again as a whole: all of each is covered, one stands for them all
    print_of = ["size", "x", "c"]
    texts = stage(docs.filter(F.length("raw") >= length).select(
        "uid", F.length("raw").alias("size"), F.xxhash64("raw").alias("x"), F.crc32("raw").alias("c")), "sa-texts")
    classes = stage(texts.groupBy(*print_of).agg(F.min("uid").alias("uid"), (F.count("*") > 1).alias("copied")), "sa-classes")
    prints = stage(docs.select("uid", "raw").filter(F.length("raw") >= length).mapInArrow(
        _anchor_prints(length, window), "f bigint, uid bigint, at int"), "sa-prints")
    again = prints.groupBy("f").count().filter("count > 1").select("f")
    kept = prints.join(again, "f", "left_semi").groupBy("uid").agg(F.sort_array(F.collect_set("at")).alias("kept"))
    kept = stage(kept.join(classes.select("uid", "copied"), "uid"), "sa-kept")
    release(prints)
    cand = stage(docs.select("uid", "raw").join(kept, "uid"), "sa-candidates", "zstd")
    release(kept)

    symbols = cand.mapInArrow(_symbol_rows(length, window), "sh bigint, s binary").groupBy("sh").agg(F.first("s").alias("s"))
    names = stage(symbols.repartitionByRange("s").sortWithinPartitions("s")
                  .select("sh", (F.monotonically_increasing_id() + 1).alias("name")), "sa-symbols")
    nodes = stage(cand.mapInArrow(_node_rows(length, window), _LEVEL + ", f400 array<bigint>"), "sa-nodes")
    sym = _gathered(nodes.select("uid", F.posexplode("sym").alias("i", "sh")).join(names, "sh"), "name", "names")
    level = stage(nodes.join(sym, "uid").select("uid", "pos", "nxt", F.col("names").alias("sym"), "cov"), "sa-level")
    release(names)
    order = suffix_order(level, length)
    release(level)
    full = repeated_anchors(nodes, order)
    full = stage(full.groupBy("uid").agg(F.sort_array(F.collect_list("at")).alias("full")), "sa-full")
    release(nodes, order)

    none = F.array().cast("array<int>")
    both = cand.join(full, "uid", "left").withColumn("full", F.coalesce("full", none))
    asked = (both.filter("not copied").select("uid", "raw", "kept", "full").mapInArrow(_open_masks(length, window), "f bigint, " + ", ".join(f"{m} bigint" for m in masks))
             .groupBy("f").agg(*(F.bit_or(m).alias(m) for m in masks)))
    per_doc = (cand.mapInArrow(_kept_prints(length, window), "f bigint, uid bigint, at int").join(asked, "f").groupBy("uid")
               .agg(F.sort_array(F.collect_list(F.struct("at", *masks))).alias("m")))
    part = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)).cast("int")
    n_parts = max(1, cand.count() // part_docs)
    work = stage(both.join(per_doc, "uid", "left")
                 .select("uid", "raw", "copied", (part % n_parts).alias("part"), "full",
                         *(F.coalesce(F.col(f"m.{c}"), F.array().cast(t)).alias(c)
                           for c, t in (("at", "array<int>"), *((m, "array<bigint>") for m in masks)))),
                 "sa-work", "zstd")
    release(cand, full)
    # a string's rows are one for each batch and part that holds it, two if it holds it more than once
    strings = work.select("part", "raw", "at", *masks).mapInArrow(_open_strings(length, window), "part int, h bigint")
    twice = strings.withColumn("all", F.count("*").over(Window.partitionBy("h"))).filter("all > 1")
    out = work.groupBy("part").cogroup(twice.select("part", "h").groupBy("part")).applyInArrow(
        _spans(length, window), "uid bigint, starts array<int>, lengths array<int>")
    whole = texts.join(classes.filter("copied").select(*print_of), print_of, "left_semi").select(
        "uid", F.array(F.lit(0)).alias("starts"), F.array("size").alias("lengths"))
    out = stage(out.filter(F.size("starts") > 0).union(whole), "sa-spans")
    release(work, texts, classes)
    return out


def _cut(batches):
    """(..., raw, starts, lengths) -> digest of what is left and the text itself."""
    for b in batches:
        raw = b.column("raw").to_pylist()
        st, off = flat(b.column("starts"))
        ln, _ = flat(b.column("lengths"))
        left, removed = [], []
        for i, t in enumerate(raw):
            out, at = [], 0
            for s, n in zip(st[off[i]:off[i + 1]].tolist(), ln[off[i]:off[i + 1]].tolist()):
                out.append(t[at:s])
                at = s + n
            out.append(t[at:])
            left.append(b"".join(out))
            removed.append(len(t) - len(left[-1]))
        cols = [c for n, c in zip(b.schema.names, b.columns) if n not in ("raw", "starts", "lengths")]
        names = [n for n in b.schema.names if n not in ("raw", "starts", "lengths")]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array([len(t) for t in raw], pa.int64()), pa.array(removed, pa.int64()),
             pa.array(np.diff(off), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in left]),
             pa.array([t.decode("utf-8", "ignore") for t in left])],
            names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   words: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_text), one row for each row of ``docs``.

    ``kept_text`` decodes the remaining bytes; a character cut in the middle is dropped from it
    (``kept_sha256`` is over all remaining bytes). With ``words``, passages of that many words go as well.
    """
    base = with_uid(docs.select(F.col(id_col).alias("id"),
                                F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw")))
    spans = repeated_spans(base.select("uid", "raw"), length)
    if words:
        spans = united(spans, repeated_passages(base.select("uid", "raw"), words))
    none = F.array().cast("array<int>")
    joined = base.join(spans, "uid", "left").select(
        "uid", "id", "raw", F.coalesce("starts", none).alias("starts"), F.coalesce("lengths", none).alias("lengths"))
    typ = dict(base.dtypes)["id"]
    return joined.mapInArrow(_cut, f"uid bigint, id {typ}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                             "kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
