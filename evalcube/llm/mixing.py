"""Mixing sources to target weights through index permutations of fixed-length blocks.

1. The words of each source, documents in order of id, are one stream cut into
   blocks of ``block`` words; where a document lies in it comes from a running
   sum over a range-sorted table.
2. Targets: the sources share the total by weight; none gets more than
   ``max_repeats`` times its size, the excess is shared again by weight until
   none is above (each round is one aggregate over the sources).
3. A source's target is a number of block slots: whole passes over its blocks
   and the first slots of one more. The slots fall to the output shards by one
   multinomial draw for each source, which is the draw of source counts for
   each shard given the sources' totals, so totals meet the targets exactly.
4. Slot j of a source is block pi_e(j mod n) of pass e = j div n, where pi_e is a
   keyed Feistel permutation of the n block numbers. Any slot can be computed
   alone, nothing is shuffled to be random, and reruns agree.
5. Slots and documents meet in a join on (source, block).

Defined cases: null or empty text has no words and is not taken; sources are
ordered by code point, null last (null is a source of its own); repeated rows
are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from .common import running_sum, stage, with_uid
from .shingles import buffers, words_of

U = np.uint64


def _sizes(batches):
    for b in batches:
        n = [len(t.split()) if t else 0 for t in b.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("source"), pa.array(n, pa.int64())],
                                         names=["uid", "id", "source", "size"])


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + U(key)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(27))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """pi(index) for a pseudorandom permutation pi of 0 .. n - 1 chosen by ``key``.

    A four-round Feistel network over the next even power of two; values of n or
    more walk on until they fall below n.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        x = (left << U(half)) | right
        out[todo] = x
        todo[todo] = x >= U(n)
    return out.astype(np.int64)


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


_CARRIED = ("blocks", "words", "rest", "slots")


def _shards(n_shards: int, seed: int):
    """Sources -> (src, shard, first, count, ...): one multinomial draw of shard counts for each source."""

    def draw(batches):
        for b in batches:
            for r in b.to_pylist():
                rng = np.random.Generator(np.random.Philox(_key(seed, "shards", r["src"])))
                count = rng.multinomial(r["slots"], np.full(n_shards, 1.0 / n_shards))
                at = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), r["src"], np.int64)), pa.array(at.astype(np.int64)), pa.array(first),
                     pa.array(count[at]), *(pa.array(np.full(len(at), r[c], np.int64)) for c in _CARRIED)],
                    names=["src", "shard", "first", "count", *_CARRIED])
    return draw


def _slots(block: int, seed: int):
    """Slot ranges -> (src, block, shard, slot, pass, take): take = words used from the block's start."""

    def walk(batches):
        for b in batches:
            for r in b.to_pylist():
                slot = np.arange(r["first"], r["first"] + r["count"])
                turn, at = slot // r["blocks"], slot % r["blocks"]
                out = np.empty(len(slot), np.int64)
                for e in np.unique(turn):
                    out[turn == e] = permute(at[turn == e], r["blocks"], _key(seed, "blocks", r["src"], int(e)))
                take = np.minimum(block, r["words"] - out * block)
                if r["rest"]:  # the very last slot gives what the partial pass still lacks
                    take = np.where(slot == r["slots"] - 1, np.minimum(take, (r["rest"] - 1) % block + 1), take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), r["src"], np.int64)), pa.array(out),
                     pa.array(np.full(len(slot), r["shard"], np.int64)), pa.array(slot), pa.array(turn),
                     pa.array(take)], names=["src", "block", "shard", "slot", "pass", "take"])
    return walk


def targets(sizes: DataFrame, weights: int = 3, max_repeats: int = 3) -> DataFrame:
    """(src, source, words, weight, target) of each source, numbered by code point, null last.

    ``sizes``: (source, words). Weights are 1, 2, .. ``weights``, repeating.
    """
    ranked = running_sum(sizes.select("source", "words", F.col("source").isNull().alias("none"), F.lit(1).cast("bigint").alias("one")),
                         ["none", "source"], "one", "src", "mix-sources")
    table = stage(ranked.select("src", "source", "words", (F.col("src") % weights + 1).alias("weight")), "mix-weights")
    total = table.agg(F.sum("words")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("words") * max_repeats
        row = table.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("words") * max_repeats)).alias("full"),
                        F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - (row["full"] or 0)) / row["open"]
    share = F.least(F.col("words") * F.lit(float(max_repeats)), F.col("weight") * F.lit(level))
    return table.withColumn("target", share)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64,
        shard_slots: int = 65536, max_repeats: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, slices) of the mix.

    documents: (uid, id, source, size, source_size, target), one row for each row of ``docs``.
    slices: (uid, shard, slot, pass, first_word, n_words), the words each slot takes from a document.
    """
    base = with_uid(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                F.encode(F.col(text_col), "UTF-8").alias("raw")))
    typ = dict(base.dtypes)["id"]
    sized = stage(base.mapInArrow(_sizes, f"uid bigint, id {typ}, source string, size bigint"), "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("words")), max_repeats=max_repeats)
    # whole passes, words of one more pass, and the slots of both
    plan = stage(plan.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0))
                 .withColumn("rest", F.when(F.col("words") > 0, F.round(F.col("target") - F.col("passes") * F.col("words")))
                             .otherwise(0).cast("bigint"))
                 .withColumn("blocks", F.ceil(F.col("words") / block))
                 .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)), "mix-plan")
    slots = plan.agg(F.sum("slots")).first()[0] or 0
    carried = ", ".join(f"{c} bigint" for c in _CARRIED)
    ranges = plan.filter("slots > 0").select("src", *_CARRIED).mapInArrow(
        _shards(max(1, -(-slots // shard_slots)), seed), f"src bigint, shard bigint, first bigint, count bigint, {carried}")
    # few small rows yield all slots: a number of tasks keeps them from being joined into one
    drawn = ranges.repartition(max(1, -(-slots // (8 * shard_slots))), "src", "shard").mapInArrow(
        _slots(block, seed), "src bigint, block bigint, shard bigint, slot bigint, pass bigint, take bigint")

    # a source's words start where those of the sources before it end: no document is moved to find that out
    starts = running_sum(plan.select("src", "source", "words", "target"), ["src"], "words", "g0", "mix-starts")
    known = stage(starts.select("src", F.col("source").alias("s"), F.col("words").alias("source_size"), "target", "g0"), "mix-known")
    rows = sized.join(broadcast_if_small(known), sized["source"].eqNullSafe(known["s"])).drop("s")
    place = running_sum(rows.filter("size > 0").select("uid", "src", "id", "size", "g0"), ["src", "id", "uid"], "size", "g", "mix-place")
    place = place.withColumn("start", F.col("g") - F.col("g0"))
    cells = place.select("uid", "src", "start", "size", F.explode(F.expr(
        f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    # the planner sees the few rows that the slots are drawn from; without the hint it would broadcast them all
    slices = (cells.join(drawn.hint("merge"), ["src", "block"])
              .select("uid", "shard", "slot", "pass", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words"))
              .filter("n_words > 0"))
    return rows.select("uid", "id", "source", "size", "source_size", "target"), slices


def mixed_documents(docs: DataFrame, slices: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of the mix: for each pass over a document, its row with the words that pass takes, in order.

    ``slices`` are those of ``mix`` over the same ``docs``. Neighbouring blocks join up
    with the text between them; a document taken whole keeps its text unchanged.
    """
    rows = with_uid(docs)
    parts = slices.groupBy("uid", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("parts"))
    joined = rows.join(parts, "uid").withColumn("raw", F.encode(F.col(text_col), "UTF-8"))

    def cut(batches):
        for b in batches:
            texts = b.column("raw").to_pylist()
            spans = b.column("parts").to_pylist()
            out = []
            done = 0
            for _, some in buffers(texts):
                raw, _, start, end, off = words_of(some)
                for k, t in enumerate(some):
                    runs: list[list[int]] = []
                    for p in spans[done]:
                        a, z = p["first_word"], p["first_word"] + p["n_words"]
                        if runs and runs[-1][1] == a:
                            runs[-1][1] = z
                        else:
                            runs.append([a, z])
                    if runs == [[0, off[k + 1] - off[k]]]:
                        out.append(t.decode("utf-8"))
                    else:
                        out.append(b" ".join(raw[start[off[k] + a]:end[off[k] + z - 1]] for a, z in runs).decode("utf-8"))
                    done += 1
            keep = [c for c in b.schema.names if c not in ("raw", "parts", "uid", "pass")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else b.column(c) for c in keep], names=keep)

    kept = [c for c in joined.columns if c not in ("raw", "parts", "uid", "pass")]
    types = dict(joined.dtypes)
    return joined.mapInArrow(cut, ", ".join(f"`{c}` {types[c]}" for c in kept))
