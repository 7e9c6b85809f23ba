"""Importance resampling, conversation repair and slot sharding against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalcube.llm import conversation_repair as CR
from evalcube.llm import resampling as IR
from evalcube.llm import sharding as SH
from evalcube.llm.common import stage

DOCS = "doc_id bigint, text string, uid string, rank int, shard int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcABCéß9") for _ in range(rng.randrange(1, 40 if rng.random() < 0.1 else 8)))
    text = lambda n: rng.choice([" ", "-", "\n"]).join(word() for _ in range(n))
    out = [(1, None), (2, ""), (3, " .\n"), (None, text(30)), (None, text(30)), (4, "one"), (5, text(9000))]
    out += [(6, out[3][1])] * 3 + [(10 + i, text(rng.randrange(1, 60))) for i in range(150)]
    return [(*r, "clash", 1, 2) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stage(spark.createDataFrame(rows, DOCS).repartition(3), "test-docs3")


@pytest.fixture(scope="module")
def empty(spark):
    return stage(spark.createDataFrame([], DOCS), "test-empty3")


def _grams(text, lo, hi):
    w = TERM.findall(_lower(text or ""))
    return [" ".join(w[i:i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("lo,hi,slab", [(1, 1, 1 << 22), (1, 3, 1 << 22), (2, 2, 700)])
def test_resampling_equals_brute_force(spark, docs, rows, lo, hi, slab, monkeypatch):
    target = stage(spark.createDataFrame([(1, None), (2, rows[20][1]), (3, rows[20][1]), (4, rows[6][1][:900])], "item_id int, text string"), "t3")
    if slab < 1 << 20:  # long texts in many slabs: the features must be the same
        texts = [(r[1] or "").encode() for r in rows]
        monkeypatch.setattr(IR, "_slabs", lambda t, size=slab, real=IR._slabs: real(t, size))
        seen = [Counter() for _ in texts]
        words = np.zeros(len(texts), int)
        for buf, start, length, owner, own, n in IR._features(texts, lo, hi):
            np.add.at(words, own, n)
            for a, k, o in zip(start, length, owner):
                seen[o][buf[a:a + k].tobytes().decode()] += 1
        for r, got, n in zip(rows, seen, words):
            grams, m = _grams(r[1], lo, hi)
            assert got == Counter(grams) and n == m
        return
    buckets = 500
    got = IR.importance_resample(docs, target, min_n=lo, max_n=hi, buckets=buckets, percent=30).collect()
    s, t = Counter(), Counter()
    for r in rows:
        s.update(zlib.crc32(g.encode()) % buckets for g in _grams(r[1], lo, hi)[0])
    for r in target.collect():
        t.update(zlib.crc32(g.encode()) % buckets for g in _grams(r.text, lo, hi)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    want = []
    for r in rows:
        grams, n = _grams(r[1], lo, hi)
        w = sum(gain(zlib.crc32(g.encode()) % buckets) for g in grams)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        want.append((r[0], n, len(grams), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert Counter((g.doc_id, g.n_words, g.n_features, g.weight, g.score) for g in got) == Counter(want)
    able = sorted((-x[4], x[0] is None, x[0] or 0) for x in want if x[1] >= 20)
    drawn = sorted((g.rank, g.score, g.doc_id) for g in got if g.rank)
    assert [(-a, None if none else i) for a, none, i in able[:30 * len(able) // 100]] == [(x[1], x[2]) for x in drawn]
    assert [x[0] for x in drawn] == list(range(1, len(drawn) + 1))


def test_resampling_of_empty_tables(spark, docs, empty):
    assert IR.importance_resample(empty, docs).count() == 0
    out = IR.importance_resample(docs, empty).collect()
    assert len(out) == docs.count()


def test_hash_is_xxhash64_and_bytes_decide():
    words = [b"", b"a", b"abc", b"abcd", b"abcdefgh", b"abcdefghi" * 3, b"x" * 31, b"x" * 32, b"x" * 500]
    buf = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    assert [int(h) for h in IR.xxhash64_spans(buf, start, length)] == [xxhash.xxh64_intdigest(w) for w in words]
    # equal keys for all words: only the bytes tell them apart
    text = b"abcdefghX abcdefghY abcdefghX a " + bytes(8)
    buf = np.frombuffer(text, np.uint8)
    start, length = np.array([0, 10, 20, 30]), np.array([9, 9, 9, 1])
    table = IR.InternTable(buf, start, length, 1000, lambda b, s, n: np.zeros(len(s), np.uint64))
    assert table.slot[0] == table.slot[2] and len(set(table.slot.tolist())) == 3
    assert sorted(table.count[table.used].tolist()) == [1, 1, 2]


# ---- conversation repair -------------------------------------------------------------------------------------------


def _brute_repair(turns):
    """Faults, cost, audit and repaired lines of (turn, role, text) rows by Viterbi over whole audits, without targets or blocks."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    n, illegal, seen, kinds = Counter(), 0, set(), []
    for i, (_, role, text) in enumerate(turns):
        core = text.strip(" \t\n\v\f\r")
        kind = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        n[kind] += 1
        kinds.append(kind)
        illegal += i > 0 and turns[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    follow = {"": "us", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}
    for (_, role, text), kind in zip(turns, kinds):
        options = [(s, v) for s, v in ways.items()]
        level = options
        for _ in range(3):
            level = [("u" if s != "u" else "a", (c + 2, a + "I", (*out, names["u" if s != "u" else "a"] + ":"))) for s, (c, a, out) in level]
            options = options + level
        step = {}

        def offer(state, way):
            if state not in step or way[:2] < step[state][:2]:
                step[state] = way
        for s, (c, a, out) in options:
            offer(s, (c + 3, a + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            stay = kind == "truncated"
            for x in follow[s]:
                if x == role[:1]:
                    offer(x, (c + stay, a + "K", (*out, f"{role}:{text}")))
                elif x in names:
                    offer(x, (c + stay + 2, a + "R", (*out, f"{names[x]}:{text}")))
        ways = step
    ends = []
    for s, (c, a, out) in ways.items():
        for x in {"s": "ua", "u": "a"}.get(s, ""):
            c, a, out = c + 2, a + "I", (*out, names[x] + ":")
        ends.append((c, a, out))
    cost, audit, out = min(ends)
    known = [t[0] for t in turns if t[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, "\n".join(out)


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(11)
    out = []
    for conv in [None, *range(60)]:
        n = 400 if conv == 7 else rng.randrange(0, 40) if conv is None or conv % 5 == 0 else rng.randrange(0, 9)
        for i in range(n):
            turn = None if rng.random() < 0.05 else i + (rng.random() < 0.1) * rng.randrange(3)
            role = rng.choice(["user", "assistant", "system", "tool", "", " "]) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
            text = rng.choice(["", " ", "cut", "fine.", "so?", f"t{rng.randrange(4)}.", f"x{i} é!", f"long {i}"])
            out += [(conv, turn, role, text)] * (rng.randrange(1, 4) if rng.random() < 0.1 else 1)
    return out


@pytest.mark.parametrize("parts", [1, 8, 37])
def test_repair_equals_brute_force(spark, chats, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*c, 1) for c in chats], "conv_id bigint, turn bigint, role string, text string, pos int")
        audits, fixed = CR.repair(df)
        got = {r.conv: tuple(r)[1:] for r in audits.collect()}
        lines = {}
        for r in sorted(fixed.collect(), key=lambda r: r.pos):
            assert len(lines.setdefault(r.conv, [])) == r.pos
            lines[r.conv].append(f"{r.role}:{r.text}")
        sums = {r.conv: r.repaired_sha256 for r in CR.digests(fixed).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    by = {}
    for conv, turn, role, text in chats:
        by.setdefault(conv, []).append((turn, role, text))
    assert set(got) == set(by)
    for conv, turns in by.items():
        want = _brute_repair(turns)
        assert got[conv] == want[:7], conv
        assert "\n".join(lines.get(conv, [])) == want[7]
        assert sums.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(want[7].encode()).hexdigest()
        roles = "".join(x[:1] for x in lines.get(conv, []))
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_a_block_against_every_target():
    rng = random.Random(2)
    for _ in range(300):
        turns = [(rng.choice("suax"), rng.choice([0, 0, 1, -1])) for _ in range(rng.randrange(1, 7))]
        for entry in range(4):
            got = CR.align_block(turns, entry)
            want = {}
            for m in range(2 * len(turns) + 4):
                for target, out in CR._targets(entry, m):
                    found = CR._align(turns, target, 10 ** 6)  # no band
                    if found and (out not in want or found < want[out]):
                        want[out] = found
            for state, way in got.items():
                assert way == want[state]
            # a state left out can't be on a cheapest way: it costs more than inserts and deletes to get there
            for state in set(want) - set(got):
                assert False, (turns, entry, state)


def test_repair_of_an_empty_table_and_null_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    audits, fixed = CR.repair(none)
    assert audits.count() == 0 and fixed.count() == 0 and CR.digests(fixed).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), ("a", None, None, "x."), ("a", 1, "user", None)],
                                  "conv_id string, turn bigint, role string, text string")
    audits, fixed = CR.repair(nulls)
    got = {r.conv: tuple(r)[1:] for r in audits.collect()}
    assert got[None] == (0, 1, 0, 0, 0, 3, "D")
    assert got["a"] == _brute_repair([(None, " ", "x."), (1, "user", " ")])[:7]
    assert CR.damage(nulls).filter("text IS NULL OR role IS NULL").count() == 0


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_shards_by_slots(spark, docs, rows):
    n_shards, n_slots = 5, 64
    placed, maps, version = SH.shard_rows(docs, n_shards, n_slots)
    got = placed.collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for r in got:
        if r.doc_id is not None:
            h = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42)
            assert r.vslot == h % n_slots if h < 1 << 63 else r.vslot == (h - (1 << 64)) % n_slots
    for s in range(n_shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    total = [sum(r.size for r in got if r.shard == s) for s in range(n_shards)]
    big = max(r.size for r in got)
    assert max(total) <= max(big, sum(total) / n_shards * 1.05 + 1)
    # all rows of a (sub-)slot are in the shard that the stored map names
    entries = maps.entries(version)
    assert version == 1 and all(entries[(r.vslot, r.sub)] == r.shard for r in got)
    assert maps.entries(0) == SH.initial_map(n_slots, n_shards)


def test_rebalancing_edits_the_map():
    rng = random.Random(4)
    loads = {(s, 0): int(rng.lognormvariate(8, 1)) for s in range(4096)}
    old = SH.initial_map(4096, 16)
    new = SH.rebalance(old, loads, 16)
    per = lambda m: [sum(b for k, b in loads.items() if m[k] == s) for s in range(16)]
    mean = sum(loads.values()) / 16
    assert max(per(new)) - min(per(new)) < 0.001 * mean < max(per(old)) - min(per(old))
    moved = sum(new[k] != old[k] for k in new)
    assert moved < 400
    # balanced already: the next version is the same; one slot grows: few slots move
    assert SH.rebalance(new, loads, 16) == new
    grown = loads | {(5, 0): loads[(5, 0)] + int(mean / 4)}
    assert sum(SH.rebalance(new, grown, 16)[k] != new[k] for k in new) < 200


def test_a_hot_id_is_dealt_over_sub_slots(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id")).alias("doc_id"),
                                    F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    docs = stage(rows, "test-hot3")
    placed, maps, version = SH.shard_rows(docs, 4, 256)
    per = [r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(per) == 4 and max(per) - min(per) < 0.02 * sum(per) / 4
    assert placed.filter("doc_id = 77").select("sub").distinct().count() > 4
    again, _, later = SH.shard_rows(docs, 4, 256, maps=maps, version=version)
    assert later == version + 1
    same = again.select("uid", "shard").join(placed.select("uid", F.col("shard").alias("s")), "uid").filter("shard = s").count()
    assert same == 4000


def test_sharding_of_empty_tables_and_writing(spark, docs, empty, rows, tmp_path):
    placed, maps, version = SH.shard_rows(empty)
    assert placed.count() == 0 and version == 0
    placed, _, _ = SH.shard_rows(docs, 3, 32)
    back = SH.write_shards(docs, placed, str(tmp_path / "shards"))
    assert set(back.columns) == {"doc_id", "text", "uid", "rank", "shard", "shard_"}
    assert Counter((r.doc_id, r.text, r.uid, r.shard) for r in back.collect()) == Counter((r[0], r[1], r[2], r[4]) for r in rows)
