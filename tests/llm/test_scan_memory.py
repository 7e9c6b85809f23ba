"""Scans hold little at once: hash tables as large as the texts ask, buffers of 64 kB, a string twice at most for each part."""

import numpy as np
import pyarrow as pa

from evalcube.llm import bytescan, common, ngram_join, shingles, suffix_dedup
from evalcube.llm.common import list_array


def test_tables_and_buffers_follow_the_texts(monkeypatch):
    monkeypatch.setattr(bytescan, "_tables", {})
    text = b"some words of a short text " * 40
    small = bytescan.WindowHash(np.frombuffer(text, np.uint8)).at(np.arange(27), 27)
    assert len(bytescan._tables[0][0]) <= 1 << 17
    long = np.frombuffer(text * 400, np.uint8)
    assert (bytescan.WindowHash(long).at(np.arange(27), 27) == small).all()
    assert max(sum(map(len, part)) for _, part in shingles.buffers([text] * 2000)) < 1 << 17
    assert [t for _, part in shingles.buffers([text] * 2000) for t in part] == [text] * 2000


def test_strings_of_a_batch_by_part():
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 123, 1500, dtype=np.uint8))
    texts = [shared, bytes(rng.integers(97, 123, 900, dtype=np.uint8)), shared, shared, shared]
    parts = [5, 2, 5, 5, 2]
    at = [np.unique(suffix_dedup.anchors(np.frombuffer(t, np.uint8), 256)).astype(np.int32) for t in texts]
    n = [len(a) for a in at]
    every = [list_array(np.full(sum(n), -1, np.int64), n, pa.int64()) for _ in range(4)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(texts, pa.binary()), list_array(np.concatenate(at), n, pa.int32()), *every],
        names=["part", "raw", "at", "m0", "m1", "m2", "m3"])
    out = list(suffix_dedup._open_strings(400, 256)(iter([batch.slice(0, 0), batch])))
    assert len(out) == 1 and out[0].schema.names == ["part", "h"]
    got = {}
    for p, h in zip(out[0].column(0).to_pylist(), out[0].column(1).to_pylist()):
        got[p, h] = got.get((p, h), 0) + 1
    assert sorted(got.values()) == [1] * (1101 + 501) + [2] * 1101
    assert {p for (p, _), k in got.items() if k == 2} == {5}


def test_join_lets_go_of_what_other_scans_keep():
    assert common.held("large", lambda: [1]) is common.held("large", lambda: [2])
    text = " ".join(f"w{i}" for i in range(30)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text], pa.binary()), pa.array([1])], names=["uid", "raw", "id"])
    list(ngram_join._signatures(5, 80)(iter([batch])))
    assert common.held("large", lambda: [2]) == [2]
    common.let_go()


def test_tables_of_long_buffers_go_with_their_task(monkeypatch):
    monkeypatch.setattr(bytescan, "_tables", {})
    long = np.frombuffer(b"some words of a long text " * 20_000, np.uint8)
    before = bytescan.WindowHash(long).at(np.arange(9), 300_000)
    common.give_back_memory()
    assert not bytescan._tables
    assert (bytescan.WindowHash(long).at(np.arange(9), 300_000) == before).all()


def test_tokens_are_sent_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "SENT", 100)
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 62, n) for n in (130, 0, 250)]
    batch = pa.RecordBatch.from_arrays([pa.array([3, 4, 5]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["uid", "tokens"])
    out = list(ngram_join._explode_tokens_of("uid", "tokens")(iter([batch])))
    assert max(b.num_rows for b in out) == 100
    got = pa.Table.from_batches(out)
    assert got.column("h").to_pylist() == [x for s in sets for x in s.tolist()]
    assert got.column("uid").to_pylist() == [3] * 130 + [5] * 250


def test_short_texts_share_a_scan():
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 123, 1200, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) + shared[:k] for n, k in zip(rng.integers(401, 3000, 40), range(0, 1200, 30))]
    kept = [np.unique(suffix_dedup.anchors(np.frombuffer(t, np.uint8), 256)[:len(t) - 399])[::2].astype(np.int32) for t in texts]

    def batch(rows):
        n = [len(kept[i]) for i in rows]
        full = [kept[i][::3] for i in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array([texts[i] for i in rows], pa.binary()),
             list_array(np.concatenate([kept[i] for i in rows]), n, pa.int32()),
             list_array(np.concatenate(full), [len(x) for x in full], pa.int32())], names=["uid", "raw", "kept", "full"])

    every, alone = batch(list(range(40))), [batch([i]) for i in range(40)]

    def rows(scan, batches, *columns):
        return pa.Table.from_batches(list(scan(iter([b.select(["uid", "raw", "kept", *columns]) for b in batches])))).to_pylist()

    # as one by one, whatever stands beside a text
    assert rows(suffix_dedup._node_rows(400, 256), [every]) == rows(suffix_dedup._node_rows(400, 256), alone)
    assert rows(suffix_dedup._kept_prints(400, 256), [every]) == rows(suffix_dedup._kept_prints(400, 256), alone)
    assert rows(suffix_dedup._open_masks(400, 256), [every], "full") == rows(suffix_dedup._open_masks(400, 256), alone, "full")
    symbols = suffix_dedup._symbol_rows(400, 256)
    assert {tuple(r.values()) for r in rows(symbols, [every])} == {tuple(r.values()) for r in rows(symbols, alone)}
    assert len(list(symbols(iter([every.select(["uid", "raw", "kept"])])))) <= 2
