"""Near-duplicate vectors against brute force: a hot cluster beside sparse pairs, null ids, clashing columns."""

import numpy as np
from pyspark.sql import functions as F

from evalcube.llm import hnsw
from evalcube.llm.common import stage


def _expected(ids, vecs, threshold=0.95):
    x = np.asarray(vecs, np.float32).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    link = x @ x.T / norm[:, None] / norm >= threshold
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(link, low, len(x)).min(1))
        if (new == low).all():
            return {i: (int(n), ids[c]) for i, n, c in zip(ids, link.sum(1), low.tolist())}
        low = new


def test_every_link_counts_for_both_vectors(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=32)
    hot = centre + rng.normal(size=(1500, 32)) * 0.16  # cosines on both sides of the threshold
    base = rng.normal(size=(1500, 32))
    vecs = np.concatenate([hot, base, base + rng.normal(size=base.shape) * rng.choice([0.1, 0.25, 0.33], size=(1500, 1))])
    vecs = vecs[rng.permutation(len(vecs))].astype(np.float32)
    want = _expected(list(range(len(vecs))), vecs)
    df = stage(spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vecs)],
                                     "vec_id bigint, embedding array<float>, uid string, n int"), "hot-vectors").repartition(7)
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.vector_groups(stage(df, "hot-dealt")).collect()}
    off = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert sum(n for n, _ in got.values()) % 2 == 0
    assert not off


def test_null_ids_and_columns_named_alike(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, "a"), (None, v, "b"), (4, v, "c"), (4, [2.0, 4.0, 6.1], "d"), (7, [3.0, -2.0, 0.1], "e"), (None, None, "f")]
    df = stage(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component_id string"), "null-ids")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1) for r in hnsw.vector_groups(df).collect()))
    assert got == [(-1, 0, -1), (-1, 3, 4), (-1, 3, 4), (4, 3, 4), (4, 3, 4), (7, 0, 7)]


def test_small_shards_give_the_same(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vecs = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2]).astype(np.float32)
    df = stage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "vec_id bigint, embedding array<float>"), "small-shards")
    want = _expected(list(range(len(vecs))), vecs)
    for shards, rows in ((1, 1_000), (3, 1_000), (1, 9)):
        out = hnsw.vector_groups(df, min_shards=shards, shard_rows=rows).filter(F.col("vec_id").isNotNull()).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want


def test_beams_stay_bounded_in_a_large_cluster(monkeypatch):
    """Queries with more links than the widest beam are compared with the whole shard; no beam grows with the cluster."""
    rng = np.random.default_rng(4)
    vecs = np.concatenate([rng.normal(size=64) + rng.normal(size=(700, 64)) * 0.1, rng.normal(size=(500, 64))])
    vecs = vecs[rng.permutation(len(vecs))].astype(np.float32)
    graph, asked, search = hnsw.Graph(vecs, np.arange(len(vecs))), [], hnsw.Layer.search

    def counted(self, q, entry, beam, limit):
        asked.append(beam)
        return search(self, q, entry, beam, limit)
    monkeypatch.setattr(hnsw.Layer, "search", counted)
    bits = hnsw._found(graph, vecs, vecs, True, 0.95, 0.99, 256)
    unit = vecs.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    assert max(asked) < 200 and link.sum(1).max() > 600
    assert (np.unpackbits(bits, axis=1, count=len(vecs)).astype(bool) == link).all()
