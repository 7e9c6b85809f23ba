"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

1. Equal vectors are one class, which takes part once with its number of copies.
2. Classes are dealt to shards by hash. Each shard builds its graph: layers hold
   ever fewer points, a layer's points are linked to diverse near neighbours
   found by a beam search from the layer above.
3. Every class queries every shard: a task takes two shards and lets each query the
   other's graph. A query's beam is widened while all of it lies above the threshold
   (there may be more), and the beam of all queries is doubled until an audit of some
   of them against every vector of the shard finds the wanted share of each one's links.
   A beam costs with its square, so it stops at WIDEST: queries that need more, as those
   in a cluster of many links do, are compared with every vector of the shard.
4. Links are verified by cosine in double precision. What either side finds is a link
   of both vectors; a task holds its links as a bit matrix.
5. Each task sends on counts and, for each vector, the least of those that its links
   lead to, not the links; components are united from those.

A graph is sent once for each shard, so what is moved grows with vectors times shards.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; repeated
rows link; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stage, with_uid

#: Links kept by a point on each layer, and the beam while building.
DEGREE, BUILD_BEAM = 24, 48
BATCH = 512
#: The widest beam; a query that needs a wider one is compared with all vectors of the shard.
WIDEST = 192


def _levels(keys: np.ndarray) -> np.ndarray:
    """Geometric layer numbers from hashed row numbers."""
    x = (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(u) / np.log(DEGREE)).astype(np.int64)


class Layer:
    """A proximity graph over some rows of ``vecs`` (float32, unit length)."""

    def __init__(self, vecs: np.ndarray, rows: np.ndarray, links: np.ndarray | None = None):
        self.vecs, self.rows = vecs, rows  # links hold places in ``rows``
        self.links = np.full((len(rows), DEGREE), -1, np.int32) if links is None else links

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of each query's beam, best first, over the first ``limit`` points."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("ij,ij->i", q, self.vecs[self.rows[entry]])
        closed = np.zeros((n, beam), bool)
        seen = np.zeros((n, limit), bool)
        seen[np.arange(n), entry] = True
        live = np.arange(n)
        width = max(4, beam // 12)  # points of a beam opened at a time
        while len(live):
            open_sims = np.where(closed[live] | (ids[live] < 0), -np.inf, sims[live])
            k = min(width, beam)
            best = np.argpartition(-open_sims, k - 1, axis=1)[:, :k] if beam > k else np.tile(np.arange(beam), (len(live), 1))
            ok = np.take_along_axis(open_sims, best, 1) > -np.inf
            going = ok.any(1)
            live, best, ok = live[going], best[going], ok[going]
            if not len(live):
                break
            r = np.arange(len(live))[:, None]
            sub = closed[live]
            sub[r, best] |= ok
            closed[live] = sub
            at = np.where(ok, ids[live[:, None], best], -1)
            near = np.where(at[:, :, None] >= 0, self.links[at], -1).reshape(len(live), -1).astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            # a point reached twice in one step counts once
            order = np.argsort(near, axis=1, kind="stable")
            near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            rr, cc = np.nonzero(fresh)
            pts = near[rr, cc]
            seen[live[rr], pts] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[rr, cc] = np.einsum("ij,ij->i", q[live[rr]], self.vecs[self.rows[pts]])
            all_s = np.concatenate([sims[live], got], 1)
            all_i = np.concatenate([ids[live], near], 1)
            all_c = np.concatenate([closed[live], np.zeros(near.shape, bool)], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.where(np.take_along_axis(all_s, top, 1) > -np.inf, np.take_along_axis(all_i, top, 1), -1)
            closed[live] = np.take_along_axis(all_c, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def choose(self, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """DEGREE diverse links of each own vector: a candidate nearer to one already chosen than to the point waits."""
        v = self.vecs[self.rows[np.maximum(cand, 0)]]
        s = np.where(cand >= 0, np.einsum("bd,bkd->bk", own, v), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = np.einsum("bkd,bld->bkl", v, v)
        picked = np.zeros(cand.shape, bool)
        count = np.zeros(len(cand), np.int64)
        for k in range(cand.shape[1]):
            blocked = (picked & (between[:, k] > s[:, k:k + 1])).any(1)
            picked[:, k] = (cand[:, k] >= 0) & ~blocked & (count < DEGREE)
            count += picked[:, k]
        # free places go to the nearest that waited
        rank = np.where(picked, 0, np.where(cand >= 0, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        first = np.argsort(rank, axis=1)[:, :DEGREE]
        out = np.take_along_axis(cand, first, 1)
        if out.shape[1] < DEGREE:
            out = np.pad(out, ((0, 0), (0, DEGREE - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def build(self, entry_of) -> None:
        """Insert all points in batches; ``entry_of(queries)`` gives a place to start from."""
        n, done = len(self.rows), 0
        while done < n:
            size = min(BATCH, max(32, done), n - done)
            new = np.arange(done, done + size)
            q = self.vecs[self.rows[new]]
            within = q @ q.T
            np.fill_diagonal(within, -np.inf)
            k = min(size - 1, BUILD_BEAM // 2)
            cand = new[np.argpartition(-within, k - 1, axis=1)[:, :k]] if k > 0 else np.full((size, 1), -1)
            if done:
                entry = entry_of(q, done)
                found, _ = self.search(q, entry, min(BUILD_BEAM, done), done)
                cand = np.concatenate([cand, found], 1)
            self.links[new] = self.choose(q, cand)
            # links back; points with too many choose anew
            src = np.repeat(new, DEGREE)
            dst = self.links[new].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            points, first, many = np.unique(dst, return_index=True, return_counts=True)
            step = 256
            for a in range(0, len(points), step):
                p, f, m = points[a:a + step], first[a:a + step], many[a:a + step]
                extra = np.full((len(p), m.max()), -1, np.int64)
                col = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                extra[np.repeat(np.arange(len(p)), m), col] = src[np.repeat(f, m) + col]
                extra = np.where((extra[:, :, None] == self.links[p][:, None, :]).any(2), -1, extra)
                # the nearest extras only need a look when very many point here
                both = np.concatenate([self.links[p].astype(np.int64), extra], 1)
                if both.shape[1] > 4 * DEGREE:
                    v = self.vecs[self.rows[np.maximum(both, 0)]]
                    s = np.where(both >= 0, np.einsum("bd,bkd->bk", self.vecs[self.rows[p]], v), -np.inf)
                    both = np.take_along_axis(both, np.argsort(-s, axis=1)[:, :4 * DEGREE], 1)
                self.links[p] = self.choose(self.vecs[self.rows[p]], both)
            done += size


class Graph:
    """Layers over unit vectors, the smallest first; built from rows in hashed order."""

    def __init__(self, raw: np.ndarray, keys: np.ndarray):
        unit = raw.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        self.vecs = unit.astype(np.float32)
        level = _levels(keys)
        self.layers: list[Layer] = []
        for lv in range(int(level.max(initial=0)), -1, -1):
            layer = Layer(self.vecs, np.flatnonzero(level >= lv))
            layer.build(lambda q, done, here=layer: self._entry(q, here, done))
            self.layers.append(layer)

    def _entry(self, q: np.ndarray, layer: Layer, limit: int) -> np.ndarray:
        """Place in ``layer`` from which to search: the nearest point known on the layers above."""
        at = np.zeros(len(q), np.int64)
        for k, up in enumerate(self.layers):
            found, _ = up.search(q, at, min(4, len(up.rows)), len(up.rows))
            below = self.layers[k + 1] if k + 1 < len(self.layers) else layer
            at = np.searchsorted(below.rows, up.rows[found[:, 0]])
            if below is layer:
                break
        return np.where(at < limit, at, 0)

    def near(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        base = self.layers[-1]
        saved, self.layers = self.layers, self.layers[:-1]
        entry = self._entry(q, base, len(base.rows))
        self.layers = saved
        return base.search(q, entry, min(beam, len(base.rows)), len(base.rows))


def _unite(low: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Unite the points x[i] and y[i]; ``low`` holds each point's least companion and is kept so."""
    while len(x):
        a, b = low[x], low[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        pairs = np.unique(np.maximum(a, b).astype(np.int64) * len(low) + np.minimum(a, b))
        np.minimum.at(low, pairs // len(low), pairs % len(low))
        while not np.array_equal(low[low], low):
            low[:] = low[low]


def _links(graph: Graph, raw: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Matrix (query x place) of the links of at least ``threshold``; queries whose beam is full of links get a wider one."""
    qd = q.astype(np.float64)
    unit = (qd / np.linalg.norm(qd, axis=1, keepdims=True)).astype(np.float32)
    out = np.zeros((len(q), len(raw)), bool)
    near = max(1e-4, raw.shape[1] * 1.2e-7)  # single precision tells similarities further from the threshold

    def take(who: np.ndarray, r: np.ndarray, c: np.ndarray, sims: np.ndarray) -> None:
        out[who[r], c] = True
        doubt = np.flatnonzero(sims < threshold + near)
        for s in range(0, len(doubt), 65_536):
            i, j = who[r[doubt[s:s + 65_536]]], c[doubt[s:s + 65_536]]
            va, vb = qd[i], raw[j].astype(np.float64)
            out[i, j] = np.einsum("ij,ij->i", va, vb) / (np.linalg.norm(va, axis=1) * np.linalg.norm(vb, axis=1)) >= threshold

    todo = np.arange(len(q))
    while len(todo) and beam <= WIDEST:
        ids, sims = graph.near(unit[todo], beam)
        hit = (sims >= threshold - near) & (ids >= 0)
        full = hit.all(1) & (ids.shape[1] < len(raw))
        r, c = np.nonzero(hit & ~full[:, None])
        take(todo, r, ids[r, c], sims[r, c])
        todo, beam = todo[full], 2 * beam
    for s in range(0, len(todo), BATCH):
        sims = unit[todo[s:s + BATCH]] @ graph.vecs.T
        r, c = np.nonzero(sims >= threshold - near)
        take(todo[s:s + BATCH], r, c, sims[r, c])
    return out


def _audit(graph: Graph, raw: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> float:
    """Share of a query's links that the search finds, as a mean over the queries that have any.

    ``own`` is a query's place in the shard (-1: it isn't there): a vector is no link of its own.
    """
    hit = _links(graph, raw, q, threshold, beam)
    here = np.flatnonzero(own >= 0)
    hit[here, own[here]] = False
    found = hit.sum(1)
    qd, there = q.astype(np.float64), np.zeros(len(q), np.int64)
    norm = np.linalg.norm(qd, axis=1)
    for s in range(0, len(raw), 8192):
        part = raw[s:s + 8192].astype(np.float64)
        there += (qd @ part.T >= threshold * norm[:, None] * np.linalg.norm(part, axis=1)).sum(1)
    there -= own >= 0
    some = there > 0
    return float((found[some] / there[some]).mean()) if some.any() else 1.0


def _found(graph: Graph, raw: np.ndarray, q: np.ndarray, same: bool, threshold: float, recall: float, audits: int) -> np.ndarray:
    """Bit matrix (query x place in the shard) of the links that the audited search finds."""
    beam = 24
    at = np.unique(np.linspace(0, len(q) - 1, min(audits, len(q))).astype(np.int64))
    own = at if same else np.full(len(at), -1)
    while beam <= WIDEST and beam < len(raw) and _audit(graph, raw, q[at], own, threshold, beam) < recall:
        beam *= 2
    bits = np.zeros((len(q), -(-len(raw) // 8)), np.uint8)
    for s in range(0, len(q), BATCH):
        bits[s:s + BATCH] = np.packbits(_links(graph, raw, q[s:s + BATCH], threshold, beam), axis=1)
    return bits


def _read_graph(g) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, vectors, uids, copies) of a staged shard."""
    raw = np.frombuffer(g["vectors"], np.dtype(g["kind"])).reshape(-1, int(g["dim"]))
    graph = object.__new__(Graph)
    unit = raw.astype(np.float64)
    graph.vecs = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    rows, links = np.frombuffer(g["rows"], np.int32).astype(np.int64), np.frombuffer(g["links"], np.int32)
    graph.layers, at = [], 0
    for n in np.frombuffer(g["sizes"], np.int64).tolist():
        graph.layers.append(Layer(graph.vecs, rows[at:at + n], links[at * DEGREE:(at + n) * DEGREE].reshape(n, DEGREE)))
        at += n
    return graph, raw, np.frombuffer(g["uids"], np.int64), np.frombuffer(g["copies"], np.int64)


def _search_pair(threshold: float, recall: float, audits: int):
    """Links between two shards (or within one), each a query of the other: found from either side, counted for both."""

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("shard")
        same = pair["lo"].iloc[0] == pair["hi"].iloc[0]
        if len(pair) == 1 and not same:
            return pd.DataFrame({"uid": [], "n": [], "other": []}, dtype=np.int64)
        g1, raw1, uid1, copies1 = _read_graph(pair.iloc[0])
        if same:
            raw2, uid2, copies2 = raw1, uid1, copies1
            there = back = _found(g1, raw1, raw1, True, threshold, recall, audits)
        else:
            g2, raw2, uid2, copies2 = _read_graph(pair.iloc[1])
            there = _found(g2, raw2, raw1, False, threshold, recall, audits)
            back = _found(g1, raw1, raw2, False, threshold, recall, audits)
        uids, first = (uid1, 0) if same else (np.concatenate([uid1, uid2]), len(uid1))
        low, counts = np.arange(len(uids)), np.zeros(len(uids))
        for s in range(0, len(raw1), BATCH):
            n = min(BATCH, len(raw1) - s)
            hit = np.unpackbits(there[s:s + n], axis=1, count=len(raw2)).astype(bool)
            hit |= np.unpackbits(back[:, s // 8:(s + n + 7) // 8], axis=1, count=n).T.astype(bool)
            if same:
                hit[np.arange(n), s + np.arange(n)] = False
            x, y = np.nonzero(hit)
            counts[s:s + n] += np.bincount(x, weights=copies2[y], minlength=n)
            if not same:
                counts[first:] += np.bincount(y, weights=copies1[s + x], minlength=len(raw2))
            _unite(low, s + x, first + y)
        at, moved = np.flatnonzero(counts), np.flatnonzero(low != np.arange(len(low)))
        return pd.DataFrame({"uid": np.concatenate([uids[at], uids[moved]]),
                             "n": np.concatenate([counts[at].astype(np.int64), np.zeros(len(moved), np.int64)]),
                             "other": np.concatenate([np.full(len(at), -1, np.int64), uids[low[moved]]])})
    return run


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("h")
    kind, dim = pdf["kind"].iloc[0], int(pdf["dim"].iloc[0])
    raw = np.frombuffer(b"".join(pdf["v"]), np.dtype(kind)).reshape(-1, dim)
    g = Graph(raw, pdf["uid"].to_numpy())
    return pd.DataFrame({
        "dim": [dim], "kind": [kind], "shard": [int(pdf["shard"].iloc[0])], "uids": [pdf["uid"].to_numpy(np.int64).tobytes()],
        "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "vectors": [raw.tobytes()],
        "rows": [np.concatenate([x.rows for x in g.layers]).astype(np.int32).tobytes()],
        "links": [np.concatenate([x.links.ravel() for x in g.layers]).astype(np.int32).tobytes()],
        "sizes": [np.array([len(x.rows) for x in g.layers], np.int64).tobytes()]})


def _vectors(kind: str):
    """(uid, list) -> (uid, dim, v): usable vectors as bytes; unusable ones have dim 0."""

    def scan(batches):
        for b in batches:
            dims, vs = [], []
            for x in b.column(1):
                v = np.zeros(0, kind)
                if x.is_valid and len(x) and x.values.null_count == 0:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # -0.0 becomes 0.0
                    d = v.astype(np.float64)
                    if not (np.isfinite(d).all() and np.isfinite(d @ d) and d @ d > 0):
                        v = v[:0]
                dims.append(len(v))
                vs.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(dims, pa.int32()), pa.array(vs, pa.binary())],
                                             names=["uid", "id", "dim", "v"])
    return scan


def vector_groups(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                  recall: float = 0.99, audits: int = 256, min_shards: int = 8, shard_rows: int = 32_768) -> DataFrame:
    """(uid, id, n_links, component_id, kept), one row for each row of ``table``.

    ``shard_rows`` bounds a shard's graph and so the bits of a task, which takes two
    shards and lets each query the other. Before, ``audits`` queries of each shard are
    compared with the whole other one; ``recall`` is the share of its links that such a query must find on average.
    """
    kind = "<f8" if "double" in dict(table.dtypes)[vec_col] else "<f4"
    base = with_uid(table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")))
    typ = dict(base.dtypes)["id"]
    rows = stage(base.select("uid", "vec", "id").mapInArrow(_vectors(kind), f"uid bigint, id {typ}, dim int, v binary"), "hnsw-vectors")
    classes = rows.filter("dim > 0").groupBy("dim", "v").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("h", F.xxhash64("uid")), "hnsw-classes")
    n = classes.count()
    shards = max(min_shards, -(-n // shard_rows))
    parts = classes.select("dim", F.lit(kind).alias("kind"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "uid", "copies", "v", "h")
    graphs = stage(parts.groupBy("dim", "shard").applyInPandas(
        _build_shard, "dim int, kind string, shard int, uids binary, copies binary, vectors binary, rows binary, links binary, "
        "sizes binary"), "hnsw-graphs")
    # Each unordered pair of shards that both hold vectors is one task; a shard without a partner there has nothing to find.
    met = (graphs.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
           .withColumns({"lo": F.least("shard", "with"), "hi": F.greatest("shard", "with")}))
    found = stage(met.groupBy("dim", "lo", "hi").applyInPandas(
        _search_pair(threshold, recall, audits), "uid bigint, n bigint, other bigint"), "hnsw-found")
    comp = connected_components(found.filter("other >= 0").select(F.col("uid").alias("a"), F.col("other").alias("b")), "hnsw-cc")
    linked = found.filter("other < 0").groupBy("uid").agg(F.sum("n").alias("links"))
    of_class = stage(classes.select("dim", "v", "uid", "copies").join(linked, "uid", "left")
                     .join(comp.withColumnRenamed("node", "uid"), "uid", "left")
                     .select("dim", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "uid").alias("c")), "hnsw-of-class")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    per_row = rows.join(of_class, ["dim", "v"], "left").select("uid", "id", "n_links", "c")
    per_comp = (rows.filter("dim > 0").groupBy("dim", "v").agg(F.min(order).alias("low")).join(of_class, ["dim", "v"])
                .groupBy("c").agg(F.min("low").alias("low")))
    out = per_row.join(per_comp, "c", "left")
    cid = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("low.id"))
    return out.select("uid", F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      cid.alias("component_id"), F.col("id").eqNullSafe(cid).alias("kept"))
