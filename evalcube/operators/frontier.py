"""Quality/cost frontier of model portfolios (one model per cell).

A portfolio picks one point of every cell's Pareto front; its cost and
quality are the sums. Values are turned into fixed-point integers first
(cost in 1e-9 dollars, quality in 1e-6 units), so sums and comparisons are
exact and identical in every engine.

``supported_frontier`` gives the portfolios on the upper convex hull of all
portfolios: every one of them is on the exact Pareto frontier, both end
points included. The hull of a Minkowski sum is the sum of the cells' hulls:
start at every cell's cheapest point and apply the cells' hull edges in order
of falling quality gained per dollar. That is one per-cell hull (a few points
per cell, cells in parallel) and one distributed running sum, however many
cells and models there are.

``exact_frontier`` gives every efficient portfolio (the full staircase, hull or
not) of each group of cells: a distributed fold over the cells.
``exact_frontier_local`` does the same in one process for tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small

from ..functions.prefix import running_totals
from .clean import ALIAS_COL
from .cube import CELL, cell_index

COST_SCALE = 10 ** 9
QUALITY_SCALE = 10 ** 6

_HULL_SCHEMA = "T STRING, D STRING, L STRING, vidx INT, llm_id INT, cost_fx BIGINT, quality_fx BIGINT"


def to_fixed(fronts: DataFrame) -> DataFrame:
    return fronts.select(*CELL, "llm_id",
                         F.round(F.col("cost") * COST_SCALE).cast("long").alias("cost_fx"),
                         F.round(F.col("quality") * QUALITY_SCALE).cast("long").alias("quality_fx"))


def _upper_hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """Upper concave chain of one cell's front, cheapest point first (exact integers)."""
    pts = sorted(zip(pdf["cost_fx"].map(int), pdf["quality_fx"].map(int), pdf["llm_id"].map(int)))
    hull: list[tuple[int, int, int]] = []
    for p in pts:
        if hull and p[1] <= hull[-1][1]:
            continue  # not better than a cheaper point: not on the staircase
        if hull and p[0] == hull[-1][0]:
            hull.pop()  # same cost, better quality: replaces the last point
        while len(hull) >= 2:
            (c1, q1, _), (c2, q2, _) = hull[-2], hull[-1]
            # drop the middle point unless it lies strictly above the chord
            if (q2 - q1) * (p[0] - c1) <= (p[1] - q1) * (c2 - c1):
                hull.pop()
            else:
                break
        hull.append(p)
    t, d, l = pdf["T"].iloc[0], pdf["D"].iloc[0], pdf["L"].iloc[0]
    return pd.DataFrame({"T": t, "D": d, "L": l, "vidx": range(len(hull)),
                         "llm_id": [h[2] for h in hull], "cost_fx": [h[0] for h in hull],
                         "quality_fx": [h[1] for h in hull]})


def cell_hulls(fronts: DataFrame) -> DataFrame:
    """Hull vertices per cell (groups hold one cell's front: at most one row per model)."""
    return to_fixed(fronts).groupBy(*CELL).applyInPandas(_upper_hull, _HULL_SCHEMA)


def supported_frontier(fronts: DataFrame, ids: DataFrame, buckets: int = 64) -> DataFrame:
    """Hull portfolios: step 0 is every cell's cheapest point, step k applies the
    k-th best edge (cell switched to ``llm_id``). Columns: step, T, D, L,
    llm_id, answerer_llm_alias, cost, quality.
    """
    from ..session import checkpoint_df
    # Hull vertices: at most models x cells rows, read by three consumers.
    hull = checkpoint_df(cell_hulls(fronts))
    w = Window.partitionBy(*CELL).orderBy("vidx")
    edges = (hull.withColumn("dc", F.col("cost_fx") - F.lag("cost_fx").over(w))
                 .withColumn("dq", F.col("quality_fx") - F.lag("quality_fx").over(w))
                 .filter(F.col("vidx") > 0)
                 .withColumn("slope", F.col("dq").cast("double") / F.col("dc").cast("double"))
                 .withColumn("cell_idx", cell_index(F.col("T"), F.col("D"), F.col("L"))))
    start = hull.filter(F.col("vidx") == 0).agg(F.sum("cost_fx").alias("c0"), F.sum("quality_fx").alias("q0"))
    c0, q0 = start.select("c0").scalar(), start.select("q0").scalar()
    ranked = running_totals(edges, "slope", ["cell_idx", "vidx"], ["dc", "dq"], descending=True,
                            buckets=buckets)
    steps = ranked.select("step", *CELL, "llm_id", (c0 + F.col("cum_dc")).alias("c"),
                          (q0 + F.col("cum_dq")).alias("q"))
    first = start.select(F.lit(0).cast("long").alias("step"), *[F.lit(None).cast("string").alias(c) for c in CELL],
                         F.lit(None).cast("int").alias("llm_id"), F.col("c0").alias("c"), F.col("q0").alias("q"))
    pts = first.unionByName(steps)
    names = broadcast_if_small(ids.select("llm_id", ALIAS_COL))
    return (pts.join(names, "llm_id", "left")
               .select("step", *CELL, "llm_id", ALIAS_COL,
                       F.round(F.col("c") / COST_SCALE, 9).alias("cost"),
                       F.round(F.col("q") / QUALITY_SCALE, 9).alias("quality")))


def exact_frontier_local(cells: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Exact Pareto staircase of all portfolios (fold with pruning), integer points.

    ``cells``: per cell its (cost, quality) options. Used for small inputs and
    as the brute-force reference of ``supported_frontier`` in the tests.
    """
    def prune(points):
        out, best = [], None
        for c, q in sorted(points, key=lambda p: (p[0], -p[1])):
            if best is None or q > best:
                out.append((c, q))
                best = q
        return out

    front = [(0, 0)]
    for opts in cells:
        front = prune([(a + c, b + q) for a, b in front for c, q in opts])
    return front


def _staircase(c: np.ndarray, q: np.ndarray, path: np.ndarray):
    """Efficient points only: cost rising, quality above all cheaper ones; of equal points the least path."""
    order = np.lexsort((path, -q, c))
    c, q, path = c[order], q[order], path[order]
    best = np.maximum.accumulate(q)
    keep = np.concatenate([[True], q[1:] > best[:-1]]) if len(q) else np.zeros(0, bool)
    return c[keep], q[keep], path[keep]


_STATE = "g int, c bigint, q bigint, path binary"


def _batch(g, c, q, path, width: int, **more) -> pa.RecordBatch:
    path = np.ascontiguousarray(path)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(c), [None, pa.py_buffer(path.tobytes())]) if width else \
        pa.array([b""] * len(c), pa.binary())
    cols = {"g": pa.array(g, pa.int32()), "c": pa.array(c, pa.int64()), "q": pa.array(q, pa.int64()), "path": fixed.cast(pa.binary())}
    return pa.RecordBatch.from_pydict(cols | more)


def _paths(col: pa.Array, width: int) -> np.ndarray:
    """Paths of one width as fixed-length byte strings (compared byte by byte)."""
    if not width:
        return np.zeros(len(col), "S1")
    return np.frombuffer(b"".join(col.to_pylist()), f"S{width}") if len(col) else np.zeros(0, f"S{width}")


def _expand(options: list, start: int, stop: int, carry: dict):
    """Points -> their portfolios with each option of the groups' cells ``start`` to ``stop``, pruned batch by batch.

    ``carry`` holds the best quality of earlier, cheaper partitions: points not above it go.
    """
    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g, c, q = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            pid = b.column(4).to_numpy(zero_copy_only=False)
            path = _paths(b.column(3), 2 * start)
            for gi in np.unique(g).tolist():
                floor = {p: carry.get((p, gi), -1) for p in np.unique(pid).tolist()}
                at = np.flatnonzero((g == gi) & (q > np.array([floor[p] for p in pid.tolist()])))
                gc, gq, gp = c[at], q[at], path[at]
                for cell in range(start, stop):
                    # a group of fewer cells keeps its points; 0 marks that no model was chosen
                    oc, oq, oid = options[gi][cell] if cell < len(options[gi]) else (np.zeros(1, np.int64), np.zeros(1, np.int64), [b"\0\0"])
                    n, k = len(gc), len(oc)
                    wide = np.zeros((n, k, 2 * cell + 2), np.uint8)
                    if cell:
                        wide[:, :, :-2] = np.ascontiguousarray(gp).view(np.uint8).reshape(n, 1, 2 * cell)
                    wide[:, :, -2:] = np.frombuffer(b"".join(oid), np.uint8).reshape(1, k, 2)
                    gc, gq, gp = _staircase((gc[:, None] + oc).ravel(), (gq[:, None] + oq).ravel(),
                                            wide.reshape(n * k, -1).view(f"S{2 * cell + 2}").ravel())
                if len(gc):
                    yield _batch(np.full(len(gc), gi), gc, gq, gp, 2 * stop)
    return scan


def _prune_sorted(width: int):
    """Points sorted by (g, c, q falling, path) -> the efficient ones of the partition, with its number and their place in its group."""

    def scan(batches):
        from pyspark import TaskContext
        pid, top, place = TaskContext.get().partitionId(), {}, {}
        for b in batches:
            g, c, q = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            path = _paths(b.column(3), width)
            for gi in np.unique(g).tolist():
                at = np.flatnonzero(g == gi)
                before = np.maximum.accumulate(np.concatenate([[top.get(gi, -1)], q[at]]))
                at = at[q[at] > before[:-1]]
                top[gi] = int(before[-1])
                i = place.get(gi, 0) + np.arange(len(at))
                place[gi] = place.get(gi, 0) + len(at)
                yield _batch(g[at], c[at], q[at], path[at], width, pid=pa.array(np.full(len(at), pid), pa.int32()), i=pa.array(i, pa.int64()))
    return scan


def exact_frontier(fronts: DataFrame, by: list[str], cells_per_round: int = 5) -> DataFrame:
    """Every efficient portfolio of each group's cells: (by.., step, cost, quality, llm_ids in cell order).

    ``by`` are cell columns (``["T"]``: a frontier for each task; ``[]``: one of all
    cells). The cells are folded in order: each point yields its portfolio with
    every option of the next cell (a generator in the map step, no pairing of two
    fronts), points are pruned within the batch, ranged by (group, cost), pruned
    by the running best quality of their partition and, in the next round, by
    that of the cheaper partitions, one number for each partition and group. Each
    round is a written table, the one before is deleted. Sums are whole numbers.

    No point is left out and no number of points assumed; memory is that of one
    batch. Options are models x 360 rows at most, whatever the number of records.
    """
    from ..session import drop_table, write_table
    spark = fronts.sparkSession
    rows = (to_fixed(fronts).withColumn("cell", cell_index(F.col("T"), F.col("D"), F.col("L")))
            .select(*by, "cell", "cost_fx", "quality_fx", "llm_id").collect())
    keys = sorted({tuple(r[c] for c in by) for r in rows})
    cells: list[dict] = [{} for _ in keys]
    for r in rows:
        cells[keys.index(tuple(r[c] for c in by))].setdefault(r["cell"], []).append((r["cost_fx"], r["quality_fx"], r["llm_id"]))
    options = [[(np.array([o[0] for o in opts]), np.array([o[1] for o in opts]), [(o[2] + 1).to_bytes(2, "big") for o in opts])
                for _, opts in sorted(group.items())] for group in cells]
    n_cells = max(map(len, options), default=0)
    ddl = _STATE + ", pid int, i bigint"
    state = spark.createDataFrame([(k, 0, 0, b"", 0, 0) for k in range(len(keys))], ddl)
    carry: dict = {}
    order = ["g", "c", F.col("q").desc(), "path"]
    for start in range(0, n_cells, cells_per_round):
        stop = min(start + cells_per_round, n_cells)
        grown = state.mapInArrow(_expand(options, start, stop, carry), _STATE)
        after = write_table(grown.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_prune_sorted(2 * stop), ddl), "frontier-round")
        if start:
            drop_table(state)
        state = after
        best, carry = {}, {}
        for r in sorted(state.groupBy("pid", "g").agg(F.max("q").alias("q")).collect(), key=lambda r: (r["pid"], r["g"])):
            carry[(r["pid"], r["g"])] = best.get(r["g"], -1)
            best[r["g"]] = max(best.get(r["g"], -1), r["q"])
    floors = spark.createDataFrame([(p, g, f) for (p, g), f in carry.items()] or [(0, -1, -1)], "pid int, g int, floor bigint")
    left = state.join(F.broadcast(floors), ["pid", "g"], "left").withColumn("floor", F.coalesce("floor", F.lit(-1)))
    # quality rises along a partition's group, so what the floor removes is its beginning
    sizes = sorted(left.groupBy("pid", "g").agg(F.sum((F.col("q") <= F.col("floor")).cast("long")).alias("gone"), F.count("*").alias("n")).collect(),
                   key=lambda r: (r["pid"], r["g"]))
    ahead, shift = {}, []
    for r in sizes:
        shift.append((r["pid"], r["g"], ahead.get(r["g"], 0) - r["gone"]))
        ahead[r["g"]] = ahead.get(r["g"], 0) + r["n"] - r["gone"]
    shifts = spark.createDataFrame(shift or [(0, -1, 0)], "pid int, g int, shift bigint")
    fields = [fronts.schema[c] for c in by]
    names = spark.createDataFrame([(k, *key) for k, key in enumerate(keys)] or [(-1, *([None] * len(by)))],
                                  ", ".join(["g int", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)]))
    ids = F.expr("filter(transform(sequence(0, length(path) div 2 - 1), i -> cast(conv(hex(substring(path, 2 * i + 1, 2)), 16, 10) as int) - 1), x -> x >= 0)")
    return (left.filter("q > floor").join(F.broadcast(shifts), ["pid", "g"]).join(F.broadcast(names), "g")
            .select(*by, (F.col("i") + F.col("shift")).alias("step"), F.round(F.col("c") / COST_SCALE, 9).alias("cost"),
                    F.round(F.col("q") / QUALITY_SCALE, 9).alias("quality"), ids.alias("llm_ids")))


def thin_frontier(points: DataFrame, by: list[str] | None = None, cost_gap: float = 0.01, quality_gap: float = 0.5) -> DataFrame:
    """Points of a frontier the chart keeps: a group's first point, then every point at
    least ``cost_gap`` dearer or ``quality_gap`` better than the last kept one.

    Which point is kept depends on the one kept before, so each frontier passes a
    task once as a sorted stream; only the last kept point is held. A frontier's
    length follows from cells and models, not from the number of records.
    """
    by = by or []
    gc, gq = round(cost_gap * COST_SCALE), round(quality_gap * QUALITY_SCALE)
    names = points.columns

    def scan(batches):
        last = None
        for b in batches:
            group = list(zip(*(b.column(names.index(c)).to_pylist() for c in by))) if by else [()] * b.num_rows
            c = np.rint(b.column(names.index("cost")).to_numpy() * COST_SCALE).astype(np.int64)
            q = np.rint(b.column(names.index("quality")).to_numpy() * QUALITY_SCALE).astype(np.int64)
            starts = [0] + [k for k in range(1, len(group)) if group[k] != group[k - 1]]
            keep = []
            for a, z in zip(starts, starts[1:] + [len(group)]):
                k = a
                if a < z and (last is None or last[0] != group[a]):
                    keep.append(a)
                    last = (group[a], c[a], q[a])
                while k < z:  # the next kept point is the first beyond either gap
                    k = a + min(np.searchsorted(c[a:z], last[1] + gc), np.searchsorted(q[a:z], last[2] + gq))
                    if k < z:
                        keep.append(k)
                        last = (group[k], c[k], q[k])
            yield b.take(pa.array(keep, pa.int64()))

    dealt = points.repartition(*by) if by else points.repartition(1)
    return dealt.sortWithinPartitions(*by, "step").mapInArrow(scan, points.schema)
