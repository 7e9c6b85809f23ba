"""Pareto fronts and the portfolio frontier against brute force on small inputs."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalcube.operators import frontier as FR
from evalcube.operators.pareto import efficient_in_cells


def brute_front(points):
    """Points not dominated (cost <=, quality >=, one strict) by another; ties keep one."""
    out = []
    for c, q in sorted(set(points)):
        if not any((c2 <= c and q2 >= q) and (c2, q2) != (c, q) for c2, q2 in points):
            out.append((c, q))
    return out


def test_exact_fold_equals_brute_force():
    cells = [[(1, 2), (3, 5), (6, 6)], [(0, 0), (2, 4)], [(1, 1), (4, 7), (5, 9)]]
    allp = [tuple(map(sum, zip(*combo))) for combo in itertools.product(*cells)]
    assert FR.exact_frontier_local(cells) == brute_front(allp)


cell_st = st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=4)


def test_hull_points_on_exact_front(spark):
    import random
    rnd = random.Random(7)
    for trial in range(3):
        n_cells = 6
        rows, cells = [], []
        for ci in range(n_cells):
            opts = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(4)]
            front = brute_front(opts)
            cells.append(front)
            for k, (c, q) in enumerate(front):
                rows.append((f"T{ci + 1}", "D1", "L1", k, f"m{k}", c / FR.COST_SCALE, q / FR.QUALITY_SCALE))
        df = spark.createDataFrame(rows, "T STRING, D STRING, L STRING, llm_id INT, answerer_llm_alias STRING, "
                                         "cost DOUBLE, quality DOUBLE")
        ids = df.select("llm_id", "answerer_llm_alias").distinct()
        hull = FR.supported_frontier(df, ids, buckets=4).orderBy("step").collect()
        exact = set(FR.exact_frontier_local(cells))
        pts = [(round(r.cost * FR.COST_SCALE), round(r.quality * FR.QUALITY_SCALE)) for r in hull]
        assert all(p in exact for p in pts)
        # both end points of the exact staircase are on the hull
        ex = sorted(exact)
        assert pts[0] == ex[0] and pts[-1] == ex[-1]
        # steps increase in cost and quality
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pts, pts[1:]))


@settings(max_examples=15, deadline=None)
@given(cell_st)
def test_cell_front_matches_brute_force(spark, pts):
    df = spark.createDataFrame([("T1", "D1", "L1", i, float(c), float(q)) for i, (c, q) in enumerate(pts)],
                               "T STRING, D STRING, L STRING, llm_id INT, cost DOUBLE, quality DOUBLE")
    got = sorted((int(r.cost), int(r.quality)) for r in efficient_in_cells(df).collect())
    assert got == brute_front(pts)


def test_thinning_matches_sequential_rule(spark):
    import random
    rnd = random.Random(5)
    c = q = 0.0
    rows = []
    for step in range(200):
        rows.append((step, round(c, 9), round(q, 9)))
        c += rnd.choice([0.001, 0.004, 0.009, 0.02])
        q += rnd.choice([0.05, 0.2, 0.45, 0.6])
    df = spark.createDataFrame(rows, "step LONG, cost DOUBLE, quality DOUBLE")
    got = sorted(r.step for r in FR.thin_frontier(df).collect())
    kept, last = [], None
    for step, cc, qq in rows:
        ci, qi = round(cc * FR.COST_SCALE), round(qq * FR.QUALITY_SCALE)
        if last is None or not (ci - last[0] < 10_000_000 and qi - last[1] < 500_000):
            kept.append(step)
            last = (ci, qi)
    assert got == kept
