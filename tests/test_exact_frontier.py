"""Exact cube sums, the distributed frontier fold and its thinning against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from evalcube.operators import cube as K
from evalcube.operators import frontier as FR

SCORED = "answerer_llm_alias string, label_task array<string>, label_domain array<string>, label_level array<string>, quality double, cost double"


def _fronts(spark, seed, cells, models, same=False):
    rng = random.Random(seed)
    rows, opts = [], {}
    for k in range(cells):
        t, d, l = f"T{1 + k % 3}", f"D{1 + k // 3 % 10}", f"L{1 + k // 30}"
        own = {}
        for m in rng.sample(range(models), rng.randrange(1, models + 1)):
            c, q = (rng.randrange(4), rng.randrange(4)) if same else (rng.randrange(10 ** 6), rng.randrange(10 ** 6))
            own[m] = (c, q)
            rows.append((t, d, l, m, c / FR.COST_SCALE, q / FR.QUALITY_SCALE))
        opts[(t, d, l)] = own
    return spark.createDataFrame(rows, "T string, D string, L string, llm_id int, cost double, quality double"), opts


def _order(cell):
    return tuple(int(x[1:]) for x in cell)


@pytest.mark.parametrize("seed,cells,models,by,same,per_round", [(1, 12, 4, [], False, 2), (2, 24, 5, ["T"], False, 5), (3, 18, 4, ["T"], True, 1),
                                                                (4, 21, 3, ["T", "L"], True, 4), (5, 1, 1, [], False, 3)])
def test_fold_equals_local_fold(spark, seed, cells, models, by, same, per_round):
    fronts, opts = _fronts(spark, seed, cells, models, same)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # many batches in a partition
    try:
        got = FR.exact_frontier(fronts, by, per_round).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for cell in sorted(opts, key=_order):
        groups.setdefault(tuple(cell["TDL".index(c)] for c in by), []).append(opts[cell])
    assert {tuple(r[c] for c in by) for r in got} == set(groups)
    for key, chain in groups.items():
        want = FR.exact_frontier_local([list(o.values()) for o in chain])
        mine = sorted((r for r in got if tuple(r[c] for c in by) == key), key=lambda r: r.step)
        assert [r.step for r in mine] == list(range(len(mine)))
        assert [(round(r.cost * FR.COST_SCALE), round(r.quality * FR.QUALITY_SCALE)) for r in mine] == want
        least = {}
        level = [((0, 0), ())]
        for o in chain:  # all portfolios of small cases: the least ids of each point
            if len(level) * len(o) > 60_000:
                least = None
                break
            level = [((c + o[m][0], q + o[m][1]), (*p, m)) for (c, q), p in level for m in o]
        for r in mine:
            picked = [o[m] for o, m in zip(chain, r.llm_ids, strict=True)]
            point = (round(r.cost * FR.COST_SCALE), round(r.quality * FR.QUALITY_SCALE))
            assert (sum(c for c, _ in picked), sum(q for _, q in picked)) == point
            if least is not None:
                assert tuple(r.llm_ids) == min(p for x, p in level if x == point)


def test_hull_points_are_on_the_frontier(spark):
    fronts, _ = _fronts(spark, 9, 12, 4)
    ids = fronts.select("llm_id").distinct().withColumn("answerer_llm_alias", F.concat(F.lit("m"), "llm_id"))
    full = {(r.cost, r.quality) for r in FR.exact_frontier(fronts, []).collect()}
    hull = {(r.cost, r.quality) for r in FR.supported_frontier(fronts, ids).collect()}
    assert hull <= full and len(full) > len(hull)


def test_frontier_of_nothing(spark):
    fronts = spark.createDataFrame([], "T string, D string, L string, llm_id int, cost double, quality double")
    out = FR.exact_frontier(fronts, ["T"])
    assert out.count() == 0 and out.columns == ["T", "step", "cost", "quality", "llm_ids"]
    assert FR.thin_frontier(out, ["T"]).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_thinning_equals_a_scan(spark, by):
    rng = random.Random(6)
    rows = []
    for g in ("a", "b", "c"):
        c = q = 0
        for i in range(300 if g == "a" else 1 if g == "b" else 90):
            c, q = c + rng.randrange(1, 9_000_000), q + rng.randrange(1, 300_000)
            rows.append((g, i, c / FR.COST_SCALE, q / FR.QUALITY_SCALE))
    rows = rows if by else [r for r in rows if r[0] == "a"]
    df = spark.createDataFrame(rows, "g string, step bigint, cost double, quality double").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {(r.g, r.step) for r in FR.thin_frontier(df, by).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = set(), {}
    for g, i, c, q in rows:
        fc, fq = round(c * FR.COST_SCALE), round(q * FR.QUALITY_SCALE)
        if g not in last or fc - last[g][0] >= 10 ** 7 or fq - last[g][1] >= 500_000:
            want.add((g, i))
            last[g] = (fc, fq)
    assert got == want


def test_cube_is_the_same_for_any_partitions(spark):
    rng = random.Random(1)
    pick = lambda p, n: [f"{p}{1 + rng.randrange(n)}" for _ in range(rng.randrange(1, 4))]
    rows = [(rng.choice(["m1", "m2"]), pick("T", 13), pick("D", 10), pick("L", 3), rng.random(), rng.random() * 1e-3) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCORED)
    cubes = [sorted(map(tuple, K.tld_cube(df.repartition(n)).collect())) for n in (1, 3, 37)]
    assert cubes[0] == cubes[1] == cubes[2]
    want = {}
    for m, t, d, l, q, c in rows:
        w = 1 / (len(t) * len(d) * len(l))
        for x in t:
            for y in d:
                for z in l:
                    if x in K.TASKS:
                        cell = want.setdefault((m, x, y, z), [0.0, 0.0, 0.0])
                        cell[0] += w
                        cell[1] += w * q
                        cell[2] += w * c
    assert len(cubes[0]) == len(want)
    for *key, n, q, c in cubes[0]:
        assert (n, q, c) == pytest.approx(want[tuple(key)], abs=1e-8)


def test_cube_of_nothing_and_empty_labels(spark):
    assert K.tld_cube(spark.createDataFrame([], SCORED)).count() == 0
    rows = [("m", [], ["D1"], ["L1"], 1.0, 1.0), ("m", None, ["D1"], ["L1"], 1.0, 1.0), ("m", ["T1"], ["D1"], ["L1"], None, None)]
    got = K.tld_cube(spark.createDataFrame(rows, SCORED)).collect()
    assert [tuple(r) for r in got] == [("m", "T1", "D1", "L1", 1.0, 0.0, 0.0)]
