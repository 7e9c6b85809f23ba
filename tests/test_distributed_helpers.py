"""Distributed running totals and exact percentiles against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalcube.functions.prefix import running_totals
from evalcube.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
NAMES = ["p0", "p05", "p25", "p50", "p75", "p95", "p100"]


def test_running_totals_match_cumsum(spark):
    rnd = random.Random(3)
    rows = [(i, float(rnd.choice([0.5, 1.0, 1.5, 2.0, 7.0])), rnd.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id INT, k DOUBLE, x INT")
    got = {r.id: (r.step, r.cum_x) for r in running_totals(df, "k", ["id"], ["x"], descending=True,
                                                           buckets=8).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    total = 0
    for pos, (i, _, x) in enumerate(order, start=1):
        total += x
        assert got[i] == (pos, total)


@pytest.mark.parametrize("buckets", [4, 64])
def test_exact_quantiles_match_numpy(spark, buckets):
    rnd = random.Random(11)
    rows = []
    # one hot group with many ties, one wide group, one single-row group
    rows += [("hot", float(rnd.choice([0.1, 0.2, 0.2, 0.2, 0.9]))) for _ in range(3000)]
    rows += [("wide", rnd.uniform(-5, 5)) for _ in range(700)]
    rows += [("one", 4.25)]
    rows += [("hot", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBS, NAMES, buckets=buckets).collect()}
    for g in ("hot", "wide", "one"):
        vals = np.array([v for k, v in rows if k == g and v is not None])
        want = np.quantile(vals, PROBS)  # linear interpolation
        assert [getattr(got[g], n) for n in NAMES] == pytest.approx(list(want), abs=1e-12)


def test_exact_quantiles_whole_table(spark):
    df = spark.range(1001).select((F.col("id") * 0.5).alias("v"))
    r = exact_quantiles(df, [], "v", [0.25, 0.5], ["a", "b"], buckets=16).first()
    assert (r.a, r.b) == (125.0, 250.0)
