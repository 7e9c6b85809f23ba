"""Distributed running totals in a global order (no single-partition window).

Rows are cut into ``buckets`` ranges of the leading sort key (boundaries from
``approxQuantile``, a bounded list), each range is summed and numbered inside
its own window partition, and the totals of earlier ranges (one row per range,
a bounded table) are added back by a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small


def _bucket_of(key: Column, bounds: list[float], descending: bool) -> Column:
    """Number of boundaries the key has passed in sort order.

    A balanced tree of comparisons against the (constant) boundaries: log2
    depth, generated code, no lambda.
    """
    def tree(lo: int, hi: int) -> Column:
        # answer is in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        passed = key < F.lit(float(bounds[mid])) if descending else key > F.lit(float(bounds[mid]))
        return F.when(passed, tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return tree(0, len(bounds))


def running_totals(df: DataFrame, key: str, tiebreak: list[str], sums: list[str],
                   descending: bool = True, buckets: int = 64, rank_col: str = "step") -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum of each ``s`` in ``sums``) and a 1-based
    ``rank_col`` in the order (``key`` desc/asc, then ``tiebreak`` ascending).

    Equal keys always share a range, so ties are ordered by ``tiebreak`` only.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(key, probs, 0.001))) if buckets > 1 else []
    if descending:
        bounds = sorted(bounds, reverse=True)
    k = F.col(key)
    b = df.withColumn("_bucket", _bucket_of(k, bounds, descending).cast("int"))
    order = [k.desc() if descending else k.asc()] + [F.col(c).asc() for c in tiebreak]
    w = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({f"_loc_{s}": F.sum(s).over(w) for s in sums} | {"_loc_n": F.count(F.lit(1)).over(w)})
    totals = b.groupBy("_bucket").agg(*[F.sum(s).alias(f"_tot_{s}") for s in sums], F.count(F.lit(1)).alias("_tot_n"))
    # One row per range: the offsets of all earlier ranges.
    wt = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_tot_{s}").over(wt), F.lit(0)).alias(f"_off_{s}")
                                         for s in sums],
                            F.coalesce(F.sum("_tot_n").over(wt), F.lit(0)).alias("_off_n"))
    out = local.join(broadcast_if_small(offsets), "_bucket")
    return out.select(*df.columns,
                      *[(F.col(f"_loc_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
                      (F.col("_loc_n") + F.col("_off_n")).cast("long").alias(rank_col))
