"""Exact percentiles (linear interpolation) without gathering a group in one buffer.

``percentile``/``median`` keep every value of a group in one aggregation
buffer, so a model holding a third of all rows would hold a third of the data
in one task. Here a group's values are cut into value ranges by a mergeable
sketch (``percentile_approx``: bounded memory per group), the ranges are
counted, and only the few ranges that contain a requested rank are ordered,
each inside its own window partition (about n/buckets rows). A range whose
values are all equal is not ordered at all.

Rank rule (same as ``percentile`` and DuckDB ``quantile_cont``): for p in
[0, 1], pos = p * (n - 1); result = v[floor(pos)] + (pos - floor(pos)) *
(v[ceil(pos)] - v[floor(pos)]) over the group's sorted non-null values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_written


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str], buckets: int = 256, accuracy: int = 10000) -> DataFrame:
    """One row per group with a non-null value: ``keys`` plus one column per name in ``names``
    (callers left-join it onto their group table).

    With no keys the whole table is one group (computed the same way: still
    no single buffer of all values).
    """
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, names,
                              buckets, accuracy)
        return one.drop("_all")
    v = F.col(value).cast("double")
    # Equal values are counted before anything moves: a frequent value is one row,
    # and only these counts are written, cut into ranges and ordered.
    from ..session import scratch_path
    base = (df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    path = scratch_path(df.sparkSession, "value-counts")
    base.write.mode("overwrite").parquet(path)
    base = df.sparkSession.read.schema(base.schema).parquet(path)
    cut_probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = base.groupBy(*keys).agg(F.percentile_approx("_v", cut_probs, accuracy).alias("_cuts"))
    # Groups x buckets values: a dimension-sized table, broadcast after a size check.
    # Range of a value = number of cuts below it: its first position in the
    # sorted cuts with the value added (plain array functions, no lambda).
    binned = base.join(broadcast_written(cuts, "cuts"), keys).select(
        *keys, "_v", "_n", (F.array_position(F.sort_array(F.concat("_cuts", F.array("_v"))), F.col("_v")) - 1)
        .cast("int").alias("_b"))
    # Written once to the shared folder: the counts and the ordering below read
    # this copy instead of scanning the input again (two scans in total).
    from ..session import checkpoint_df
    binned = checkpoint_df(binned)
    counts = binned.groupBy(*keys, "_b").agg(
        F.sum("_n").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.withColumn("_start", F.sum("_c").over(w) - F.col("_c"))

    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    targets = n.select(*keys, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_pi", "_p"))
    targets = targets.withColumn("_pos", F.col("_p") * (F.col("_n") - 1)).select(
        *keys, "_pi", "_pos", F.explode(F.array_distinct(F.array(
            F.floor("_pos").cast("long"), F.ceil("_pos").cast("long")))).alias("_r"))
    # Range holding each target rank: an equi join on the group, then the rank test.
    located = targets.join(ranges, keys).filter(
        (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_c")))
    flat = located.filter(F.col("_lo") == F.col("_hi")).select(*keys, "_pi", "_pos", "_r", F.col("_lo").alias("_val"))
    need = located.filter(F.col("_lo") != F.col("_hi"))
    need_b = need.select(*keys, "_b", "_start").distinct()
    rows = binned.select(*keys, "_b", "_v", "_n").join(broadcast_written(need_b, "ranges"), keys + ["_b"])
    wr = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = rows.withColumn("_r0", F.sum("_n").over(wr) - F.col("_n") + F.col("_start"))
    picked = (need.select(*keys, "_b", "_pi", "_pos", "_r")
              .join(ranked.select(*keys, "_b", "_r0", "_n", F.col("_v").alias("_val")), keys + ["_b"])
              .filter((F.col("_r") >= F.col("_r0")) & (F.col("_r") < F.col("_r0") + F.col("_n")))
              .select(*keys, "_pi", "_pos", "_r", "_val"))
    vals = flat.unionByName(picked)
    per_p = vals.groupBy(*keys, "_pi", "_pos").agg(
        F.min_by("_val", "_r").alias("_vlo"), F.max_by("_val", "_r").alias("_vhi"))
    interp = per_p.select(*keys, "_pi", (F.col("_vlo") + (F.col("_pos") - F.floor("_pos"))
                                          * (F.col("_vhi") - F.col("_vlo"))).alias("_q"))
    return interp.groupBy(*keys).agg(*[F.max(F.when(F.col("_pi") == i, F.col("_q"))).alias(nm)
                                       for i, nm in enumerate(names)])
