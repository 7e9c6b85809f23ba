"""Data profiles: missing values, distributions, per-model quality/cost stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_written

from ..functions.quantiles import exact_quantiles
from .clean import ALIAS_COL

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
PCT_NAMES = ["p05", "p25", "p50", "p75", "p95"]


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and percentage per column, one aggregation pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    long = wide.unpivot("_n", df.columns, "column_name", "missing_count")
    return long.select(
        "column_name",
        F.col("missing_count").cast("long").alias("missing_count"),
        F.round(F.col("missing_count") * 100.0 / F.col("_n"), 6).alias("missing_pct"))


def value_counts(df: DataFrame, column: str, explode_lists: bool = False) -> DataFrame:
    """Count per value, nulls dropped, largest first (ties by value)."""
    c = F.col(column)
    src = df.select(F.explode(c).alias("value") if explode_lists else c.alias("value"))
    return (src.filter(F.col("value").isNotNull())
               .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), F.asc("value")))


def top_k(df: DataFrame, column: str, k: int = 10, bottom: bool = False,
          explode_lists: bool = False) -> DataFrame:
    """Top-k (or bottom-k) values by count: a TakeOrderedAndProject, no full sort."""
    vc = value_counts(df, column, explode_lists)
    order = [F.asc("n"), F.asc("value")] if bottom else [F.desc("n"), F.asc("value")]
    return vc.orderBy(*order).limit(k)


def group_size_hist(df: DataFrame, group_col: str) -> DataFrame:
    """How many groups have 1, 2, ... rows (counts of counts)."""
    sizes = df.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(
        F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


def quality_summary(df: DataFrame, value: str = "quality") -> DataFrame:
    """count, mean, std, min, max, median per model, half-even rounded to 3 places.

    The median comes from ``exact_quantiles`` (no group gathered in one buffer).
    """
    v = F.col(value)
    stats = df.groupBy(ALIAS_COL).agg(
        F.count(v).alias("count"),
        F.bround(F.avg(v), 3).alias("mean"),
        F.bround(F.stddev_samp(v), 3).alias("std"),
        F.bround(F.min(v), 3).alias("min"),
        F.bround(F.max(v), 3).alias("max"),
    )
    med = exact_quantiles(df, [ALIAS_COL], value, [0.5], ["_median"])
    return stats.join(med, ALIAS_COL, "left").select(
        ALIAS_COL, "count", "mean", "std", "min", "max", F.bround("_median", 3).alias("median"))


def value_percentiles(df: DataFrame, value: str, exact: bool = True,
                      accuracy: int = 10000) -> DataFrame:
    """mean, 5/25/50/75/95 % (linear interpolation) and max per model.

    ``exact`` uses ``exact_quantiles``; ``exact=False`` reads the percentiles
    off the ``percentile_approx`` sketch alone (one pass, bounded memory).
    """
    v = F.col(value)
    agg = df.groupBy(ALIAS_COL).agg(F.avg(v).alias("mean"), F.max(v).alias("max"))
    if exact:
        pct = exact_quantiles(df, [ALIAS_COL], value, PERCENTILES, PCT_NAMES, accuracy=accuracy)
    else:
        p = F.percentile_approx(v, F.array(*[F.lit(x) for x in PERCENTILES]), accuracy)
        pct = df.groupBy(ALIAS_COL).agg(p.alias("_p")).select(
            ALIAS_COL, *[F.col("_p")[i].alias(n) for i, n in enumerate(PCT_NAMES)])
    return agg.join(pct, ALIAS_COL, "left").select(
        ALIAS_COL, F.round("mean", 9).alias("mean"),
        *[F.round(n, 9).alias(n) for n in PCT_NAMES],
        F.round("max", 9).alias("max"))


def histogram(df: DataFrame, value: str = "quality", bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins over each model's own min..max (dense output).

    Bin of v = number of inner edges lo + i*(hi-lo)/bins (i = 1..bins-1) that
    are <= v, the same edge rule as numpy's histogram; if min = max the range
    is widened by 0.5 on both sides.
    """
    v = F.col(value)
    stats = df.filter(v.isNotNull()).groupBy(ALIAS_COL).agg(F.min(v).alias("_lo0"), F.max(v).alias("_hi0"))
    stats = stats.select(
        ALIAS_COL,
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("lo"),
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("hi"))
    # One row per model: joined back by broadcast (bounded by the model count).
    # Bin = number of inner edges lo + i*w (i = 1..bins-1) at or below v: a
    # first guess from the division, then one correction against the edges
    # themselves (the division is off by at most one at an edge).
    w = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(F.greatest(F.floor((v - F.col("lo")) / w), F.lit(0)), F.lit(bins - 1))

    def edge(i):
        return F.col("lo") + i * w
    binned = df.filter(v.isNotNull()).join(broadcast_written(stats, "histogram-ranges"), ALIAS_COL).withColumn("_g", guess).select(
        ALIAS_COL,
        F.when((F.col("_g") > 0) & (v < edge(F.col("_g"))), F.col("_g") - 1)
         .when((F.col("_g") < bins - 1) & (v >= edge(F.col("_g") + 1)), F.col("_g") + 1)
         .otherwise(F.col("_g")).alias("bin"))
    counts = binned.groupBy(ALIAS_COL, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = stats.select(ALIAS_COL, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, [ALIAS_COL, "bin"], "left")
                .select(ALIAS_COL, F.col("bin").cast("int").alias("bin"),
                        F.round(F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins), 9)
                        .alias("bin_start"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def eval_coverage(df: DataFrame, result_col: str = "eval_result") -> DataFrame:
    """Total rows, judged rows and not-judged rows."""
    r = F.col(result_col)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count(r).alias("judged"),
                  F.count_if(r.isNull()).alias("not_judged"))


def quality_overall(df: DataFrame, value: str = "quality") -> DataFrame:
    """describe() of one column: count, mean, std, min, quartiles, max."""
    v = F.col(value)
    one = df.withColumn("_all", F.lit(0))
    agg = one.groupBy("_all").agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                                  F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(one, ["_all"], value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    # One-row aggregate joined with the one-row quantile table on the constant key.
    return agg.join(q, "_all", "left").select(
        "count", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"),
        F.round("min", 9).alias("min"), F.round("p25", 9).alias("p25"),
        F.round("p50", 9).alias("p50"), F.round("p75", 9).alias("p75"), F.round("max", 9).alias("max"))


def all_distributions(df: DataFrame, scalar_cols: list[str], list_cols: list[str]) -> DataFrame:
    """(dimension, value, n) for several columns in one scan and one aggregation.

    Each row emits one (dimension, value) pair per scalar column and one per
    element of each list column (a generator, no union of scans); nulls are
    dropped. The partial aggregate keeps one counter per distinct pair per task.
    """
    pairs = [F.array(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")))
             for c in scalar_cols]
    def tag(name):
        return lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))
    pairs += [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), tag(c)) for c in list_cols]
    exploded = df.select(F.inline(F.concat(*pairs)))
    return (exploded.filter(F.col("value").isNotNull())
                    .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")))
