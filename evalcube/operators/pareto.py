"""Per-cell efficient models, base point, best portfolio and routing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small

from .clean import ALIAS_COL
from .cube import CELL, DOMAINS, LEVELS, TASKS, code_num

SORT_DIGITS = 7
_SCALE = 10.0 ** SORT_DIGITS


def sort_key(c: str):
    """Value rounded to 7 places as an integer key: floor(x * 1e7 + 0.5).

    The reference rounds sort keys to 7 places as a float guard; this form
    gives bit-identical keys in every engine (no half-even/half-up split).
    """
    return F.floor(F.col(c) * _SCALE + 0.5)


def cell_candidates(dense: DataFrame, ids: DataFrame, active: str = "first_model") -> DataFrame:
    """Every model in every active cell, zeros where it has no rows there.

    ``active='first_model'`` keeps the cells where model 0 has a non-zero
    count (parity); ``'any'`` keeps cells where any model has one.
    """
    d = dense.join(broadcast_if_small(ids), ALIAS_COL)
    if active == "first_model":
        act = d.filter((F.col("llm_id") == 0) & (F.col("count") != 0)).select(*CELL)
    else:
        act = d.filter(F.col("count") != 0).select(*CELL).distinct()
    return d.join(act, CELL, "left_semi")


def efficient_in_cells(cands: DataFrame, part: list[str] | None = None,
                       order_id: str = "llm_id") -> DataFrame:
    """Pareto front (cost down, quality up) inside each partition.

    Order by rounded cost asc, rounded quality desc, then ``order_id``; keep a
    row when its quality beats every earlier row's. The running max over
    kept rows equals the one over all earlier rows, so one window suffices.
    NaN qualities are dropped first (they never win a comparison).
    """
    part = part or CELL
    w = (Window.partitionBy(*part)
         .orderBy(sort_key("cost").asc(), sort_key("quality").desc(),
                  F.col(order_id).asc())
         .rowsBetween(Window.unboundedPreceding, -1))
    prev = F.max("quality").over(w)
    clean = cands.filter(F.col("quality").isNotNull() & ~F.isnan("quality"))
    return (clean.withColumn("_prev", prev)
                 .filter(F.col("_prev").isNull() | (F.col("quality") > F.col("_prev")))
                 .drop("_prev"))


def with_front_size(fronts: DataFrame) -> DataFrame:
    return fronts.withColumn("front_size", F.count(F.lit(1)).over(Window.partitionBy(*CELL)))


def base_point(fronts_sized: DataFrame) -> DataFrame:
    """Sum of quality and cost over single-option cells (added to every portfolio)."""
    single = fronts_sized.filter(F.col("front_size") == 1)
    return single.agg(F.count(F.lit(1)).alias("n_cells"),
                      F.round(F.coalesce(F.sum("quality"), F.lit(0.0)), 9).alias("quality"),
                      F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 9).alias("cost"))


def cell_end_points(fronts: DataFrame) -> DataFrame:
    """Highest-quality point of each cell's front (ties: the cheaper, lower id).

    The end point of a Minkowski sum of fronts is the sum of the cells' end
    points, so the best portfolio needs no fold.
    """
    w = Window.partitionBy(*CELL).orderBy(F.col("quality").desc(), F.col("cost").asc(), F.col("llm_id").asc())
    return fronts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def best_portfolio(fronts_sized: DataFrame, include_single: bool = False) -> DataFrame:
    """Model per cell of the highest-quality portfolio (multi-option cells by default)."""
    src = fronts_sized if include_single else fronts_sized.filter(F.col("front_size") >= 2)
    return cell_end_points(src)


def routing_table(assign: DataFrame, value: str, agg: str = "names") -> DataFrame:
    """(T, L) x D pivot over the full 36-row template, natural order.

    ``agg='names'`` joins model names with newlines; ``'sum'`` adds ``value``.
    Missing cells stay NULL.
    """
    if agg == "names":
        names = F.sort_array(F.collect_list(value))
        fn = F.when(F.size(names) > 0, F.array_join(names, "\n"))
    else:
        fn = F.round(F.sum(value), 9)
    piv = assign.groupBy("T", "L").pivot("D", DOMAINS).agg(fn)
    from ..functions.joins import local_table
    rows = local_table(assign.sparkSession, [(t, l) for t in TASKS for l in LEVELS], "T STRING, L STRING")
    # A template of the 36 (T, L) rows, left-aligned with the data.
    return (rows.join(piv, ["T", "L"], "left")
                .orderBy(code_num(F.col("T")), code_num(F.col("L")))
                .select("T", "L", *DOMAINS))
