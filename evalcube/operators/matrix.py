"""Per-model score matrices over (task-level row, domain) and the best model per cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import broadcast_if_small

from .clean import ALIAS_COL
from .cube import DOMAINS, LEVELS, TASKS, code_num

# Modes of the best-model matrix: highest score, fewest tokens, best score per token.
MODES = ("quality", "price", "value")


def matrix_input(scored: DataFrame) -> DataFrame:
    """One row per record with scalar labels (the first of each list) and tokens.

    ``row_key`` is "T L"; ``tokens`` is prompt + completion tokens (0 when the
    response carried no usage).
    """
    t = F.try_element_at("label_task", F.lit(1))
    d = F.try_element_at("label_domain", F.lit(1))
    lv = F.try_element_at("label_level", F.lit(1))
    tokens = F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(F.col("completion_tokens"), F.lit(0))
    return (scored.filter(F.col(ALIAS_COL).isNotNull())
                  .select("id", ALIAS_COL, t.alias("T"), lv.alias("L"), d.alias("D"), "quality",
                          tokens.cast("long").alias("tokens"))
                  .filter(F.col("T").isin(TASKS) & F.col("L").isin(LEVELS) & F.col("D").isin(DOMAINS)))


def model_matrix(scored: DataFrame, ids: DataFrame, levels: list[str] | None = None,
                 tasks: list[str] | None = None) -> DataFrame:
    """Long matrix: per (model, "T L", D) the last value (largest id), the mean and the count.

    ``levels`` and ``tasks`` restrict the rows (the 33-row layout holds T1 to T11). One partially aggregated group-by; a hot cell is
    folded map-side into one buffer per task.
    """
    m = matrix_input(scored)
    if tasks:
        m = m.filter(F.col("T").isin(tasks))
    if levels:
        m = m.filter(F.col("L").isin(levels))
    agg = m.groupBy(ALIAS_COL, "T", "L", "D").agg(
        F.max_by("quality", "id").alias("quality_last"),
        F.avg("quality").alias("quality_mean"),
        F.max_by("tokens", "id").alias("tokens_last"),
        F.count(F.lit(1)).alias("n"))
    return (agg.join(broadcast_if_small(ids), ALIAS_COL)
               .select(ALIAS_COL, "llm_id", F.concat_ws(" ", "T", "L").alias("row_key"), "T", "L", "D",
                       F.round("quality_last", 9).alias("quality_last"),
                       F.round("quality_mean", 9).alias("quality_mean"),
                       "tokens_last", "n"))


def _metric(mode: str, value: str) -> Column:
    q = F.col(value)
    tok = F.col("tokens_last")
    if mode == "quality":
        return F.when(q.isNotNull() & ~F.isnan(q), q)
    if mode == "price":
        return F.when(tok > 0, tok.cast("double"))
    if mode == "value":
        return F.when(tok > 0, q / tok * 100)
    raise ValueError(f"unknown mode {mode}")


def best_model(matrix: DataFrame, mode: str = "quality", value: str = "quality_last") -> DataFrame:
    """Best model per (row, D): max score, min tokens (> 0) or max score/tokens*100.

    Ties go to the model that appeared first (lowest ``llm_id``). A struct
    max/min per cell is an ordinary hash aggregate (no window, no sort).
    """
    met = _metric(mode, value)
    src = matrix.select("row_key", "T", "L", "D", ALIAS_COL, "llm_id", met.alias("metric")).filter(
        F.col("metric").isNotNull())
    if mode == "price":
        pick = F.min(F.struct(F.col("metric"), F.col("llm_id"), F.col(ALIAS_COL)))
    else:
        pick = F.max(F.struct(F.col("metric"), (-F.col("llm_id")).alias("neg_id"), F.col(ALIAS_COL)))
    best = src.groupBy("row_key", "T", "L", "D").agg(pick.alias("b"))
    return best.select(
        "row_key", "T", "L", "D", F.col("b")[ALIAS_COL].alias(ALIAS_COL),
        F.round(F.col("b.metric"), 9).alias("best_value"),
        F.concat(F.col("b")[ALIAS_COL], F.lit("\n"), fixed3(F.col("b.metric"))).alias("cell_label"))


@F.pandas_udf(T.StringType())
def fixed3(v: pd.Series) -> pd.Series:
    """Three decimals, correctly rounded from the binary value (Python/C rule).

    Spark's ``format_string`` rounds half-up on the shortest decimal form and
    ``bround`` half-even on it, so 0.0625 and 0.6475 would differ from the
    display rule; this helper runs on the small per-cell result only.
    """
    return v.map(lambda x: None if pd.isna(x) else f"{x:.3f}")


def row_order(df: DataFrame) -> DataFrame:
    """Natural order of the rows (T2 before T10), then domains."""
    return df.orderBy(code_num(F.col("T")), code_num(F.col("L")), code_num(F.col("D")))
