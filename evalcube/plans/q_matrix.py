"""Queries of the model matrices and best-model matrices (§2.5 E3/E4, §2.8 H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cube as K
from ..operators import matrix as M
from ..operators.clean import ALIAS_COL
from .dashboard import scored_slim
from .q_cube import _stage, cube_sql
from .registry import query

A = ALIAS_COL
_T = ", ".join(f"'{c}'" for c in K.TASKS)
_D = ", ".join(f"'{c}'" for c in K.DOMAINS)
_L = ", ".join(f"'{c}'" for c in K.LEVELS)

MATRIX_CTES = f""",
mi AS (
  SELECT * FROM (
    SELECT id, answerer_llm_alias, label_task[1] AS T, label_level[1] AS L, label_domain[1] AS D, quality,
           CAST(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS BIGINT) AS tokens
    FROM scored WHERE answerer_llm_alias IS NOT NULL)
  WHERE T IN ({_T}) AND L IN ({_L}) AND D IN ({_D})
),
mm AS (
  SELECT m.answerer_llm_alias, i.llm_id, m.T || ' ' || m.L AS row_key, m.T, m.L, m.D,
         round(arg_max(m.quality, m.id), 9) AS quality_last, round(avg(m.quality), 9) AS quality_mean,
         arg_max(m.tokens, m.id) AS tokens_last, count(*) AS n
  FROM mi m JOIN ids i USING (answerer_llm_alias)
  GROUP BY m.answerer_llm_alias, i.llm_id, m.T, m.L, m.D
)"""


def _matrix(spark, sf_dir):
    st = _stage(spark, sf_dir)
    return M.model_matrix(scored_slim(spark, sf_dir), st["ids"])


@query("model_matrix", cube_sql(MATRIX_CTES + """
SELECT answerer_llm_alias, llm_id, row_key, T, L, D, quality_last, quality_mean, tokens_last, n FROM mm"""))
def model_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("model_matrix_l1", cube_sql(MATRIX_CTES + """
SELECT answerer_llm_alias, llm_id, row_key, T, L, D, quality_last, quality_mean, tokens_last, n
FROM mm WHERE L = 'L1' AND T <> 'T12'"""))
def model_matrix_l1(spark, sf_dir):
    st = _stage(spark, sf_dir)
    return M.model_matrix(scored_slim(spark, sf_dir), st["ids"], levels=["L1"], tasks=[f"T{i}" for i in range(1, 12)])


def _best_sql(metric: str, order: str) -> str:
    return cube_sql(MATRIX_CTES + f""",
bm AS (
  SELECT row_key, T, L, D, answerer_llm_alias, {metric} AS metric,
         row_number() OVER (PARTITION BY row_key, D ORDER BY {metric} {order}, llm_id ASC) AS r
  FROM mm WHERE {metric} IS NOT NULL
)
SELECT row_key, T, L, D, answerer_llm_alias, round(metric, 9) AS best_value,
       answerer_llm_alias || chr(10) || printf('%.3f', metric) AS cell_label
FROM bm WHERE r = 1""")


@query("best_quality", _best_sql("quality_last", "DESC"))
def best_quality(spark, sf_dir):
    return M.best_model(_matrix(spark, sf_dir), "quality")


@query("best_price", _best_sql("CASE WHEN tokens_last > 0 THEN CAST(tokens_last AS DOUBLE) END", "ASC"))
def best_price(spark, sf_dir):
    return M.best_model(_matrix(spark, sf_dir), "price")


@query("best_value", _best_sql(
    "CASE WHEN tokens_last > 0 THEN quality_last / tokens_last * 100 END", "DESC"))
def best_value(spark, sf_dir):
    return M.best_model(_matrix(spark, sf_dir), "value")


@query("best_quality_mean", _best_sql("quality_mean", "DESC"))
def best_quality_mean(spark, sf_dir):
    return M.best_model(_matrix(spark, sf_dir), "quality", value="quality_mean")


@query("model_comparison", cube_sql(MATRIX_CTES + """
SELECT row_key, D, count(*) AS n_models, round(max(quality_last), 9) AS max_quality,
       round(min(quality_last), 9) AS min_quality, round(avg(quality_last), 9) AS mean_quality
FROM mm GROUP BY 1, 2"""))
def model_comparison(spark, sf_dir):
    mm = _matrix(spark, sf_dir)
    return mm.groupBy("row_key", "D").agg(
        F.count(F.lit(1)).alias("n_models"), F.round(F.max("quality_last"), 9).alias("max_quality"),
        F.round(F.min("quality_last"), 9).alias("min_quality"),
        F.round(F.avg("quality_last"), 9).alias("mean_quality"))
