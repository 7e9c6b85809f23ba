"""Queries of the portfolio frontier (§2.8 H2, H4, H5; §2.5 E9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier as FR
from .q_cube import _stage, cube_sql
from .registry import query

HULL_CTES = f""",
fx AS (
  SELECT T, D, L, llm_id, CAST(round(cost * {FR.COST_SCALE}) AS BIGINT) AS c,
         CAST(round(quality * {FR.QUALITY_SCALE}) AS BIGINT) AS q
  FROM fronts
),
hv AS (
  SELECT p.* FROM fx p WHERE NOT EXISTS (
    SELECT 1 FROM fx a JOIN fx b ON a.T = b.T AND a.D = b.D AND a.L = b.L
    WHERE a.T = p.T AND a.D = p.D AND a.L = p.L AND a.c < p.c AND p.c < b.c
      AND CAST(p.q - a.q AS HUGEINT) * (b.c - a.c) <= CAST(b.q - a.q AS HUGEINT) * (p.c - a.c))
),
hvi AS (SELECT *, CAST(row_number() OVER (PARTITION BY T, D, L ORDER BY c) - 1 AS INTEGER) AS vidx FROM hv),
edges AS (
  SELECT *, CAST(dq AS DOUBLE) / CAST(dc AS DOUBLE) AS slope,
         (CAST(substr(T, 2) AS INTEGER) - 1) * 30 + (CAST(substr(D, 2) AS INTEGER) - 1) * 3
           + CAST(substr(L, 2) AS INTEGER) - 1 AS cell_idx
  FROM (SELECT *, c - lag(c) OVER (PARTITION BY T, D, L ORDER BY vidx) AS dc,
               q - lag(q) OVER (PARTITION BY T, D, L ORDER BY vidx) AS dq FROM hvi)
  WHERE vidx > 0
),
st AS (SELECT sum(c) AS c0, sum(q) AS q0 FROM hvi WHERE vidx = 0),
ranked AS (
  SELECT row_number() OVER w AS step, T, D, L, llm_id,
         sum(dc) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdc,
         sum(dq) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdq
  FROM edges WINDOW w AS (ORDER BY slope DESC, cell_idx, vidx)
),
hull AS (
  SELECT 0 AS step, CAST(NULL AS VARCHAR) AS T, CAST(NULL AS VARCHAR) AS D, CAST(NULL AS VARCHAR) AS L, CAST(NULL AS INTEGER) AS llm_id, c0 AS c, q0 AS q FROM st
  UNION ALL
  SELECT step, T, D, L, llm_id, (SELECT c0 FROM st) + cdc, (SELECT q0 FROM st) + cdq FROM ranked
),
hull_pts AS (
  SELECT h.step, h.T, h.D, h.L, h.llm_id, i.answerer_llm_alias,
         round(h.c / {FR.COST_SCALE}, 9) AS cost, round(h.q / {FR.QUALITY_SCALE}, 9) AS quality
  FROM hull h LEFT JOIN ids i ON i.llm_id = h.llm_id
)"""


def _hull(spark, sf_dir):
    st = _stage(spark, sf_dir)
    return FR.supported_frontier(st["fronts"], st["ids"], buckets=16)


@query("cell_hulls", cube_sql(HULL_CTES + """
SELECT T, D, L, vidx, llm_id, c AS cost_fx, q AS quality_fx FROM hvi"""))
def cell_hulls(spark, sf_dir):
    return FR.cell_hulls(_stage(spark, sf_dir)["fronts"])


@query("frontier_hull", cube_sql(HULL_CTES + """
SELECT step, T, D, L, llm_id, answerer_llm_alias, cost, quality FROM hull_pts"""))
def frontier_hull(spark, sf_dir):
    return _hull(spark, sf_dir)


@query("frontier_summary", cube_sql(HULL_CTES + """
SELECT count(*) AS n_points, min(cost) AS min_cost, max(cost) AS max_cost,
       min(quality) AS min_quality, max(quality) AS max_quality FROM hull_pts"""))
def frontier_summary(spark, sf_dir):
    h = _hull(spark, sf_dir)
    return h.agg(F.count(F.lit(1)).alias("n_points"), F.min("cost").alias("min_cost"),
                 F.max("cost").alias("max_cost"), F.min("quality").alias("min_quality"),
                 F.max("quality").alias("max_quality"))


@query("frontier_thinned", cube_sql(HULL_CTES + """
, pts AS (SELECT step, CAST(round(cost * 1000000000) AS BIGINT) AS c,
                 CAST(round(quality * 1000000) AS BIGINT) AS q, cost, quality FROM hull_pts),
nx AS (
  SELECT a.step, min(b.step) AS nxt FROM pts a JOIN pts b
    ON b.step > a.step AND (b.c - a.c >= 10000000 OR b.q - a.q >= 500000)
  GROUP BY a.step
),
chain AS (
  SELECT * FROM (
    WITH RECURSIVE walk(step) AS (
      SELECT CAST(0 AS BIGINT) UNION ALL SELECT n.nxt FROM walk w JOIN nx n ON n.step = w.step)
    SELECT step FROM walk)
)
SELECT step, cost, quality FROM pts WHERE step IN (SELECT step FROM chain)"""))
def frontier_thinned(spark, sf_dir):
    return FR.thin_frontier(_hull(spark, sf_dir).select("step", "cost", "quality"))
