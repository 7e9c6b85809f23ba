"""Queries of the cube, per-cell fronts, best portfolio and routing tables (§2.4-2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small

from ..operators import cube as K
from ..operators import frontier as FR
from ..operators import pareto as PA
from ..operators.clean import ALIAS_COL
from ..session import materialize
from .dashboard import cube_stage, scored_slim
from .oracle_base import SCORED_CTES
from .registry import query

A = ALIAS_COL
_T = ", ".join(f"'{c}'" for c in K.TASKS)
_D = ", ".join(f"'{c}'" for c in K.DOMAINS)
_L = ", ".join(f"'{c}'" for c in K.LEVELS)


def _by_weight(c: str) -> str:
    """Totals of the fixture's |T||D||L| (1, 2, 4), divided and added in ascending order."""
    return " + ".join(f"coalesce(CAST(sum({c}) FILTER (WHERE n = {n}) AS DOUBLE), 0) / {n}" for n in (1, 2, 4))


# DuckDB: cube -> ids -> dense -> candidates -> fronts, all from the formulas.
CUBE_CTES = SCORED_CTES + f""",
x1 AS (SELECT answerer_llm_alias, CAST(round(quality * {K.QUALITY_UNITS}) AS BIGINT) AS q, CAST(round(cost * {K.COST_UNITS}) AS BIGINT) AS c,
              label_domain, label_level, len(label_task) * len(label_domain) * len(label_level) AS n, unnest(label_task) AS T FROM scored),
x2 AS (SELECT answerer_llm_alias, q, c, label_level, n, T, unnest(label_domain) AS D FROM x1),
x3 AS (SELECT answerer_llm_alias, q, c, n, T, D, unnest(label_level) AS L FROM x2),
x4 AS (
  SELECT answerer_llm_alias, T, D, L, n, count(*) AS k, sum(q) AS q, sum(c) AS c
  FROM x3 WHERE T IN ({_T}) AND D IN ({_D}) AND L IN ({_L}) GROUP BY 1, 2, 3, 4, 5
),
cube AS (
  SELECT answerer_llm_alias, T, D, L, round({_by_weight("k")}, 12) AS count,
         round(({_by_weight("q")}) / {float(K.QUALITY_UNITS)!r}, 12) AS quality, round(({_by_weight("c")}) / {float(K.COST_UNITS)!r}, 12) AS cost
  FROM x4 GROUP BY 1, 2, 3, 4
),
ids AS (
  SELECT answerer_llm_alias,
         CAST(row_number() OVER (ORDER BY min(id), answerer_llm_alias) - 1 AS INTEGER) AS llm_id
  FROM scored GROUP BY 1
),
tmpl AS (
  SELECT concat('T', a.t) AS T, concat('D', b.d) AS D, concat('L', c.l) AS L
  FROM range(1, 13) a(t), range(1, 11) b(d), range(1, 4) c(l)
),
dense AS (
  SELECT i.answerer_llm_alias, i.llm_id, t.T, t.D, t.L,
         coalesce(c.count, 0.0) AS count, coalesce(c.quality, 0.0) AS quality,
         coalesce(c.cost, 0.0) AS cost
  FROM ids i CROSS JOIN tmpl t
  LEFT JOIN cube c ON c.answerer_llm_alias = i.answerer_llm_alias AND c.T = t.T AND c.D = t.D AND c.L = t.L
),
cands AS (
  SELECT * FROM dense WHERE (T, D, L) IN (SELECT (T, D, L) FROM dense WHERE llm_id = 0 AND count <> 0)
),
fr AS (
  SELECT *, max(quality) OVER (PARTITION BY T, D, L
             ORDER BY floor(cost * 1e7 + 0.5) ASC, floor(quality * 1e7 + 0.5) DESC, llm_id ASC
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM cands WHERE NOT isnan(quality)
),
fronts AS (
  SELECT * EXCLUDE (prev), count(*) OVER (PARTITION BY T, D, L) AS front_size
  FROM fr WHERE prev IS NULL OR quality > prev
),
endp AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY T, D, L
                         ORDER BY quality DESC, cost ASC, llm_id ASC) AS r FROM fronts) WHERE r = 1
),
best AS (SELECT * FROM endp WHERE front_size >= 2),
basep AS (
  SELECT count(*) AS n_cells, round(coalesce(sum(quality), 0.0), 9) AS quality,
         round(coalesce(sum(cost), 0.0), 9) AS cost FROM fronts WHERE front_size = 1
)"""


def cube_sql(body: str) -> str:
    return "WITH RECURSIVE " + CUBE_CTES + "\n" + body


def _stage(spark, sf_dir):
    return cube_stage(scored_slim(spark, sf_dir), key=("cube-stage", sf_dir))


_CELL_COLS = ["T", "D", "L"]


@query("tld_cube", cube_sql("SELECT answerer_llm_alias, T, D, L, count, quality, cost FROM cube"))
def tld_cube(spark, sf_dir):
    return _stage(spark, sf_dir)["cube"]


@query("dense_cube", cube_sql("SELECT answerer_llm_alias, T, D, L, count, quality, cost FROM dense"))
def dense_cube(spark, sf_dir):
    return _stage(spark, sf_dir)["dense"].select(A, *_CELL_COLS, "count", "quality", "cost")


@query("model_totals", cube_sql("""
SELECT answerer_llm_alias, round(sum(count), 9) AS count, round(sum(quality), 9) AS quality,
       round(sum(cost), 9) AS cost FROM cube GROUP BY 1"""))
def model_totals(spark, sf_dir):
    return K.model_totals(_stage(spark, sf_dir)["cube"])


@query("model_ids", cube_sql("SELECT answerer_llm_alias, llm_id FROM ids"))
def model_ids(spark, sf_dir):
    return _stage(spark, sf_dir)["ids"]


@query("cell_candidates", cube_sql("""
SELECT T, D, L, llm_id, answerer_llm_alias, count, quality, cost FROM cands"""))
def cell_candidates(spark, sf_dir):
    return _stage(spark, sf_dir)["candidates"].select(*_CELL_COLS, "llm_id", A, "count", "quality", "cost")


@query("cell_pareto", cube_sql("""
SELECT T, D, L, llm_id, answerer_llm_alias, quality, cost, front_size FROM fronts"""))
def cell_pareto(spark, sf_dir):
    return _stage(spark, sf_dir)["fronts"].select(*_CELL_COLS, "llm_id", A, "quality", "cost", "front_size")


@query("cells_by_front_size", cube_sql("""
SELECT DISTINCT T, D, L, front_size, CASE WHEN front_size = 1 THEN 'single' ELSE 'multi' END AS kind
FROM fronts"""))
def cells_by_front_size(spark, sf_dir):
    f = _stage(spark, sf_dir)["fronts"]
    return f.select(*_CELL_COLS, "front_size",
                    F.when(F.col("front_size") == 1, "single").otherwise("multi").alias("kind")).distinct()


@query("base_point", cube_sql("SELECT n_cells, quality, cost FROM basep"))
def base_point(spark, sf_dir):
    return PA.base_point(_stage(spark, sf_dir)["fronts"])


@query("best_portfolio", cube_sql("""
SELECT T, D, L, llm_id, answerer_llm_alias, quality, cost FROM best"""))
def best_portfolio(spark, sf_dir):
    return PA.best_portfolio(_stage(spark, sf_dir)["fronts"]).select(
        *_CELL_COLS, "llm_id", A, "quality", "cost")


# Exact frontier of the portfolios of each task's cells, folded cell by cell, and its chart points.
TASK_CTES = f""",
opt AS (
  SELECT T, CAST(round(cost * {FR.COST_SCALE}) AS BIGINT) AS c, CAST(round(quality * {FR.QUALITY_SCALE}) AS BIGINT) AS q, llm_id,
         dense_rank() OVER (PARTITION BY T ORDER BY CAST(substr(D, 2) AS INTEGER), CAST(substr(L, 2) AS INTEGER)) AS k
  FROM fronts
),
fold AS (
  SELECT DISTINCT T, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS q, CAST([] AS INTEGER[]) AS p FROM opt
  UNION ALL
  SELECT T, k, c, q, p FROM (
    SELECT *, max(q) OVER (PARTITION BY T ORDER BY c, q DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM (SELECT f.T, o.k, f.c + o.c AS c, f.q + o.q AS q, list_append(f.p, o.llm_id) AS p
          FROM fold f JOIN opt o ON o.T = f.T AND o.k = f.k + 1))
  WHERE best IS NULL OR q > best
),
task_front AS (
  SELECT T, row_number() OVER (PARTITION BY T ORDER BY c) - 1 AS step, c, q, p
  FROM fold WHERE k = (SELECT max(k) FROM opt o WHERE o.T = fold.T)
)"""

TASK_THIN_CTES = TASK_CTES + """,
task_next AS (
  SELECT a.T, a.step, min(b.step) AS nxt FROM task_front a JOIN task_front b
    ON b.T = a.T AND b.step > a.step AND (b.c - a.c >= 10000000 OR b.q - a.q >= 500000) GROUP BY 1, 2
),
task_chain AS (
  SELECT DISTINCT T, CAST(0 AS BIGINT) AS step FROM task_front
  UNION ALL SELECT n.T, n.nxt FROM task_chain w JOIN task_next n ON n.T = w.T AND n.step = w.step
),
task_thin AS (
  SELECT f.T, f.step, """ + f"""round(f.c / {FR.COST_SCALE}, 9) AS cost, round(f.q / {FR.QUALITY_SCALE}, 9) AS quality
  FROM task_front f JOIN task_chain USING (T, step)
)"""


def _task_frontier(spark, sf_dir):
    """The frontier of each task's portfolios, written once per application."""
    fronts = _stage(spark, sf_dir)["fronts"]
    return materialize(spark, lambda: FR.exact_frontier(fronts, ["T"]), ("task-frontier", sf_dir), "task-frontier")


@query("frontier_by_task", cube_sql(TASK_CTES + f"""
SELECT T, step, round(c / {FR.COST_SCALE}, 9) AS cost, round(q / {FR.QUALITY_SCALE}, 9) AS quality, p AS llm_ids FROM task_front"""))
def frontier_by_task(spark, sf_dir):
    return _task_frontier(spark, sf_dir)


@query("task_frontier_thinned", cube_sql(TASK_THIN_CTES + "\nSELECT T, step, cost, quality FROM task_thin"))
def task_frontier_thinned(spark, sf_dir):
    return FR.thin_frontier(_task_frontier(spark, sf_dir), ["T"]).select("T", "step", "cost", "quality")


def _best_point(st):
    """End point of the portfolio frontier: base + sum of multi-cell end points."""
    best = PA.best_portfolio(st["fronts"]).agg(F.sum("quality").alias("bq"), F.sum("cost").alias("bc"))
    base = PA.base_point(st["fronts"])
    # Two one-row aggregates combined through scalar subqueries.
    return base.select(
        F.round(F.col("quality") + F.coalesce(best.select("bq").scalar(), F.lit(0.0)), 9).alias("quality"),
        F.round(F.col("cost") + F.coalesce(best.select("bc").scalar(), F.lit(0.0)), 9).alias("cost"))


def label_round(c, d: int):
    """Chart labels: half-even on the 9-digit decimal form of the value.

    Rounding the decimal form (not the binary one) makes labels identical in
    every engine; a sum that prints as 1096.45 is labelled 1096.4.
    """
    return F.bround(F.round(c, 9), d)


def _py_round(x: str, d: int) -> str:
    # DuckDB twin of ``label_round``.
    return f"CAST(round_even(CAST(round({x}, 9) AS DECIMAL(38, 9)), {d}) AS DOUBLE)"


_BEST_POINT_SQL = """
bestpt AS (
  SELECT round(b.quality + coalesce((SELECT sum(quality) FROM best), 0.0), 9) AS quality,
         round(b.cost + coalesce((SELECT sum(cost) FROM best), 0.0), 9) AS cost
  FROM basep b
)"""


@query("gap_to_best", cube_sql(f"""
, {_BEST_POINT_SQL.strip()},
tot AS (SELECT answerer_llm_alias, sum(quality) AS quality, sum(cost) AS cost FROM cube GROUP BY 1)
SELECT t.answerer_llm_alias, round(t.cost, 9) AS model_cost, round(t.quality, 9) AS model_quality,
       bp.cost AS best_cost, bp.quality AS best_quality,
       round(bp.cost - t.cost, 9) AS gap_cost, round(bp.quality - t.quality, 9) AS gap_quality
FROM tot t CROSS JOIN bestpt bp""".lstrip()))
def gap_to_best(spark, sf_dir):
    st = _stage(spark, sf_dir)
    tot = st["cube"].groupBy(A).agg(F.sum("quality").alias("q"), F.sum("cost").alias("c"))
    bp = _best_point(st)
    bc, bq = bp.select("cost").scalar(), bp.select("quality").scalar()
    # One row per model against the one-row best point (scalar subqueries).
    return tot.select(
        A, F.round("c", 9).alias("model_cost"), F.round("q", 9).alias("model_quality"),
        bc.alias("best_cost"), bq.alias("best_quality"),
        F.round(bc - F.col("c"), 9).alias("gap_cost"),
        F.round(bq - F.col("q"), 9).alias("gap_quality"))


@query("quality_cost_points", cube_sql(f"""
{TASK_THIN_CTES}
, {_BEST_POINT_SQL.strip()}
SELECT 'model' AS kind, answerer_llm_alias AS name, round(sum(cost), 9) AS cost,
       round(sum(quality), 9) AS quality, {_py_round("round(sum(cost), 9)", 3)} AS cost_label,
       {_py_round("round(sum(quality), 9)", 1)} AS quality_label
FROM cube GROUP BY 2
UNION ALL
SELECT 'best', 'highest quality', cost, quality, {_py_round("cost", 3)}, {_py_round("quality", 1)} FROM bestpt
UNION ALL
SELECT 'frontier', T, cost, quality, {_py_round("cost", 3)}, {_py_round("quality", 1)} FROM task_thin""".lstrip()))
def quality_cost_points(spark, sf_dir):
    """Points of the quality/cost chart: models, the best portfolio, and the thinned frontier of each task's portfolios."""
    st = _stage(spark, sf_dir)
    models = st["cube"].groupBy(F.col(A).alias("name")).agg(
        F.round(F.sum("cost"), 9).alias("cost"), F.round(F.sum("quality"), 9).alias("quality"))
    models = models.select(F.lit("model").alias("kind"), "name", "cost", "quality")
    best = _best_point(st).select(F.lit("best").alias("kind"), F.lit("highest quality").alias("name"),
                                  "cost", "quality")
    thin = task_frontier_thinned(spark, sf_dir).select(F.lit("frontier").alias("kind"), F.col("T").alias("name"), "cost", "quality")
    return models.unionByName(best).unionByName(thin).withColumns({
        "cost_label": label_round(F.col("cost"), 3), "quality_label": label_round(F.col("quality"), 1)})


def _pivot_sql(value_expr: str) -> str:
    cols = ", ".join(f"max(CASE WHEN b.D = '{d}' THEN {value_expr} END) AS {d}" for d in K.DOMAINS)
    return cube_sql(f"""
, tl AS (SELECT DISTINCT T, L FROM tmpl)
SELECT tl.T, tl.L, {cols}
FROM tl LEFT JOIN best b ON b.T = tl.T AND b.L = tl.L
GROUP BY tl.T, tl.L""".lstrip())


@query("routing_table", _pivot_sql("b.answerer_llm_alias"))
def routing_table(spark, sf_dir):
    best = PA.best_portfolio(_stage(spark, sf_dir)["fronts"])
    return PA.routing_table(best, A, "names")


@query("routing_count_table", cube_sql(", " + """
fc AS (SELECT b.T, b.D, b.L, d.count FROM best b JOIN dense d
       ON d.T = b.T AND d.D = b.D AND d.L = b.L AND d.llm_id = 0),
tl AS (SELECT DISTINCT T, L FROM tmpl)
SELECT tl.T, tl.L, """ + ", ".join(
    f"round(sum(CASE WHEN fc.D = '{d}' THEN fc.count END), 9) AS {d}" for d in K.DOMAINS) + """
FROM tl LEFT JOIN fc ON fc.T = tl.T AND fc.L = tl.L GROUP BY tl.T, tl.L"""))
def routing_count_table(spark, sf_dir):
    st = _stage(spark, sf_dir)
    best = PA.best_portfolio(st["fronts"]).select(*_CELL_COLS)
    first = st["dense"].join(broadcast_if_small(st["ids"]).filter("llm_id = 0"), A).select(*_CELL_COLS, "count")
    return PA.routing_table(best.join(first, _CELL_COLS), "count", "sum")


@query("label_names", cube_sql(", " + """
names(dimension, code, name) AS (VALUES """ + ", ".join(
    f"('{dim}', '{c}', '{n.replace(chr(39), chr(39) * 2)}')"
    for dim, codes, nm in (("task", K.TASKS, K.TASK_NAMES), ("domain", K.DOMAINS, K.DOMAIN_NAMES),
                           ("level", K.LEVELS, K.LEVEL_NAMES)) for c, n in zip(codes, nm)) + """),
used AS (
  SELECT 'task' AS dimension, unnest(label_task) AS code FROM scored
  UNION ALL SELECT 'domain', unnest(label_domain) FROM scored
  UNION ALL SELECT 'level', unnest(label_level) FROM scored
)
SELECT u.dimension, u.code, n.name, count(*) AS n_labels
FROM used u LEFT JOIN names n ON n.dimension = u.dimension AND n.code = u.code
GROUP BY 1, 2, 3"""))
def label_names(spark, sf_dir):
    s = scored_slim(spark, sf_dir)
    used = (s.select(F.lit("task").alias("dimension"), F.explode("label_task").alias("code"))
             .unionByName(s.select(F.lit("domain").alias("dimension"), F.explode("label_domain").alias("code")))
             .unionByName(s.select(F.lit("level").alias("dimension"), F.explode("label_level").alias("code"))))
    counts = used.groupBy("dimension", "code").agg(F.count(F.lit(1)).alias("n_labels"))
    return counts.join(broadcast_if_small(K.label_names(spark)), ["dimension", "code"], "left").select(
        "dimension", "code", "name", "n_labels")


def _routing_runs_sql() -> str:
    whole = _pivot_sql("b.answerer_llm_alias")
    first = whole.replace("FROM events", "FROM events WHERE event_id // 5 % 2 = 0", 1)
    return f"SELECT 1 AS run, * FROM ({first}) UNION ALL SELECT 2 AS run, * FROM ({whole})"


@query("pipeline_routing", _routing_runs_sql())
def pipeline_routing(spark, sf_dir):
    """Routes from a response log's files, before and after the other half of the questions arrives as new files."""
    from ..session import scratch_path
    from ..sources.fixtures import judged_records
    from ..sources.readers import RECORD_DDL
    from .from_files import tables_from_files
    path = scratch_path(spark, "response-log") + ".json"
    recs = judged_records(spark, sf_dir).select(*[c.split()[0] for c in RECORD_DDL.split(", ")])
    runs = []
    for run in (1, 2):
        recs.filter(F.floor(F.col("id") / 5) % 2 == run - 1).write.mode("append").json(path)
        runs.append(tables_from_files(spark, path)["routing"].withColumn("run", F.lit(run)))
    return runs[0].unionByName(runs[1])
