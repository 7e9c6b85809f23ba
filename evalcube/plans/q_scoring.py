"""Queries of prompts, criteria scores, similarity, batch judging and answers (§2.1, 2.4, 2.6, 2.7, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.criteria_parse import MISSING_REASON, NO_DOCUMENT, NO_OBJECT, single_score
from ..operators import prompts as PR
from ..operators import scoring as S
from ..operators.clean import ALIAS_COL, GROUP_COL, primary_task
from ..sources.fixtures import MODEL_ALIASES, criteria_replies, judged_records
from ..sources.tables import read_table
from .dashboard import cleaned_records, scored_slim
from .oracle_base import REC_CTES, with_rec, with_scored
from .registry import query

A = ALIAS_COL


def _q(s: str) -> str:
    return s.replace("'", "''")


_RUBRIC_VALUES = ", ".join(
    f"('{t}', '{rule}', {i + 1}, '{_q(n)}', CAST({w!r} AS DOUBLE), {len(crit)})"
    for t, (rule, crit) in PR.RUBRICS.items() for i, (n, w) in enumerate(crit))
_ROUTING_VALUES = ", ".join(f"('{t}', '{k}')" for t, k in PR.TASK_TEMPLATE)

CRIT_CTES = REC_CTES + f""",
rubric(template, rule, position, criterion, weight, n) AS (VALUES {_RUBRIC_VALUES}),
routing(task, template) AS (VALUES {_ROUTING_VALUES}),
crit AS (
  SELECT c.e AS id, c.alias AS answerer_llm_alias, c.q100, c.jstatus, r.template, b.rule, b.position,
         b.criterion, b.weight, b.n, (b.position = b.n AND c.e % 7 = 0) AS omitted
  FROM cleaned c JOIN routing r ON r.task = c.label_task[1] JOIN rubric b ON b.template = r.template
),
cs AS (
  SELECT id, answerer_llm_alias, template, criterion,
         CASE WHEN omitted THEN -1.0 ELSE CAST((id + 3 * position) % 11 AS DOUBLE) END AS score,
         CASE WHEN omitted THEN '{MISSING_REASON}' ELSE 'ok' END AS feedback
  FROM crit
)"""


def crit_sql(body: str) -> str:
    return "WITH " + CRIT_CTES + "\n" + body


def _replies(spark, sf_dir):
    # Read by five queries: written once per application to the shared folder.
    from ..session import materialize
    return materialize(spark, lambda: criteria_replies(cleaned_records(spark, sf_dir)),
                       ("criteria-replies", sf_dir), "criteria-replies")


def _scores(spark, sf_dir):
    return S.criteria_scores(_replies(spark, sf_dir))


@query("route_templates", crit_sql("""
SELECT c.e AS id, c.label_task[1] AS primary_task, r.template,
       CASE WHEN r.template IS NULL THEN 'unrouted' ELSE 'routed' END AS route_status
FROM cleaned c LEFT JOIN routing r ON r.task = c.label_task[1]"""))
def route_templates(spark, sf_dir):
    df = cleaned_records(spark, sf_dir).withColumn("primary_task", primary_task(F.col("label_task")))
    t = PR.template_of(F.col("primary_task"))
    return df.select("id", "primary_task", t.alias("template"),
                     F.when(t.isNull(), "unrouted").otherwise("routed").alias("route_status"))


def _prompt_sql() -> str:
    # The same three placeholders filled by literal concatenation in DuckDB.
    import re
    cases = []
    for key, body in PR.TEMPLATES.items():
        crit_text = "\n".join("%d. %s (max %.1f) (weight %.2f)" % (i + 1, n, 10.0, w)
                              for i, (n, w) in enumerate(PR.RUBRICS[key][1]))
        parts, pos = [], 0
        for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", body):
            parts.append("'" + _q(body[pos:m.start()]) + "'")
            name = m.group(1)
            parts.append({"prompt": "req", "response": "res", "reference_data": "''",
                          "criteria": "'" + _q(crit_text) + "'"}[name])
            pos = m.end()
        parts.append("'" + _q(body[pos:]) + "'")
        cases.append(f"WHEN r.template = '{key}' THEN " + " || ".join(parts))
    return crit_sql(f"""
, pr AS (
  SELECT c.e AS id, r.template, concat('q', c.g) AS req,
         CASE WHEN c.e % 113 = 0 THEN '' ELSE concat('r', c.e) END AS res
  FROM cleaned c LEFT JOIN routing r ON r.task = c.label_task[1]
)
SELECT id, template, CASE WHEN template IS NULL THEN 'unrouted' ELSE 'routed' END AS route_status,
       CASE {' '.join(cases)} END AS eval_prompt
FROM pr r""".lstrip())


@query("render_prompts", _prompt_sql())
def render_prompts(spark, sf_dir):
    from ..operators.clean import eval_projection
    df = judged_records(spark, sf_dir)
    ev = eval_projection(df.filter(F.col("label_task").isNotNull() & F.col("eval_result").isNotNull()))
    ev = ev.withColumn("primary_task", primary_task(F.col("label_task")))
    return PR.with_judge_prompt(ev).select("id", "template", "route_status", "eval_prompt")


@query("criteria_scores", crit_sql("""
SELECT id, answerer_llm_alias, template, criterion, score, feedback FROM cs"""))
def criteria_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("criteria_backfill", crit_sql("""
SELECT id, template, criterion, score, feedback FROM cs WHERE feedback <> 'ok'"""))
def criteria_backfill(spark, sf_dir):
    return _scores(spark, sf_dir).filter(F.col("feedback") == MISSING_REASON).select(
        "id", "template", "criterion", "score", "feedback")


@query("criteria_failures", crit_sql(f"""
SELECT id, template, criterion, -1.0::DOUBLE AS score,
       CASE WHEN id % 5 = 0 THEN '{NO_OBJECT}{{score 3}}' WHEN id % 3 = 0 THEN '{MISSING_REASON}' ELSE '{NO_DOCUMENT}' END AS feedback
FROM crit WHERE omitted"""))
def criteria_failures(spark, sf_dir):
    # every fifth reply ends in an object that can't be read
    cut = F.when(F.col("id") % 5 == 0, F.concat("reply", F.lit("\n{score 3}"))).otherwise(F.col("reply"))
    scores = S.criteria_scores(_replies(spark, sf_dir).withColumn("reply", cut), reasons=True)
    return scores.filter("score = -1").select("id", "template", "criterion", "score", "feedback")


@query("criteria_means", crit_sql("""
SELECT answerer_llm_alias, template, criterion, round(avg(score), 9) AS mean_score, count(*) AS n
FROM cs GROUP BY 1, 2, 3"""))
def criteria_means(spark, sf_dir):
    return S.criteria_means(_scores(spark, sf_dir))


@query("criteria_weighted_avg", crit_sql("""
, m AS (SELECT answerer_llm_alias, template, criterion, round(avg(score), 9) AS mean_score FROM cs GROUP BY 1, 2, 3)
SELECT m.answerer_llm_alias, m.template,
       round(coalesce(CASE WHEN sum(b.weight) > 0 THEN sum(m.mean_score * b.weight) / sum(b.weight) END, 0.0), 9)
         AS weighted_avg
FROM m LEFT JOIN rubric b ON b.template = m.template AND b.criterion = m.criterion
GROUP BY 1, 2"""))
def criteria_weighted_avg(spark, sf_dir):
    return S.criteria_weighted_avg(S.criteria_means(_scores(spark, sf_dir)), spark)


@query("rubric_total_audit", crit_sql("""
, p AS (
  SELECT id, answerer_llm_alias, template, rule, q100, jstatus,
         count(*) AS n_criteria, sum((id + 3 * position) % 11 * weight) AS sw, sum(weight) AS ws
  FROM crit WHERE NOT omitted GROUP BY ALL
)
SELECT id, answerer_llm_alias, template, rule, n_criteria, round(sw / ws / 10.0, 9) AS recomputed_total,
       CASE WHEN jstatus = 'ok' THEN CAST(q100 AS DOUBLE) / 100.0 END AS claimed_total,
       round(CASE WHEN jstatus = 'ok' THEN CAST(q100 AS DOUBLE) / 100.0 END - sw / ws / 10.0, 9) + 0.0 AS difference
FROM p"""))
def rubric_total_audit(spark, sf_dir):
    return S.rubric_total_audit(_replies(spark, sf_dir))


@query("single_score", with_rec("""
SELECT e AS id, CASE WHEN e % 13 = 0 THEN 0.0 ELSE CAST(e % 11 AS DOUBLE) END AS score,
       CASE WHEN e % 13 = 0 THEN 'parse failed' ELSE 'good' END AS feedback
FROM rec"""))
def single_score_q(spark, sf_dir):
    df = judged_records(spark, sf_dir)
    e = F.col("id")
    reply = F.when(e % 13 == 0, F.lit("피드백: fine")).otherwise(F.concat(
        F.lit("Verdict\n점수: "), (e % 11).cast("string"), F.lit("\n피드백: good: more detail")))
    s = single_score(reply)
    return df.select("id", s["score"].alias("score"), s["feedback"].alias("feedback"))


@query("prompt_scores", with_scored("""
SELECT lr_answer_bronze_id, answerer_llm_alias, round(avg(quality), 9) AS mean_quality, count(*) AS n
FROM scored GROUP BY 1, 2"""))
def prompt_scores(spark, sf_dir):
    return scored_slim(spark, sf_dir).groupBy(GROUP_COL, A).agg(
        F.round(F.avg("quality"), 9).alias("mean_quality"), F.count(F.lit(1)).alias("n"))


@query("run_duration", """
WITH u AS (
  SELECT user_id, min(ts) AS started, max(ts) AS ended,
         (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s
  FROM events GROUP BY 1
)
SELECT user_id, CAST(s AS BIGINT) AS seconds,
       CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, '
            ELSE CAST(s // 86400 AS VARCHAR) || ' days, ' END
       || printf('%d:%02d:%02d', (s % 86400) // 3600, (s % 3600) // 60, s % 60) AS duration
FROM u""")
def run_duration(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    u = ev.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    secs = F.floor(F.timestamp_diff("MICROSECOND", F.col("started"), F.col("ended")) / 1_000_000).cast("long")
    return u.select("user_id", secs.alias("seconds"),
                    S.run_duration(F.col("started"), F.col("ended")).alias("duration"))


_PAIRS_SQL = r"""
WITH pairs AS (
  SELECT u.conv_id, u.turn, u.text AS req, a.text AS res
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
),
tok AS (
  SELECT conv_id, turn, req, res,
         list_distinct(list_filter(regexp_split_to_array(res, '\s+'), lambda x: x <> '')) AS ta,
         list_distinct(list_filter(regexp_split_to_array(req, '\s+'), lambda x: x <> '')) AS tb
  FROM pairs
),
sim AS (
  SELECT conv_id, turn, req,
         CASE WHEN req IS NULL OR req = '' THEN 0.0
              WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0.0
              ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS j
  FROM tok
)"""


@query("reference_similarity", _PAIRS_SQL + """
SELECT conv_id, turn, round(j * 10.0, 9) AS similarity FROM sim""")
def reference_similarity(spark, sf_dir):
    pairs = S.conversation_pairs(read_table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn",
                        F.round(S.reference_similarity(F.col("res"), F.col("req")), 9).alias("similarity"))


@query("judge_offline", _PAIRS_SQL + """
SELECT conv_id, turn, 'reason' AS template, 'ok' AS status, round(j, 9) AS quality FROM sim""")
def judge_offline(spark, sf_dir):
    pairs = S.conversation_pairs(read_table(spark, sf_dir, "conversations"))
    work = (pairs.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
                 .withColumn("ref", F.col("req"))
                 .withColumn("primary_task", F.lit("T11")))
    work = PR.with_judge_prompt(work)
    judged = S.judge_batch(work)
    return judged.select("conv_id", "turn", "template", F.col("judge.status").alias("status"),
                         F.round("judge.score", 9).alias("quality"))


@query("missing_answers", with_rec(f"""
, want AS (SELECT DISTINCT g FROM rec),
models(alias) AS (VALUES {", ".join(f"('{m}')" for m in MODEL_ALIASES)})
SELECT w.g AS lr_answer_bronze_id, m.alias AS answerer_llm_alias
FROM want w CROSS JOIN models m
WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.g = w.g AND r.alias = m.alias)"""))
def missing_answers(spark, sf_dir):
    recs = judged_records(spark, sf_dir)
    return S.missing_answers(recs, recs, MODEL_ALIASES)


@query("answers_wide", with_rec(", " + """
w AS (SELECT g, """ + ", ".join(
    f"max(CASE WHEN alias = '{m}' THEN concat('r', e) END) AS \"{m}_response\"" for m in MODEL_ALIASES) + """
      FROM rec GROUP BY g)
SELECT g AS lr_answer_bronze_id, """ + ", ".join(f'"{m}_response"' for m in MODEL_ALIASES) + " FROM w"))
def answers_wide(spark, sf_dir):
    return S.answers_wide(judged_records(spark, sf_dir), MODEL_ALIASES)
