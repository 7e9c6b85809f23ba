"""Queries of user templates, rubrics as data, score rules, results documents, written answers and provider ids."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small, local_table
from ..operators import prompts as PR
from ..operators import rules as RU
from ..operators import templates as TP
from ..operators.answers import AnswerLog, fill_missing
from ..operators.clean import ALIAS_COL, GROUP_COL, eval_projection, primary_task
from ..operators.cost import with_cost
from ..operators.scoring import answers_wide, criteria_scores
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import results_document as DOC
from ..sources.fixtures import MODEL_ALIASES, MODEL_PRICES, judged_records
from ..sources.registry import ALIAS_TO_KEY, alias_map, model_registry, with_provider_id
from ..sources.tables import read_table
from .oracle_base import with_rec
from .q_scoring import _prompt_sql, _q, _replies, _scores, crit_sql
from .registry import query

A = ALIAS_COL

# ---------------------------------------------------------------- templates and rubrics as data
# A user's template file and criteria of the fixture; ``creative`` is left out of the store.
_FILE = """# judge templates
reason: |
  Grade the steps of this answer.
  {% if reference_data %}Reference: {{ reference_data }}
  {% endif %}{% for c in criteria_list %}{{loop.index}}. {{c.name}}: {{c.description}} (max {{c.max_score}}) (weight {{c.weight}})
  {% endfor %}
  Q: {{prompt}}
  A: {{ response }}{{unknown}}

knowledge: |-
  Facts of {{response}} on {{prompt}}
  {% for c in criteria_list %}- {{c.name}} {{c.weight}}{% if prompt %}!{% endif %}
  {% endfor %}
summary: |
    Short? {single} braces stay
      indented {{prompt}}
"""
# (template or None for all, position, name, description, max_score, weight)
_CRITERIA = [("reason", 2, "order", "steps follow", 5.0, 0.25), (None, 1, "truth", "no false claim", None, None),
             ("knowledge", 3, "sources", None, 3.0, 2.5)]


def _rubric_prompt_sql() -> str:
    ref = "CASE WHEN e % 2 = 0 THEN concat('k', g) ELSE '' END"
    return crit_sql(f"""
, pr AS (
  SELECT c.e, c.g, r.template, concat('q', c.g) AS req, CASE WHEN c.e % 113 = 0 THEN '' ELSE concat('r', c.e) END AS res
  FROM cleaned c LEFT JOIN routing r ON r.task = c.label_task[1]
)
SELECT e AS id, template,
  CASE WHEN template IS NULL THEN 'unrouted' WHEN template = 'creative' THEN 'no_template' ELSE 'routed' END AS route_status,
  CASE template
    WHEN 'reason' THEN 'Grade the steps of this answer.' || chr(10)
      || CASE WHEN e % 2 = 0 THEN 'Reference: ' || {ref} || chr(10) ELSE '' END
      || '1. truth: no false claim (max 10.0) (weight 1.0)' || chr(10) || '2. order: steps follow (max 5.0) (weight 0.25)' || chr(10)
      || chr(10) || 'Q: ' || req || chr(10) || 'A: ' || res
    WHEN 'knowledge' THEN 'Facts of ' || res || ' on ' || req || chr(10) || '- truth 1.0!' || chr(10) || '- sources 2.5!' || chr(10)
    WHEN 'summary' THEN 'Short? {{single}} braces stay' || chr(10) || '  indented ' || req
  END AS eval_prompt
FROM pr""".lstrip())


@query("user_rubric_prompts", _rubric_prompt_sql())
def user_rubric_prompts(spark, sf_dir):
    """Templates read from a file, criteria from a table, rendered for every routed record."""
    path = scratch_path(spark, "judge-templates")
    spark.range(1).select(F.lit(_FILE).alias("value")).write.text(path)
    store = TP.read_templates(spark, path)
    rows = local_table(spark, _CRITERIA, "template STRING, position INT, name STRING, description STRING, max_score DOUBLE, weight DOUBLE")
    compiled = TP.compile_templates(store, TP.criteria_rows(rows, list(PR.RUBRICS)))
    recs = judged_records(spark, sf_dir).filter(F.col("label_task").isNotNull() & F.col("eval_result").isNotNull())
    ev = eval_projection(recs).withColumn("template", PR.template_of(primary_task(F.col("label_task"))))
    ref = F.when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col(GROUP_COL).cast("string")))
    out = TP.render(ev, compiled, {"prompt": F.col("req"), "response": F.col("res"), "reference_data": ref, "reference_answer": ref})
    return out.select("id", "template", "route_status", "eval_prompt")


# The rule of each template here: own ones for the sum and the points.
_RULES = [(t, rule, name, w, 10.0) for t, (rule, crit) in PR.RUBRICS.items() if t in ("reason", "knowledge") for name, w in crit]
_RULES += [("summary", "sum", name, w, 10.0) for name, w in PR.RUBRICS["summary"][1]]
_RULES += [("creative", "points", name, w, m) for (name, w), m in zip(PR.RUBRICS["creative"][1], (3.0, 2.0, 2.0, 3.0, 10.0))]
_RULE_VALUES = ", ".join(f"('{t}', '{r}', '{_q(n)}', CAST({w!r} AS DOUBLE), CAST({m!r} AS DOUBLE))" for t, r, n, w, m in _RULES)


@query("rubric_rules", crit_sql(f"""
, ru(template, rule, criterion, weight, max_score) AS (VALUES {_RULE_VALUES}),
t AS (
  SELECT cs.id, cs.answerer_llm_alias, cs.template, ru.rule, count(*) AS n_criteria, 5 - count(*) AS n_missing,
    CASE ru.rule WHEN 'weighted' THEN sum(score * weight) / sum(weight) / 10 WHEN 'mean' THEN avg(score) / 10
         WHEN 'sum' THEN sum(score) ELSE sum(least(score, max_score)) END AS total, sum(max_score) AS top
  FROM cs JOIN ru ON ru.template = cs.template AND ru.criterion = cs.criterion WHERE score >= 0 GROUP BY 1, 2, 3, 4
)
SELECT id, answerer_llm_alias, template, rule, n_criteria, n_missing, round(total, 9) AS total,
       round(CASE WHEN rule IN ('weighted', 'mean') THEN total ELSE total / top END, 9) AS share FROM t"""))
def rubric_rules(spark, sf_dir):
    """Totals of every judged record by its template's rule: weighted, mean, sum or points with own maxima."""
    rules = local_table(spark, _RULES, "template STRING, rule STRING, criterion STRING, weight DOUBLE, max_score DOUBLE")
    return RU.apply_rules(_scores(spark, sf_dir), RU.rule_table(rules))


@query("prompt_criteria_scores", crit_sql("""
SELECT id // 5 AS lr_answer_bronze_id, answerer_llm_alias, round(avg(score), 9) AS mean_score, count(*) AS n_criteria
FROM cs WHERE score >= 0 GROUP BY 1, 2"""))
def prompt_criteria_scores(spark, sf_dir):
    """Mean criterion score of each (prompt, model)."""
    scores = criteria_scores(_replies(spark, sf_dir), keep=(GROUP_COL,))
    return scores.filter("score >= 0").groupBy(GROUP_COL, A).agg(
        F.round(F.avg("score"), 9).alias("mean_score"), F.count(F.lit(1)).alias("n_criteria"))


# ---------------------------------------------------------------- results document
@query("results_summary", crit_sql("""
, span AS (
  SELECT r.alias, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s
  FROM rec r JOIN events v ON v.event_id = r.e GROUP BY 1
),
m AS (SELECT answerer_llm_alias, template, criterion, avg(score) AS mean, count(*) AS n FROM cs GROUP BY 1, 2, 3),
a AS (
  SELECT m.*, b.weight, sum(mean * b.weight) OVER g / sum(b.weight) OVER g AS avg_w, sum(m.n) OVER g AS n_results
  FROM m JOIN rubric b ON b.template = m.template AND b.criterion = m.criterion
  WINDOW g AS (PARTITION BY m.answerer_llm_alias, m.template)
)
SELECT f.file_type, a.answerer_llm_alias AS model_name, a.template, a.criterion, round(a.mean, 9) AS average_score, a.weight,
       round(a.avg_w, 9) AS weighted_average, CAST(a.n_results AS BIGINT) AS n_results,
       CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, ' ELSE CAST(s // 86400 AS VARCHAR) || ' days, ' END
       || printf('%d:%02d:%02d', (s % 86400) // 3600, (s % 3600) // 60, s % 60) AS duration
FROM a JOIN span ON span.alias = a.answerer_llm_alias CROSS JOIN (VALUES ('json'), ('csv')) f(file_type)"""))
def results_summary(spark, sf_dir):
    """Results documents written as JSON and CSV, found again in their folder and joined with the documents' totals."""
    folder = scratch_path(spark, "results-documents")
    ev = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    spans = judged_records(spark, sf_dir).select("id", A).join(ev, "id").groupBy(A).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"))
    docs = DOC.results_documents(_scores(spark, sf_dir), PR.rubric(spark).select("template", "criterion", "weight"), spans)
    DOC.write_documents(docs, f"{folder}/documents")
    written = DOC.read_documents(spark, f"{folder}/documents")
    DOC.write_flat(written, f"{folder}/flat")
    flat = DOC.read_results(spark, folder).withColumn("file_type", F.substring_index("file", ".", -1)).drop("file")
    totals = written.select("model_name", "template", "weighted_average", "n_results", "duration")
    return flat.join(broadcast_if_small(totals), ["model_name", "template"])


# ---------------------------------------------------------------- prompt log with all its columns
@query("prompt_log_columns", f"""
WITH p AS ({_prompt_sql()}), {with_rec('')[len('WITH '):].rstrip()}
SELECT r.e AS id, r.label_task[1] AS task, r.label_domain[1] AS domain, r.label_level[1] AS level, concat('q', r.g) AS prompt,
       CASE WHEN r.e % 113 = 0 THEN '' ELSE concat('r', r.e) END AS response, '' AS reference_data, p.eval_prompt AS evaluation_prompt
FROM cleaned r JOIN p ON p.id = r.e WHERE p.eval_prompt IS NOT NULL""")
def prompt_log_columns(spark, sf_dir):
    """Every rendered prompt appended to the log with its record's columns, by task, and read back."""
    path = scratch_path(spark, "prompt-log")
    recs = judged_records(spark, sf_dir).filter(F.col("label_task").isNotNull() & F.col("eval_result").isNotNull())
    ev = PR.with_judge_prompt(eval_projection(recs).withColumn("primary_task", primary_task(F.col("label_task"))))
    RD.append_prompt_log(RD.prompt_log_rows(ev.filter("route_status = 'routed'")), path)
    return spark.read.schema(RD.PROMPT_LOG_DDL).parquet(path)


# ---------------------------------------------------------------- answers written back
@query("answers_written", with_rec(f"""
, models(alias) AS (VALUES {", ".join(f"('{m}')" for m in MODEL_ALIASES)}),
want AS (SELECT g, m.alias FROM (SELECT DISTINCT g FROM rec) CROSS JOIN models m)
SELECT w.g AS lr_answer_bronze_id, w.alias AS answerer_llm_alias,
       CASE WHEN r.e IS NULL OR r.e % 7 = 0 THEN concat(w.alias, ' on q', w.g) ELSE concat('r', r.e) END AS content,
       CAST(CASE WHEN r.e IS NULL OR r.e % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS run,
       CASE WHEN r.e % 7 = 0 THEN 2 ELSE 1 END AS n_versions
FROM want w LEFT JOIN rec r ON r.g = w.g AND r.alias = w.alias"""))
def answers_written(spark, sf_dir):
    """Missing and empty answers generated, appended and read as the latest; a second run finds nothing to add."""
    recs = judged_records(spark, sf_dir)
    log = AnswerLog(spark, scratch_path(spark, "answers"))
    listed = recs.filter(F.col(A).isin(MODEL_ALIASES))
    log.append(listed.withColumn("content", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("content"))), 0)
    prompts = recs.select(GROUP_COL, F.concat(F.lit("q"), F.col(GROUP_COL).cast("string")).alias("prompt"))
    for run in (1, 2):
        out = fill_missing(log, prompts, MODEL_ALIASES, lambda pdf: pdf[A] + " on " + pdf["prompt"], run)
    return out


@query("answers_wide_written", with_rec(", " + """
w AS (SELECT g, """ + ", ".join(
    f"coalesce(max(CASE WHEN alias = '{m}' AND e % 7 <> 0 THEN concat('r', e) END), concat('{m} on q', g)) AS \"{m}_response\"" for m in MODEL_ALIASES) + """
      FROM rec GROUP BY g)
SELECT g AS lr_answer_bronze_id, """ + ", ".join(f'"{m}_response"' for m in MODEL_ALIASES) + " FROM w"))
def answers_wide_written(spark, sf_dir):
    return answers_wide(answers_written(spark, sf_dir), MODEL_ALIASES)


# ---------------------------------------------------------------- registry from a file
def _registry_file(spark, entries: dict) -> str:
    path = scratch_path(spark, "registry")
    spark.range(1).select(F.lit(json.dumps(entries, ensure_ascii=False)).alias("value")).write.text(path)
    return path


@query("dim_provider_ids", with_rec("""
SELECT e AS id, alias AS answerer_llm_alias, CASE WHEN alias <> 'm-unlisted' THEN concat('provider/', alias, '-v1') END AS answerer_llm_id,
       CASE WHEN alias <> 'm-unlisted' THEN 'ok' ELSE 'unknown_model' END AS id_status
FROM rec"""))
def dim_provider_ids(spark, sf_dir):
    """Provider id of every answer, by a registry read from its JSON file."""
    path = _registry_file(spark, {a.replace("-", "_"): {
        "id": f"provider/{a}-v1", "alias": a, "price": {"dollar_per_input_token": i, "dollar_per_output_token": o}}
        for a, i, o in MODEL_PRICES})
    return with_provider_id(judged_records(spark, sf_dir).select("id", A), model_registry(spark, path))


# Aliases under which three of the fixture's models answer here, all of the remap table.
_LOGGED_AS = {"m-alpha": "gpt-4.1-mini", "m-beta": "gpt-4o-mini", "m-gamma": "gpt-oss-120b"}
_KEY_PRICES = {"gpt_4_1_mini": (4e-7, 1.6e-6), "gpt_oss_120b": (1e-7, 4e-7), "m-delta": (2e-6, 8e-6)}


@query("alias_remap_cost", with_rec(f"""
, logged(alias, logged) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _LOGGED_AS.items())}),
remap(logged, key) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ALIAS_TO_KEY)}),
kp(key, pin, pout) AS (VALUES {", ".join(f"('{k}', CAST({i!r} AS DOUBLE), CAST({o!r} AS DOUBLE))" for k, (i, o) in _KEY_PRICES.items())}),
x AS (SELECT r.*, coalesce(l.logged, r.alias) AS log_alias FROM rec r LEFT JOIN logged l ON l.alias = r.alias)
SELECT x.e AS id, x.log_alias AS answerer_llm_alias, round(coalesce(x.ptok * kp.pin + x.ctok * kp.pout, 0.0), 12) AS cost,
       CASE WHEN kp.pin IS NULL THEN 'unpriced_model' WHEN x.ptok IS NULL THEN 'no_usage' ELSE 'ok' END AS cost_status
FROM x LEFT JOIN remap ON remap.logged = x.log_alias LEFT JOIN kp ON kp.key = coalesce(remap.key, x.log_alias)"""))
def alias_remap_cost(spark, sf_dir):
    """Cost of answers logged under aliases that are priced under another registry key."""
    path = _registry_file(spark, {k: {"id": k, "alias": k, "price": {"dollar_per_input_token": i, "dollar_per_output_token": o}}
                                  for k, (i, o) in _KEY_PRICES.items()})
    logged = F.col(A)
    for a, b in _LOGGED_AS.items():
        logged = F.when(F.col(A) == a, b).otherwise(logged)
    recs = judged_records(spark, sf_dir).withColumn(A, logged)
    out = with_cost(recs, model_registry(spark, path), alias_map(spark))
    return out.select("id", A, F.round("cost", 12).alias("cost"), "cost_status")
