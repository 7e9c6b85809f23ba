"""Judge prompts: task -> template routing, rubric dimension, prompt rendering.

Templates are our own short English bodies with the placeholders
``{{prompt}}``, ``{{response}}``, ``{{reference_data}}`` and ``{{criteria}}``.
Rendering splits a body at its placeholders once on the driver (the body is a
constant) and builds one ``concat`` of literals and columns per template, so
user text is never scanned for placeholders and everything stays JVM-side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import local_table

# Task code -> judge template (tasks outside the list are unrouted).
TASK_TEMPLATE = [
    ("T1", "reason"), ("T2", "summary"), ("T3", "reason"), ("T4", "reason"),
    ("T5", "creative"), ("T6", "creative"), ("T7", "creative"), ("T8", "reason"),
    ("T9", "knowledge"), ("T10", "knowledge"), ("T11", "reason"), ("T12", "reason"),
]

# Rubric of each template as (JSON key of the criterion, weight),
# and the rule that turns criterion scores (0-10) into the total (0-1).
# weighted: sum(score*w)/sum(w)/10; mean: avg(score)/10; sum: sum(score).
RUBRICS = {
    "reason": ("weighted", [("논리적 순서", 0.25), ("단계 간 연결성", 0.15), ("과정의 정확성", 0.25),
                            ("단계 완전성", 0.10), ("최종 결과의 정확성", 0.25)]),
    "summary": ("weighted", [("핵심 포함 여부", 0.25), ("불필요 정보 배제", 0.25), ("간결성", 0.20),
                             ("논리적 흐름", 0.20), ("요청 수준 적합성", 0.10)]),
    "creative": ("weighted", [("창의성", 0.35), ("문장 구성", 0.20), ("몰입도", 0.20),
                              ("감정 전달력", 0.15), ("요청 톤/스타일 반영", 0.10)]),
    "translate": ("weighted", [("정확성", 0.35), ("자연스러움", 0.25), ("문법/표현", 0.20),
                               ("스타일·톤 유지", 0.20)]),
    "compare": ("weighted", [("비교 기준 명확성", 0.25), ("균형성", 0.25), ("장단점 구분", 0.20),
                             ("분석 깊이", 0.15), ("결론·추천 설득력", 0.15)]),
    "knowledge": ("mean", [("사실 정확성", 1.0), ("세부 정보 신뢰도", 1.0), ("근거 제시 여부", 1.0),
                           ("오정보 여부", 1.0), ("완전성", 1.0)]),
}

_OUTPUT_RULE = ("Score every criterion from 0 to 10 and reply with one JSON object holding "
                "each criterion, \"총점\" (the total, 0-1, two decimals) and \"평가의견\" (a short reason).")

TEMPLATES = {
    key: (f"You grade the {key} quality of an answer written by a language model.\n"
          "Criteria:\n{{criteria}}\n"
          "Reference (may be empty):\n{{reference_data}}\n"
          "Question:\n{{prompt}}\n"
          "Answer:\n{{response}}\n" + _OUTPUT_RULE)
    for key in RUBRICS
}

_PLACEHOLDER = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def routing(spark: SparkSession) -> DataFrame:
    return local_table(spark, TASK_TEMPLATE, "task STRING, template STRING")


def rubric(spark: SparkSession) -> DataFrame:
    """(template, rule, position, criterion, weight): the rubric dimension."""
    rows = [(t, rule, i + 1, name, w) for t, (rule, crit) in RUBRICS.items() for i, (name, w) in enumerate(crit)]
    return local_table(spark, rows, "template STRING, rule STRING, position INT, criterion STRING, weight DOUBLE")


def template_of(task: Column) -> Column:
    """Template key of a task code (NULL when unrouted), looked up in a constant map.

    The code is read once: as a CASE every branch would hold ``task`` anew, and so would a
    filter on the template that Catalyst moves to the scan, before the records are spread.
    """
    return F.create_map(*[F.lit(x) for pair in TASK_TEMPLATE for x in pair])[task]


def criteria_of(template: Column) -> Column:
    """Array<struct<criterion, weight>> of the template's rubric (constant per template, NULL without one)."""
    of = {key: F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(w).alias("weight")) for n, w in crit])
          for key, (_, crit) in RUBRICS.items()}
    return F.create_map(*[x for key, crit in of.items() for x in (F.lit(key), crit)])[template]


def render_criteria(criteria: Column, max_score: float = 10.0) -> Column:
    """'index. name (max m) (weight w)' lines, one per criterion."""
    return F.array_join(F.transform(criteria, lambda c, i: F.format_string(
        "%d. %s (max %.1f) (weight %.2f)", i + 1, c["criterion"], F.lit(max_score), c["weight"])), "\n")


def _render_body(body: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(body):
        if m.start() > pos:
            parts.append(F.lit(body[pos:m.start()]))
        parts.append(F.coalesce(values.get(m.group(1), F.lit("")), F.lit("")))
        pos = m.end()
    if pos < len(body):
        parts.append(F.lit(body[pos:]))
    return F.concat(*parts)


def render_prompt(template: Column, prompt: Column, response: Column, reference: Column,
                  criteria_text: Column, templates: dict[str, str] | None = None) -> Column:
    """The judge prompt of each row; both reference placeholder names are bound."""
    values = {"prompt": prompt, "response": response, "reference_data": reference,
              "reference_answer": reference, "criteria": criteria_text}
    expr = None
    for key, body in (templates or TEMPLATES).items():
        r = _render_body(body, values)
        expr = F.when(template == key, r) if expr is None else expr.when(template == key, r)
    return expr


def with_judge_prompt(df: DataFrame, task_col: str = "primary_task", prompt_col: str = "req",
                      response_col: str = "res", reference_col: str = "ref") -> DataFrame:
    """Route each row to its template and render the prompt (``unrouted`` rows keep NULL)."""
    tmpl = template_of(F.col(task_col))
    out = df.withColumn("template", tmpl)
    crit = render_criteria(criteria_of(F.col("template")))
    return (out.withColumn("eval_prompt", render_prompt(F.col("template"), F.col(prompt_col),
                                                        F.col(response_col), F.col(reference_col), crit))
               .withColumn("route_status", F.when(F.col("template").isNull(), F.lit("unrouted"))
                           .otherwise(F.lit("routed"))))
