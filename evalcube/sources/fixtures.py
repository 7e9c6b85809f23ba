"""Judged-response records derived by formula from the driver's ``events`` table.

The reference reads response logs that are not shipped, so the records are
computed row by row from ``events`` (no shuffle, no driver data): event ``e``
is the answer of model ``e mod 5`` to question group ``e div 5``. The oracle
SQL recomputes the same formulas in DuckDB without parsing any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, spread

# Fixed values of the fixture: the five answering models and their token
# prices in dollars (input, output), plus one alias without a price.
MODEL_ALIASES = ["m-alpha", "m-beta", "m-gamma", "m-delta", "m-omega"]
UNLISTED_ALIAS = "m-unlisted"
MODEL_PRICES = [
    ("m-alpha", 1e-7, 4e-7),
    ("m-beta", 4e-7, 1.6e-6),
    ("m-gamma", 1e-6, 4e-6),
    ("m-delta", 2e-6, 8e-6),
    ("m-omega", 5e-6, 2e-5),
]


def _code(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _event_ids(spark: SparkSession, sf_dir: str, replicas: int) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "value")
    if replicas <= 1:
        ev = spread(ev)
        return ev.withColumnRenamed("event_id", "e")
    # Larger inputs for the bench: n copies with ids shifted by the event
    # count (event_id is dense), made by a per-row generator, not a join.
    n_events = ev.agg(F.max("event_id") + 1).first()[0]
    return spread(ev.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
                  .select((F.col("event_id") + F.col("n") * F.lit(n_events)).alias("e"), "value"))


def judged_records(spark: SparkSession, sf_dir: str, replicas: int = 1) -> DataFrame:
    """Response records with judge output (``eval_result``), one per event."""
    ev = _event_ids(spark, sf_dir, replicas)
    e = F.col("e")
    g = F.floor(e / 5).cast("long")
    m = (e % 5).cast("int")
    gd12 = F.floor(g / 12).cast("long")

    alias = F.when(e % 211 == 0, F.lit(UNLISTED_ALIAS)).otherwise(
        F.element_at(F.array(*[F.lit(a) for a in MODEL_ALIASES]), m + 1))
    t1 = _code("T", 1 + g % 12)
    t2 = _code("T", 1 + (g + 5) % 12)
    label_task = F.when(g % 103 == 0, F.lit(None).cast("array<string>")).otherwise(
        F.when(g % 3 == 0, F.array(t1, t2)).otherwise(F.array(t1)))
    d1 = _code("D", 1 + gd12 % 10)
    d2 = _code("D", 1 + (gd12 + 3) % 10)
    label_domain = F.when(g % 4 == 0, F.array(d1, d2)).otherwise(F.array(d1))
    label_level = F.array(_code("L", 1 + F.floor(g / 7) % 3))

    q100 = (F.floor(F.col("value")).cast("long") % 51 + 10 * m)
    total = F.format_string("%.2f", q100 / 100.0)
    comment = F.when(e % 11 == 0, F.lit("\\Delta rises")).otherwise(F.lit("fine"))
    body = F.concat(F.lit('{"총점": '), total, F.lit(', "평가의견": "'), comment, F.lit('"}'))
    fenced = F.when(e % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    eval_result = (
        F.when(e % 101 == 0, F.lit(None).cast("string"))
        .when(e % 97 == 0, F.concat(F.lit('{"총점": '), total, F.lit(', "평가의견": "cut')))
        .when(e % 89 == 0, F.lit('{"평가의견": "no total"}'))
        .when(e % 83 == 0, F.lit('{"총점": null, "평가의견": "empty total"}'))
        .otherwise(fenced))

    ptok = 50 + (37 * g) % 400
    ctok = 20 + (13 * e) % 700
    answer = F.concat(F.lit("r"), e.cast("string"))
    response = F.when(e % 113 == 0, F.lit('{"choices":[]}')).otherwise(F.concat(
        F.lit('{"id":"c'), e.cast("string"),
        F.lit('","choices":[{"index":0,"message":{"role":"assistant","content":"'), answer,
        F.lit('"}}],"usage":{"prompt_tokens":'), ptok.cast("string"),
        F.lit(',"completion_tokens":'), ctok.cast("string"), F.lit("}}")))
    question = F.concat(F.lit("q"), g.cast("string"))
    messages = F.concat(
        F.lit('[{"role":"system","content":"Answer briefly."},{"role":"user","content":"'),
        question, F.lit('"}]'))

    return ev.select(
        e.alias("id"),
        g.alias("lr_answer_bronze_id"),
        _code("src", g % 7).alias("source_id"),
        messages.alias("messages"),
        label_task.alias("label_task"),
        label_level.alias("label_level"),
        label_domain.alias("label_domain"),
        alias.alias("answerer_llm_alias"),
        response.alias("response"),
        answer.alias("content"),
        F.lit(200).alias("status_code"),
        eval_result.alias("eval_result"),
    )


def fixture_registry_rows() -> list[dict]:
    """Registry entries (key -> id, alias, price) of the fixture models."""
    return [
        {"key": a, "id": a, "alias": a, "dollar_per_input_token": pin,
         "dollar_per_output_token": pout}
        for a, pin, pout in MODEL_PRICES
    ]


def eval_response_shapes(df: DataFrame) -> DataFrame:
    """Wrap ``eval_result`` into the response shapes of several providers.

    By ``id mod 4``: chat-completion JSON, a content list, a content string,
    or the bare text. NULL stays NULL.
    """
    r = F.col("eval_result")
    k = F.col("id") % 4
    shaped = (
        F.when(k == 0, F.to_json(F.struct(F.array(F.struct(F.struct(
            F.lit("assistant").alias("role"), r.alias("content")).alias("message"))).alias("choices"))))
        .when(k == 1, F.to_json(F.struct(F.array(F.struct(
            F.lit("text").alias("type"), r.alias("text"))).alias("content"))))
        .when(k == 2, F.to_json(F.struct(r.alias("content"))))
        .otherwise(r))
    return df.withColumn("eval_response", F.when(r.isNotNull(), shaped))


# Reply shapes of the criteria fixture, chosen by id mod 3.
REPLY_SHAPES = ["json_array", "flat_objects", "markdown"]


def criteria_score_expr(e: Column, k: Column) -> Column:
    """Score (0-10) the fixture judge gives criterion ``k`` (1-based) of record ``e``."""
    return ((e + 3 * k) % 11).cast("int")


def criteria_replies(df: DataFrame) -> DataFrame:
    """Multi-criteria judge replies for records routed to a rubric.

    Criterion k of the record's template scores (id + 3k) mod 11; when
    id mod 7 = 0 the last criterion is left out of the reply. The reply is a
    JSON array (id mod 3 = 0), flat single-quoted objects amid prose (1) or a
    Markdown table (2). Also returns the JSON object form ``judge_object``
    with every criterion key, the total and a comment.
    """
    from ..operators.prompts import criteria_of, template_of
    e = F.col("id")
    task = F.try_element_at("label_task", F.lit(1))
    out = df.withColumn("template", template_of(task)).filter(F.col("template").isNotNull())
    crit = criteria_of(F.col("template"))
    n = F.size(crit)
    kept = F.filter(F.transform(crit, lambda c, i: F.struct(
        c["criterion"].alias("name"), criteria_score_expr(e, i + 1).alias("s"), (i + 1).alias("k"))),
        lambda x: ~((x["k"] == n) & (e % 7 == 0)))
    def render(b):
        k, e, score = b["kept"], b["e"], b["score"]
        number = lambda x: F.coalesce(x["s"].cast("string"), F.lit("null"))
        lines = lambda head, mid, tail, sep: F.array_join(F.transform(k, lambda x: F.concat(
            F.lit(head), x["name"], F.lit(mid), number(x), F.lit(tail))), sep)
        as_json = F.concat(F.lit("["), lines('{"기준": "', '", "점수": ', ', "피드백": "ok"}', ", "), F.lit("]"))
        as_flat = F.concat(F.lit("Scores follow.\n"), lines("{'criteria_name': '", "', 'score': ", ", 'feedback': 'ok'}", "\n"),
                           F.lit("\nEnd of scores."))
        as_md = F.concat(F.lit("Result table:\n| 기준 | 점수 | 피드백 |\n|---|---|---|\n"),
                         lines("| ", " | ", " | ok |", "\n"), F.lit("\n\nDone."))
        shape = e % 3
        reply = F.when(shape == 0, as_json).when(shape == 1, as_flat).otherwise(as_md)
        obj = F.concat(F.lit("{"), lines('"', '": ', "", ", "), F.lit(', "총점": '),
                       F.coalesce(score.cast("string"), F.lit("null")), F.lit(', "평가의견": "ok"}'))
        return F.struct(reply.alias("reply"), obj.alias("judge_object"))

    # The kept criteria are built once per row and shared by both renderings, which are a column of their own:
    # picked out of the expression itself each would render both.
    from ..functions.judge_parse import bind
    rendered = bind(F.struct(kept.alias("kept"), e.alias("e"), F.col("judge.score").alias("score")), render)
    shape = e % 3
    return out.withColumn("rendered", rendered).select(
        "id", "answerer_llm_alias", "lr_answer_bronze_id", "template",
        F.element_at(F.array(*[F.lit(s) for s in REPLY_SHAPES]), (shape + 1).cast("int")).alias("shape"),
        "rendered.reply", "rendered.judge_object")
