"""Scoring: per-criterion aggregates, rubric audit, offline similarity scorer, batch judging."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.criteria_parse import MISSING_REASON, backfill, failure_reason, parse_criteria
from ..functions.judge_parse import bind, judge_text, parse_total
from ..functions.joins import broadcast_if_small
from .clean import ALIAS_COL
from .prompts import RUBRICS, criteria_of, rubric

MAX_SCORE = 10.0


# ---------------------------------------------------------------- similarity
def tokens(text: Column) -> Column:
    """Distinct whitespace-separated tokens (empty tokens dropped)."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    ta, tb = tokens(a), tokens(b)
    union = F.size(F.array_union(ta, tb))
    return F.when(union > 0, F.size(F.array_intersect(ta, tb)) / union).otherwise(F.lit(0.0))


def reference_similarity(response: Column, reference: Column, max_score: float = MAX_SCORE) -> Column:
    """Token-set Jaccard x max_score; 0.0 when there is no reference text."""
    has_ref = reference.isNotNull() & (reference != "")
    return F.when(has_ref, jaccard(response, reference) * max_score).otherwise(F.lit(0.0))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, req, res): a user turn and the assistant turn right after it.

    An equi-join on (conv_id, turn + 1): a long conversation is spread over
    the join like any other key (AQE splits skewed partitions), never
    gathered into one array.
    """
    u = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("req"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("res"))
    return u.join(a, ["conv_id", "turn"])


# ---------------------------------------------------------------- criteria
def criteria_scores(replies: DataFrame, keep: tuple[str, ...] = (), reasons: bool = False) -> DataFrame:
    """One row per (record, criterion): parsed reply plus back-filled missing criteria; ``keep`` names further columns.

    With ``reasons`` the feedback of a missing criterion says what of the reply could not be read.
    """
    names = F.transform(criteria_of(F.col("template")), lambda c: c["criterion"])
    items = backfill(parse_criteria(F.col("reply")), names, failure_reason(F.col("reply")) if reasons else MISSING_REASON)
    return replies.select("id", ALIAS_COL, "template", *keep, F.inline(items))


def criteria_means(scores: DataFrame) -> DataFrame:
    """Mean score per (model, template, criterion)."""
    return scores.groupBy(ALIAS_COL, "template", "criterion").agg(
        F.round(F.avg("score"), 9).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def criteria_weighted_avg(means: DataFrame, spark: SparkSession) -> DataFrame:
    """Weighted mean of the criterion means present per (model, template); 0.0 if none."""
    w = broadcast_if_small(rubric(spark).select("template", "criterion", "weight"))
    j = means.join(w, ["template", "criterion"], "left")
    agg = j.groupBy(ALIAS_COL, "template").agg(
        F.sum(F.col("mean_score") * F.col("weight")).alias("_sw"), F.sum("weight").alias("_w"))
    return agg.select(ALIAS_COL, "template", F.round(F.coalesce(
        F.when(F.col("_w") > 0, F.col("_sw") / F.col("_w")), F.lit(0.0)), 9).alias("weighted_avg"))


def rubric_total_audit(replies: DataFrame) -> DataFrame:
    """Recompute each reply's total from its criterion scores and compare with the claim.

    weighted: sum(s*w)/sum(w)/10; mean: avg(s)/10; over the criteria the
    judge object holds. All per row: the object is read once into a map, bound
    so that no use of it reads the text again.
    """
    def read(b):
        m = b["m"]
        found = F.filter(F.transform(b["crit"], lambda c: F.struct(
            c["weight"].alias("w"), m[c["criterion"]].try_cast("double").alias("s"))), lambda x: x["s"].isNotNull())
        return bind(F.struct(found.alias("p"), m["총점"].try_cast("double").alias("claimed")), lambda f: F.struct(
            F.size(f["p"]).alias("n"), f["claimed"].alias("claimed"),
            F.aggregate(f["p"], F.lit(0.0), lambda acc, x: acc + x["s"] * x["w"]).alias("sw"),
            F.aggregate(f["p"], F.lit(0.0), lambda acc, x: acc + x["w"]).alias("ws")))

    got = bind(F.struct(F.from_json(F.col("judge_object"), "MAP<STRING, STRING>").alias("m"), criteria_of(F.col("template")).alias("crit")), read)
    rule = None
    for key, (r, _) in RUBRICS.items():
        rule = F.when(F.col("template") == key, F.lit(r)) if rule is None else rule.when(
            F.col("template") == key, F.lit(r))
    total = F.when(F.col("got.ws") > 0, F.col("got.sw") / F.col("got.ws") / MAX_SCORE)
    claimed = F.col("got.claimed")
    return replies.withColumn("got", got).select("id", ALIAS_COL, "template", rule.alias("rule"),
                          F.col("got.n").alias("n_criteria"),
                          F.round(total, 9).alias("recomputed_total"),
                          claimed.alias("claimed_total"),
                          F.round(claimed - total, 9).alias("difference"))


# ---------------------------------------------------------------- batch judging
Scorer = Callable[[pd.DataFrame], pd.Series]


def offline_scorer(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic judge without a network: total = token Jaccard of answer and reference."""
    out = []
    for resp, ref in zip(pdf["res"], pdf["ref"]):
        a = set((resp or "").split())
        b = set((ref or "").split())
        u = a | b
        sim = len(a & b) / len(u) if (ref and u) else 0.0
        out.append('{"총점": %r, "평가의견": "token overlap"}' % sim)
    return pd.Series(out, index=pdf.index, dtype="object")


def judge_batch(df: DataFrame, scorer: Scorer = offline_scorer, concurrency: int | None = None) -> DataFrame:
    """Run ``scorer`` over Arrow batches of (eval_prompt, req, res, ref) rows.

    The scorer sees pandas frames and returns one reply text per row (a
    network judge plugs in here). ``concurrency`` bounds parallel calls by
    hash-partitioning the work into that many tasks. When a batch
    fails its rows are scored one by one; only those that fail again get
    ``judge_error`` and no reply.
    """
    src = df.repartition(concurrency, "id") if concurrency else df
    schema = T.StructType(list(src.schema.fields) + [
        T.StructField("eval_response", T.StringType()), T.StructField("judge_error", T.StringType())])

    def one(row):
        try:
            return scorer(row).iloc[0], None
        except Exception as exc:  # noqa: BLE001 - reported on the row
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches):
        for pdf in batches:
            try:
                replies, errors = scorer(pdf).astype("object"), None
            except Exception:  # noqa: BLE001 - each row by itself shows which one fails
                replies, errors = zip(*(one(pdf.iloc[[i]]) for i in range(len(pdf))))
            yield pdf.assign(eval_response=list(replies), judge_error=list(errors) if errors else None)

    judged = src.mapInPandas(run, schema)
    text = judge_text(F.col("eval_response"))
    return (judged.withColumn("eval_result", F.when(F.col("eval_response").isNotNull(), text))
                  .withColumn("judge", parse_total(F.col("eval_result"))))


def missing_answers(prompts: DataFrame, answers: DataFrame, models: list[str],
                    key: str = "lr_answer_bronze_id") -> DataFrame:
    """(prompt, model) pairs without a non-empty answer yet.

    Each prompt row expands to the listed models by a generator (the model
    list is a small dimension), then one anti join on (prompt, model).
    """
    want = prompts.select(key).distinct().select(key, F.explode(F.array(*[F.lit(m) for m in models])).alias(ALIAS_COL))
    have = answers.filter(F.coalesce(F.col("content"), F.lit("")) != "").select(key, ALIAS_COL)
    return want.join(have, [key, ALIAS_COL], "left_anti")


def answers_wide(answers: DataFrame, models: list[str], key: str = "lr_answer_bronze_id",
                 value: str = "content") -> DataFrame:
    """One row per prompt, one ``<model>_response`` column per listed model."""
    piv = answers.groupBy(key).pivot(ALIAS_COL, models).agg(F.max(value))
    return piv.select(key, *[F.col(f"`{m}`").alias(f"{m}_response") for m in models])


def run_duration(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps as H:MM:SS ('N day(s), H:MM:SS' past a day)."""
    secs = F.timestamp_diff("MICROSECOND", start, end)
    s = F.when(secs >= 0, F.floor(secs / 1_000_000)).otherwise(-F.floor(-secs / 1_000_000)).cast("long")
    days = F.floor(s / 86400).cast("long")
    rest = s - days * 86400
    hms = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("long"),
                          F.floor((rest % 3600) / 60).cast("long"), (rest % 60).cast("long"))
    return F.when(days == 0, hms).otherwise(F.concat(
        days.cast("string"), F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")), hms))
