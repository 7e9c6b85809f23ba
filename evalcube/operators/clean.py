"""Projection, validation and cleaning of response / judge records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import from_literal
from ..functions.judge_parse import STATUS_BAD, STATUS_OK, with_parsed_total

GROUP_COL = "lr_answer_bronze_id"
ALIAS_COL = "answerer_llm_alias"

EVAL_COLUMNS = [
    "id", GROUP_COL, "source_id", "messages", "label_task", "label_level",
    "label_domain", ALIAS_COL, "response", "content", "status_code",
    "ref", "req", "res", "eval_prompt", "eval_response", "eval_result",
]

_MESSAGES_SCHEMA = "ARRAY<STRUCT<role: STRING, content: STRING>>"
_ANSWER_SCHEMA = "choices ARRAY<STRUCT<message: STRUCT<role: STRING, content: STRING>>>"


def request_text(messages: Column) -> Column:
    """Content of the second message (whatever its role); the list is JSON or a Python literal."""
    return F.try_element_at(from_literal(messages, _MESSAGES_SCHEMA), F.lit(2))["content"]


def answer_text(response: Column) -> Column:
    """choices[0].message.content of a chat-completion JSON; '' when absent."""
    parsed = F.from_json(response, _ANSWER_SCHEMA)
    first = F.try_element_at(parsed["choices"], F.lit(1))
    return F.coalesce(first["message"]["content"], F.lit(""))


def eval_projection(df: DataFrame) -> DataFrame:
    """The 17-column eval record with request and answer extracted."""
    cols = [F.col(c) for c in EVAL_COLUMNS[:11]]
    return df.select(
        *cols,
        F.lit("").alias("ref"),
        F.coalesce(request_text(F.col("messages")), F.lit("")).alias("req"),
        answer_text(F.col("response")).alias("res"),
        F.lit("").alias("eval_prompt"),
        F.lit("").alias("eval_response"),
        F.lit("").alias("eval_result"),
    )


def valid_eval_rows(df: DataFrame) -> DataFrame:
    """Rows that can be judged: a task label and a response."""
    return df.filter(F.col("label_task").isNotNull() & F.col("response").isNotNull())


def clean_required(df: DataFrame) -> DataFrame:
    """Rows with task, answering model and judge output."""
    return df.dropna(subset=["label_task", ALIAS_COL, "eval_result"])


def with_judge(df: DataFrame, source: str = "eval_result") -> DataFrame:
    """Parse the judge output once into a ``judge`` struct (status, score, repaired)."""
    return with_parsed_total(df, F.col(source), "judge")


def remove_poisoned_groups(df: DataFrame, group_col: str = GROUP_COL) -> DataFrame:
    """Drop every row of a question group that has an unparsable judge output.

    One anti join on the group key: the bad-group set is tiny next to the
    records, so AQE turns it into a broadcast at run time; when it is not,
    the sort-merge anti join is split by AQE's skew handling on hot groups.
    Bad rows without a group key go too. Both sides read ``df``: hand over a
    written table (``dashboard.scored_from`` does), or it is parsed twice. The
    table is not bucketed by group, as one group may hold a third of all rows.
    """
    is_bad = F.col("judge.status") == STATUS_BAD
    bad_groups = df.filter(is_bad & F.col(group_col).isNotNull()).select(group_col).distinct()
    kept = df.filter(~is_bad | F.col("judge.status").isNull())
    return kept.join(bad_groups, on=group_col, how="left_anti")


def with_quality(df: DataFrame) -> DataFrame:
    """Keep rows whose judge output has a numeric total; it becomes ``quality``."""
    return (df.filter(F.col("judge.status") == STATUS_OK)
              .withColumn("quality", F.col("judge.score")))


def complete_groups(df: DataFrame, group_size: int = 5, group_col: str = GROUP_COL) -> DataFrame:
    """Rows of groups with exactly ``group_size`` rows.

    Counted with a partially aggregated group-by (a hot group costs one
    counter per map task), then a semi join back onto the rows.
    """
    sizes = (df.groupBy(group_col).count()
               .filter(F.col("count") == group_size).select(group_col))
    return df.join(sizes, on=group_col, how="left_semi")


def derive_group_id(df: DataFrame, text_col: str = "messages") -> DataFrame:
    """Group id (as text) for records without one: the SHA-256 of their messages, so equal messages share a group."""
    own = F.col(GROUP_COL).cast("string") if GROUP_COL in df.columns else F.lit(None).cast("string")
    return df.withColumn(GROUP_COL, F.coalesce(own, F.sha2(F.encode(F.col(text_col), "UTF-8"), 256)))


def primary_task(labels: Column) -> Column:
    return F.try_element_at(labels, F.lit(1))
