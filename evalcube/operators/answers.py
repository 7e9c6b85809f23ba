"""Answers generated for the (prompt, model) pairs that have none, written back and read as the latest of a pair."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import ALIAS_COL
from .scoring import missing_answers

#: (frame of key, model, prompt) -> one answer for each row; a network client plugs in here.
Generator = Callable[[pd.DataFrame], pd.Series]


class AnswerLog:
    """An append-only Parquet folder of (key, model, content, run).

    Appends are whole jobs of Spark's own committer; a job that is repeated after
    a failure may leave a pair twice, which the reader's latest-of-a-pair undoes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "lr_answer_bronze_id", key_type: str = "BIGINT"):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T._parse_datatype_string(f"{key} {key_type}, {ALIAS_COL} STRING, content STRING, run BIGINT, error STRING")

    def append(self, rows: DataFrame, run: int) -> None:
        """Add answers; ``error`` is NULL where the rows have no such column."""
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        rows.select(self.key, ALIAS_COL, "content", F.lit(run).cast("bigint").alias("run"), error.alias("error")).write.mode("append").parquet(self.path)

    def versions(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """(key, model, content, run, n_versions): a non-empty answer before an empty one, then the latest run, then the greatest text."""
        order = F.struct((F.coalesce("content", F.lit("")) != "").alias("some"), "run", "content")
        return self.versions().groupBy(self.key, ALIAS_COL).agg(
            F.max(order).alias("m"), F.count(F.lit(1)).alias("n_versions")).select(
            self.key, ALIAS_COL, "m.content", "m.run", "n_versions")


def fill_missing(log: AnswerLog, prompts: DataFrame, models: list[str], generator: Generator, run: int) -> DataFrame:
    """Generate what ``log`` lacks, append it and return the latest answers.

    ``prompts``: (key, prompt). NULL and empty prompts get no answer; of a key with
    several prompts the least is asked. A batch that fails is asked row by row, a
    row that fails again is logged with an empty answer and its error and asked anew next time.
    """
    key = log.key
    asked = prompts.filter(F.coalesce("prompt", F.lit("")) != "").groupBy(key).agg(F.min("prompt").alias("prompt"))
    todo = missing_answers(asked, log.latest(), models, key).join(asked, key)
    schema = T.StructType([f for f in log.schema.fields if f.name in (key, ALIAS_COL, "content", "error")])

    def one(row: pd.DataFrame):
        try:
            return generator(row).iloc[0], None
        except Exception as exc:  # noqa: BLE001 - kept with the pair
            return "", f"{type(exc).__name__}: {exc}"

    def run_batches(batches):
        for pdf in batches:
            try:
                got, errors = list(generator(pdf).astype("object")), None
            except Exception:  # noqa: BLE001 - each row by itself shows which one fails
                got, errors = zip(*(one(pdf.iloc[[i]]) for i in range(len(pdf))))
            yield pdf[[key, ALIAS_COL]].assign(content=list(got), error=list(errors) if errors else None)

    log.append(todo.mapInPandas(run_batches, schema), run)
    return log.latest()
