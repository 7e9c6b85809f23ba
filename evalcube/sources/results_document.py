"""Results documents: one nested record for each model and rubric, written as JSON, read back with flat CSV results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import ALIAS_COL
from ..operators.scoring import run_duration
from ..functions.joins import broadcast_if_small

_ONE = "STRUCT<average_score: DOUBLE, weight: DOUBLE>"
DOCUMENT_DDL = (f"model_name STRING, template STRING, criteria_scores MAP<STRING, {_ONE}>, weighted_average DOUBLE, "
                "n_results BIGINT, evaluation_start_time TIMESTAMP, evaluation_end_time TIMESTAMP, duration STRING")
FLAT_DDL = "model_name STRING, template STRING, criterion STRING, average_score DOUBLE, weight DOUBLE"


def results_documents(scores: DataFrame, weights: DataFrame, spans: DataFrame) -> DataFrame:
    """One document for each (model, template).

    ``scores``: (model, template, criterion, score), ``weights``: (template, criterion,
    weight), ``spans``: (model, started, ended). Criteria without a weight count
    1. The map has a rubric's few criteria; scores are averaged before anything is gathered.
    """
    means = scores.groupBy(ALIAS_COL, "template", "criterion").agg(
        F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    j = means.join(broadcast_if_small(weights), ["template", "criterion"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    entry = F.struct("criterion", F.struct(F.round("mean", 9).alias("average_score"), "weight").alias("v"))
    docs = j.groupBy(ALIAS_COL, "template").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("criteria_scores"),
        F.when(F.sum("weight") > 0, F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).otherwise(0.0).alias("avg"),
        F.sum("n").alias("n_results"))
    return docs.join(spans, ALIAS_COL, "left").select(
        F.col(ALIAS_COL).alias("model_name"), "template", "criteria_scores", F.round("avg", 9).alias("weighted_average"), "n_results",
        F.col("started").alias("evaluation_start_time"), F.col("ended").alias("evaluation_end_time"),
        run_duration(F.col("started"), F.col("ended")).alias("duration"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("errorifexists").json(path)


def write_flat(docs: DataFrame, path: str) -> None:
    """The same results as CSV, one row for each criterion."""
    _flat(docs).write.mode("errorifexists").option("header", "true").csv(path)


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select("model_name", "template", F.explode("criteria_scores").alias("criterion", "v")).select(
        "model_name", "template", "criterion", "v.average_score", "v.weight")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Flat results of every JSON document and CSV file under ``folder``; ``file`` is the path of their source.

    One read for each format with its own schema: a file that can't be read ends the query.
    """
    def reader(ddl: str, glob: str):
        return (spark.read.schema(ddl).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", glob))

    file = F.col("_metadata.file_path").alias("file")
    docs = reader(DOCUMENT_DDL, "*.json").json(folder).select(file, "*")
    flat = docs.select("file", "model_name", "template", F.explode("criteria_scores").alias("criterion", "v")).select(
        "file", "model_name", "template", "criterion", "v.average_score", "v.weight")
    csv = reader(FLAT_DDL, "*.csv").option("header", "true").csv(folder).select(file, "*")
    return flat.unionByName(csv)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.read.schema(DOCUMENT_DDL).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.json").json(folder))
