"""Queries of sources and sinks: file round trips of the records (§2.1 A1-A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import ALIAS_COL
from ..session import scratch_path
from ..sources import readers as RD
from ..sources.fixtures import judged_records
from .oracle_base import with_rec
from .q_cube import _stage, cube_sql
from .registry import query

A = ALIAS_COL
_LABELS_SQL = with_rec("""
SELECT e AS id, label_task, label_level, label_domain, alias AS answerer_llm_alias,
       200 AS status_code FROM rec""")


def _records(spark, sf_dir):
    return judged_records(spark, sf_dir).select(*[c.split()[0] for c in RD.RECORD_DDL.split(", ")])


@query("scan_csv_labels", _LABELS_SQL)
def scan_csv_labels(spark, sf_dir):
    path = scratch_path(spark, "records") + ".csv"
    RD.write_records_csv(_records(spark, sf_dir), path)
    df = RD.read_response_log(spark, path)
    return df.select("id", *RD.LABEL_COLUMNS, A, "status_code")


@query("scan_json_records", _LABELS_SQL)
def scan_json_records(spark, sf_dir):
    path = scratch_path(spark, "records") + ".json"
    RD.write_results_json(_records(spark, sf_dir), path)
    return RD.read_response_log(spark, path).select("id", *RD.LABEL_COLUMNS, A, "status_code")


@query("scan_json_document", _LABELS_SQL)
def scan_json_document(spark, sf_dir):
    """Files that are one JSON array each, a record over several lines; the reader finds out by itself."""
    path = scratch_path(spark, "documents") + ".json"
    recs = _records(spark, sf_dir)
    one = F.replace(F.to_json(F.struct(*recs.columns)), F.lit(',"'), F.lit(',\n  "'))
    arrays = recs.groupBy(F.floor(F.col("id") / 1000).alias("doc")).agg(
        F.concat(F.lit("[\n "), F.array_join(F.collect_list(one), ",\n "), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file for each document, all in one folder
    return RD.read_response_log(spark, path).select("id", *RD.LABEL_COLUMNS, A, "status_code")


@query("json_corrupt_records", with_rec("""
SELECT CASE WHEN e % 97 = 0 THEN 'corrupt' ELSE 'read' END AS state, count(*) AS n_records,
       CAST(sum(CASE WHEN e % 97 = 0 THEN 0 ELSE e END) AS BIGINT) AS id_sum FROM rec GROUP BY 1"""))
def json_corrupt_records(spark, sf_dir):
    """Cut lines of a JSON log are returned with their text, none is lost."""
    path = scratch_path(spark, "cut") + ".json"
    recs = _records(spark, sf_dir)
    line = F.to_json(F.struct(*recs.columns))
    recs.select(F.when(F.col("id") % 97 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    df = RD.read_response_log(spark, path, bad="keep").select("id", RD.CORRUPT)
    cut = F.col(RD.CORRUPT).isNotNull()
    return df.groupBy(F.when(cut, "corrupt").otherwise("read").alias("state")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.when(cut, 0).otherwise(F.col("id"))).cast("bigint").alias("id_sum"))


@query("normalize_schema", with_rec("""
SELECT e AS id, label_task, alias AS answerer_llm_alias FROM rec WHERE label_task IS NOT NULL"""))
def normalize_schema(spark, sf_dir):
    legacy = _records(spark, sf_dir).withColumnsRenamed({v: k for k, v in RD.LEGACY_NAMES.items()})
    path = scratch_path(spark, "legacy") + ".parquet"
    legacy.write.mode("overwrite").parquet(path)
    df = RD.read_response_log(spark, path)
    return df.select("id", "label_task", A)


@query("scan_csv_strings", with_rec("""
SELECT CAST(e AS VARCHAR) AS id, concat('src', g % 7) AS source_id, '200' AS status_code FROM rec"""))
def scan_csv_strings(spark, sf_dir):
    path = scratch_path(spark, "records") + ".csv"
    RD.write_records_csv(_records(spark, sf_dir), path)
    return RD.read_csv_strings(spark, path).select("id", "source_id", "status_code")


@query("scan_csv_keep_na", with_rec("""
SELECT CAST(e AS VARCHAR) AS id, CASE WHEN e % 2 = 0 THEN 'NA' ELSE '' END AS note FROM rec"""))
def scan_csv_keep_na(spark, sf_dir):
    path = scratch_path(spark, "notes") + ".csv"
    df = judged_records(spark, sf_dir).select(
        "id", F.when(F.col("id") % 2 == 0, "NA").otherwise("").alias("note"))
    df.write.mode("overwrite").option("header", "true").option("emptyValue", '""').csv(path)
    return RD.read_csv_strings(spark, path, keep_na=True).select("id", "note")


@query("discover_result_files")
def discover_result_files(spark, sf_dir):
    base = scratch_path(spark, "results")
    recs = _records(spark, sf_dir)
    RD.write_results_json(recs.select("id", A), f"{base}/run1.json")
    RD.write_records_csv(recs.select("id", A), f"{base}/run2.csv")
    return RD.discover_result_files(spark, base).select("path", "length")


@query("results_json", with_rec("""
SELECT alias AS answerer_llm_alias, count(*) AS n_records,
       count(*) FILTER (WHERE e % 101 <> 0) AS n_judged FROM rec GROUP BY 1"""))
def results_json(spark, sf_dir):
    path = scratch_path(spark, "summary") + ".json"
    summary = judged_records(spark, sf_dir).groupBy(A).agg(
        F.count(F.lit(1)).alias("n_records"), F.count("eval_result").alias("n_judged"))
    RD.write_results_json(summary, path)
    return spark.read.schema("answerer_llm_alias STRING, n_records BIGINT, n_judged BIGINT").json(path)


@query("prompt_log", with_rec("""
SELECT label_task[1] AS task, count(*) AS n_prompts FROM cleaned GROUP BY 1"""))
def prompt_log(spark, sf_dir):
    path = scratch_path(spark, "prompt-log")
    recs = judged_records(spark, sf_dir).dropna(subset=["label_task", A, "eval_result"])
    log = recs.select(F.try_element_at("label_task", F.lit(1)).alias("task"), "id",
                      F.col("messages").alias("prompt"), F.col("content").alias("response"))
    RD.append_prompt_log(log, path)
    return spark.read.parquet(path).groupBy("task").agg(F.count(F.lit(1)).alias("n_prompts"))


@query("cube_sink", cube_sql("SELECT answerer_llm_alias, T, D, L, count, quality, cost FROM cube"))
def cube_sink(spark, sf_dir):
    """The combined model x cell cube written as CSV (one file set for all models) and read back."""
    path = scratch_path(spark, "all-models-cube") + ".csv"
    _stage(spark, sf_dir)["cube"].write.mode("overwrite").option("header", "true").csv(path)
    return spark.read.option("header", "true").schema(
        "answerer_llm_alias STRING, T STRING, D STRING, L STRING, count DOUBLE, quality DOUBLE, cost DOUBLE"
    ).csv(path)


@query("eval_file_sink", with_rec("""
SELECT e AS id, concat('q', g) AS req, CASE WHEN e % 113 = 0 THEN '' ELSE concat('r', e) END AS res,
       '' AS eval_result FROM rec"""))
def eval_file_sink(spark, sf_dir):
    """The eval file: the 17-column eval record written as Parquet and read back."""
    from ..operators.clean import eval_projection
    path = scratch_path(spark, "df-eval") + ".parquet"
    eval_projection(judged_records(spark, sf_dir)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("id", "req", "res", "eval_result")
