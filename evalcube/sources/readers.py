"""Readers and writers of response logs and result files (CSV, JSON, Parquet).

Every reader takes an explicit schema (no inference pass over the data) and
returns a DataFrame in the record layout; label lists written as Python list
literals (``['T1', 'T5']``) are parsed per row by ``from_json``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import from_literal

# Fixed values of the data contract: column names, and the old names of response logs.
LABEL_COLUMNS = ["label_task", "label_level", "label_domain"]

LEGACY_NAMES = {"task": "label_task", "level": "label_level", "domain": "label_domain",
                "model_name": "answerer_llm_alias"}

RECORD_DDL = ("id BIGINT, lr_answer_bronze_id BIGINT, source_id STRING, messages STRING, "
              "label_task STRING, label_level STRING, label_domain STRING, answerer_llm_alias STRING, "
              "response STRING, content STRING, status_code INT, eval_result STRING")

# Without these a response log cannot be judged.
REQUIRED = ["id", "answerer_llm_alias", "label_task"]

_CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def parse_list_literal(text: Column) -> Column:
    """Python list literal (or JSON array) -> ARRAY<STRING>; unreadable text -> NULL."""
    return from_literal(text, "ARRAY<STRING>")


def to_list_literal(arr: Column) -> Column:
    """ARRAY<STRING> -> JSON list text, also a list literal; quotes, null items and empty lists survive."""
    return F.to_json(arr)


def normalize_schema(df: DataFrame) -> DataFrame:
    """Rename legacy columns and drop rows without a task label."""
    renames = {k: v for k, v in LEGACY_NAMES.items() if k in df.columns and v not in df.columns}
    out = df.withColumnsRenamed(renames) if renames else df
    return out.filter(F.col("label_task").isNotNull()) if renames.get("task") else out


def _with_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: parse_list_literal(F.col(c)) for c in LABEL_COLUMNS if c in df.columns})


def read_csv_records(spark: SparkSession, path: str, ddl: str = RECORD_DDL) -> DataFrame:
    """CSV response log: quoted multi-line fields, label lists as list literals.

    Columns are taken by header name, in any order and under legacy names.
    """
    return _with_labels(_by_name(normalize_schema(read_csv_strings(spark, path)), ddl))


def _by_name(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ``ddl`` by name: text cast where it can be, NULL where an optional column is absent."""
    fields = T._parse_datatype_string(ddl).fields
    missing = [c for c in REQUIRED if c in [f.name for f in fields] and c not in df.columns]
    if missing:
        raise ValueError(f"response log lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def read_csv_strings(spark: SparkSession, path: str, keep_na: bool = False) -> DataFrame:
    """All-string CSV (header names, BOM stripped). ``keep_na`` keeps '' and 'NA' as text."""
    r = spark.read.options(**_CSV_OPTS).option("inferSchema", "false")
    if keep_na:
        r = r.option("nullValue", "\u0000").option("emptyValue", "")
    return r.csv(path)


CORRUPT = "_corrupt_record"


def is_json_document(spark: SparkSession, path: str) -> bool:
    """Whether the first text of the files opens an array, or an object that goes on in the next line."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("v")).head(1)
    return bool(first) and (first[0]["v"].startswith("[") or first[0]["v"] == "{")


def _text_of(v: Column) -> Column:
    """Text of a variant: a string as it is, anything else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).when(
        ~F.is_variant_null(v), F.to_json(v))


def read_json_records(spark: SparkSession, path: str, ddl: str = RECORD_DDL, document: bool | None = None,
                      bad: str = "fail") -> DataFrame:
    """JSON response log (label lists as JSON arrays or list-literal text).

    ``document`` reads files that are one JSON document each (an array of records
    or one record; a file is then one task), otherwise each line is a record; None
    looks at the first line. No record is left out silently: ``bad="fail"`` ends the
    query at a record that can't be read, ``bad="keep"`` returns it with its text in
    ``_corrupt_record`` (NULL for the others), to be counted or set apart.
    """
    if bad not in ("fail", "keep"):
        raise ValueError("bad is 'fail' or 'keep'")
    if document is None:
        document = is_json_document(spark, path)
    names = [f.name for f in T._parse_datatype_string(ddl).fields]
    old = [o for o, n in LEGACY_NAMES.items() if n in names]
    fields = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(ddl).fields} | {o: "string" for o in old}
    # A list read as text out of a document is fetched from its file again, by its place; a variant is read in passing.
    lists = [c for c in fields if LEGACY_NAMES.get(c, c) in LABEL_COLUMNS and fields[c] == "string"] if document else []
    fields |= {c: "variant" for c in lists} | ({CORRUPT: "string"} if bad == "keep" else {})
    both = ", ".join(f"`{c}` {kind}" for c, kind in fields.items())
    df = (spark.read.schema(both).option("multiLine", document).option("mode", "PERMISSIVE" if bad == "keep" else "FAILFAST")
          .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    df = df.withColumns({c: _text_of(F.col(c)) for c in lists})
    for o in old:
        df = df.withColumn(LEGACY_NAMES[o], F.coalesce(LEGACY_NAMES[o], o)).drop(o)
    return _with_labels(df)


def read_response_log(spark: SparkSession, path: str, document: bool | None = None, bad: str = "fail") -> DataFrame:
    """Dispatch on the file suffix; an unsupported suffix raises (never an empty frame).

    ``document`` and ``bad`` hold for JSON, see ``read_json_records``.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return read_csv_records(spark, path)
    if suffix == ".json":
        return read_json_records(spark, path, document=document, bad=bad)
    if suffix == ".parquet":
        return normalize_schema(spark.read.parquet(path))
    raise ValueError(f"unsupported response log format: {path}")


def discover_result_files(spark: SparkSession, folder: str, pattern: str = "*.{json,csv}") -> DataFrame:
    """Result files in a folder tree: path, size, modification time (contents are not read)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "true").load(folder)
                 .select("path", "length", "modificationTime"))


def write_records_csv(df: DataFrame, path: str) -> None:
    """Record sink as CSV with list-literal labels (the response-log layout)."""
    out = df.withColumns({c: to_list_literal(F.col(c)) for c in LABEL_COLUMNS if c in df.columns})
    out.write.mode("overwrite").options(**_CSV_OPTS).csv(path)


def write_results_json(df: DataFrame, path: str) -> None:
    """Results sink: one JSON object per row."""
    df.write.mode("overwrite").json(path)


PROMPT_LOG_DDL = ("id BIGINT, domain STRING, level STRING, prompt STRING, response STRING, reference_data STRING, "
                  "evaluation_prompt STRING, task STRING")


def prompt_log_rows(rendered: DataFrame) -> DataFrame:
    """The log's columns of rendered eval records: first domain and level, request, answer, reference and judge prompt."""
    return rendered.select(
        "id", F.try_element_at("label_domain", F.lit(1)).alias("domain"), F.try_element_at("label_level", F.lit(1)).alias("level"),
        F.col("req").alias("prompt"), F.col("res").alias("response"), F.coalesce("ref", F.lit("")).alias("reference_data"),
        F.col("eval_prompt").alias("evaluation_prompt"), F.col("primary_task").alias("task"))


def append_prompt_log(df: DataFrame, path: str, partition_col: str = "task") -> None:
    """Prompt log sink: appended, partitioned by task (one header-free file set per run)."""
    df.write.mode("append").partitionBy(partition_col).parquet(path)
