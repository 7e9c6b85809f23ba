"""Model registry (key -> id, alias, token prices) and alias remapping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import local_table
from .fixtures import fixture_registry_rows

REGISTRY_DDL = ("key STRING, id STRING, alias STRING, dollar_per_input_token DOUBLE, "
                "dollar_per_output_token DOUBLE")

REGISTRY_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("id", T.StringType(), True),
    T.StructField("alias", T.StringType(), True),
    T.StructField("dollar_per_input_token", T.DoubleType(), True),
    T.StructField("dollar_per_output_token", T.DoubleType(), True),
])

# Answer-log aliases that are priced under another registry key
# (alias, registry key), in the order the price lookup lists them.
ALIAS_TO_KEY = [
    ("gpt-4.1", "gpt_4_1"),
    ("midm-base-2.3.2", "midm_base_2_3_2"),
    ("gpt-4.1-mini", "gpt_4_1_mini"),
    ("midm-mini-2.3.1", "midm_mini_2_3_1"),
    ("midm-pro-inst", "midm_pro"),
    ("sota-k", "sota_k"),
    ("gpt-oss-120b", "gpt_oss_120b"),
    ("gpt-4o-mini", "gpt_4_1_mini"),
    ("llama-3.1-74b-fp16", "llama_74b_fp16"),
]


def model_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Registry as a dimension DataFrame.

    ``path`` names a JSON registry in the shape ``{key: {id, alias, price:
    {dollar_per_input_token, dollar_per_output_token}}}`` (one object per
    file, read by Spark); without it the fixture's five priced models are used.
    No endpoint or credential fields are kept.
    """
    if path is None:
        rows = [(r["key"], r["id"], r["alias"], r["dollar_per_input_token"], r["dollar_per_output_token"])
                for r in fixture_registry_rows()]
        return local_table(spark, rows, REGISTRY_DDL)
    entry = ("MAP<STRING, STRUCT<id: STRING, alias: STRING, price: STRUCT<"
             "dollar_per_input_token: DOUBLE, dollar_per_output_token: DOUBLE>>>")
    return (spark.read.text(path, wholetext=True)
            .selectExpr(f"explode(from_json(value, '{entry}')) AS (key, v)")
            .selectExpr("key", "v.id AS id", "v.alias AS alias",
                        "v.price.dollar_per_input_token AS dollar_per_input_token",
                        "v.price.dollar_per_output_token AS dollar_per_output_token"))


def alias_map(spark: SparkSession) -> DataFrame:
    return local_table(spark, ALIAS_TO_KEY, "alias STRING, key STRING")


def with_provider_id(df: DataFrame, registry: DataFrame, alias_col: str = "answerer_llm_alias") -> DataFrame:
    """Add ``answerer_llm_id`` and ``id_status``; of an alias listed twice the greatest registry key holds."""
    ids = registry.filter("alias IS NOT NULL").groupBy("alias").agg(F.max_by("id", "key").alias("answerer_llm_id"))
    out = df.join(ids.withColumnRenamed("alias", alias_col), alias_col, "left")
    return out.withColumn("id_status", F.when(F.col("answerer_llm_id").isNull(), "unknown_model").otherwise("ok"))
