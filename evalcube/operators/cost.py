"""Token usage and dollar cost of every answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from .clean import ALIAS_COL

_USAGE_SCHEMA = "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"


def token_usage(response: Column) -> Column:
    """Struct(prompt_tokens, completion_tokens) of a chat-completion JSON."""
    return F.from_json(response, _USAGE_SCHEMA)["usage"]


def with_token_usage(df: DataFrame) -> DataFrame:
    u = token_usage(F.col("response"))
    return df.withColumns({"prompt_tokens": u["prompt_tokens"],
                           "completion_tokens": u["completion_tokens"]})


def with_cost(df: DataFrame, registry: DataFrame, alias_map: DataFrame | None = None) -> DataFrame:
    """Add ``cost`` (dollars) and ``cost_status``.

    alias -> registry key (explicit remap, else the alias itself) -> prices,
    both small dimensions joined by broadcast after a size check. A model
    without a price or a response without token usage costs 0.0, and
    ``cost_status`` says which case applied.
    """
    out = df
    if "prompt_tokens" not in df.columns:
        out = with_token_usage(out)
    if alias_map is not None:
        am = alias_map.select(F.col("alias").alias("_am_alias"), F.col("key").alias("_am_key"))
        out = (out.join(broadcast_if_small(am), out[ALIAS_COL] == am["_am_alias"], "left")
                  .withColumn("_price_key", F.coalesce("_am_key", ALIAS_COL))
                  .drop("_am_alias", "_am_key"))
    else:
        out = out.withColumn("_price_key", F.col(ALIAS_COL))
    prices = registry.select(F.col("key").alias("_price_key"),
                             F.col("dollar_per_input_token").alias("_pin"),
                             F.col("dollar_per_output_token").alias("_pout"))
    out = out.join(broadcast_if_small(prices), on="_price_key", how="left")
    raw_cost = F.col("prompt_tokens") * F.col("_pin") + F.col("completion_tokens") * F.col("_pout")
    status = (F.when(F.col("_pin").isNull(), F.lit("unpriced_model"))
               .when(F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull(),
                     F.lit("no_usage"))
               .otherwise(F.lit("ok")))
    return (out.withColumn("cost", F.coalesce(raw_cost, F.lit(0.0)))
               .withColumn("cost_status", status)
               .drop("_price_key", "_pin", "_pout"))
