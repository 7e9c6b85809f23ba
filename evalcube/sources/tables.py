"""Reading the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


#: Rows of a task that feeds heavy per-row work or writes wide rows.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt out evenly over all cores, at most about ``rows`` rows to a partition.

    A scan's splits are cut by bytes of narrow, compressed columns and follow row
    groups, so one may hold nearly all rows; what is made of a row (JSON texts,
    prompts) is many times wider. Their number follows the count of the rows (read
    from the files' footers), so a task's work doesn't grow with the table. Rows are
    dealt in turn, so a repeated key fills no partition: only the layout differs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))
