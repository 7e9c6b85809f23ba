"""From a response log's files to the routing table: read, clean, score, price, cube, fronts, routes.

The scored table and the cube are staged once for a state of the input's files:
the staging key holds a digest of their listing (path, length, time of change),
so a new, changed or removed file is another key. Staged tables of earlier
states stay in the work folder, which its owner clears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import pareto as PA
from ..session import materialize
from ..sources.readers import read_response_log
from .dashboard import SLIM_COLUMNS, cube_stage, scored_from


def listing_key(spark: SparkSession, path: str) -> tuple:
    """(files, bytes, digest) of the files under ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sum(one).alias("digest")).first()
    return r["n"], r["bytes"], str(r["digest"])


def tables_from_files(spark: SparkSession, path: str, registry: DataFrame | None = None, active: str = "first_model") -> dict[str, DataFrame]:
    """``scored``, the cube's tables, ``best`` portfolio and ``routing`` of a response log (CSV, JSON or Parquet by suffix)."""
    key = ("files", path, *listing_key(spark, path))

    def build() -> DataFrame:
        cleaned = C.with_judge(C.clean_required(read_response_log(spark, path)))
        return scored_from(spark, cleaned.drop("messages", "eval_result"), registry).select(*SLIM_COLUMNS)

    scored = materialize(spark, build, key, "scored-files")
    st = cube_stage(scored, active, key)
    best = PA.best_portfolio(st["fronts"])
    return st | {"scored": scored, "best": best, "routing": PA.routing_table(best, C.ALIAS_COL, "names")}
