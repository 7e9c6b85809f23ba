"""Imports every query module so the registry is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_cube, q_frontier, q_incremental, q_matrix, q_records, q_rubrics, q_scoring, q_sources  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["quality_summary"](spark, sf_dir)
