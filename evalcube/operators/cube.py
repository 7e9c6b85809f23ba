"""Fractional multi-label cube: model x task x domain x level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import ALIAS_COL

# The closed code lists of the three label dimensions.
TASKS = [f"T{i}" for i in range(1, 13)]
DOMAINS = [f"D{i}" for i in range(1, 11)]
LEVELS = [f"L{i}" for i in range(1, 4)]

# Fixed values too: short names of the codes (label descriptions are display text only).
TASK_NAMES = ["Translation", "Summarization", "Math", "Code", "Text editing",
              "Image generation", "Creative writing", "Planning/reasoning",
              "Classification", "Factoid QA", "Chat", "Unknown"]
DOMAIN_NAMES = ["Math/stats", "Finance", "Computing", "Health", "Science", "Law",
                "Politics", "Humanities", "Daily life", "Uncategorized"]
LEVEL_NAMES = ["Easy", "Intermediate", "Complex"]

CELL = ["T", "D", "L"]
CUBE_DIGITS = 12

# Units of the cube's sums: whole numbers add up to the same total in any order.
QUALITY_UNITS = 10 ** 9
COST_UNITS = 10 ** 12


def code_num(code: Column) -> Column:
    """Numeric part of a label code, for natural ordering (T2 before T10)."""
    return F.substring(code, 2, 9).cast("int")


def cell_index(t: Column, d: Column, l: Column) -> Column:
    """Position of a cell in the template's loop order (T outer, L inner)."""
    return (code_num(t) - 1) * (len(DOMAINS) * len(LEVELS)) + (code_num(d) - 1) * len(LEVELS) + code_num(l) - 1


def tld_cube(scored: DataFrame) -> DataFrame:
    """Sum of weight, weight*quality and weight*cost per (model, T, D, L).

    Each record spreads weight 1/(|T||D||L|) over every combination of its
    labels (a duplicated label counts twice); labels outside the code lists
    vanish. Three generators and one partially aggregated hash aggregate: the
    partial step leaves at most (models x 360 x number of weights) rows per map
    task, so a hot model or cell never reaches the shuffle as raw rows.

    Sums are exact: quality in 1e-9 and cost in 1e-12 dollars are added as whole
    numbers, apart for each |T||D||L|, and only the few totals of a cell are
    divided, in ascending order. A rerun with other partitions gives the same
    cube to the last bit, so a cell is never routed differently.
    """
    n = F.size("label_task") * F.size("label_domain") * F.size("label_level")
    units = lambda c, scale: F.round(F.col(c) * scale).cast("decimal(18,0)").alias(c)
    base = scored.select(ALIAS_COL, "label_task", "label_domain", "label_level", n.alias("n"),
                         units("quality", QUALITY_UNITS), units("cost", COST_UNITS))
    ex = (base.withColumn("T", F.explode("label_task"))
              .withColumn("D", F.explode("label_domain"))
              .withColumn("L", F.explode("label_level"))
              .filter(F.col("T").isin(TASKS) & F.col("D").isin(DOMAINS) & F.col("L").isin(LEVELS)))
    parts = ex.groupBy(ALIAS_COL, *CELL, "n").agg(
        F.count(F.lit(1)).alias("count"), F.sum("quality").alias("quality"), F.sum("cost").alias("cost"))
    # one entry for each |T||D||L| that the cell's records have
    cells = parts.groupBy(ALIAS_COL, *CELL).agg(F.sort_array(F.collect_list(F.struct(
        "n", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("count", "quality", "cost"))))).alias("s"))

    def total(c: str, scale: int) -> Column:
        weighed = F.aggregate("s", F.lit(0.0), lambda a, x: a + x[c] / x["n"])
        return F.round(weighed / F.lit(float(scale)), CUBE_DIGITS).alias(c)
    return cells.select(ALIAS_COL, *CELL, total("count", 1), total("quality", QUALITY_UNITS), total("cost", COST_UNITS))


def template_cells(models: DataFrame) -> DataFrame:
    """All 360 cells for every model, generated per model row from the code
    ranges (three generators, no join)."""
    def codes(prefix, n):
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    return (models.select(ALIAS_COL, F.explode(codes("T", len(TASKS))).alias("T"))
                  .withColumn("D", F.explode(codes("D", len(DOMAINS))))
                  .withColumn("L", F.explode(codes("L", len(LEVELS)))))


def dense_cube(scored: DataFrame, cube: DataFrame | None = None,
               models: DataFrame | None = None) -> DataFrame:
    """Per model the full 12x10x3 template, zeros where the model has no rows."""
    cube = cube if cube is not None else tld_cube(scored)
    models = (models if models is not None else scored.select(ALIAS_COL).distinct()).select(ALIAS_COL)
    return (template_cells(models).join(cube, [ALIAS_COL, *CELL], "left")
            .fillna(0.0, subset=["count", "quality", "cost"]))


def model_totals(cube: DataFrame) -> DataFrame:
    """Per model the summed cube: its (cost, quality) point on the chart."""
    return cube.groupBy(ALIAS_COL).agg(
        F.round(F.sum("count"), 9).alias("count"),
        F.round(F.sum("quality"), 9).alias("quality"),
        F.round(F.sum("cost"), 9).alias("cost"))


def model_ids(scored: DataFrame) -> DataFrame:
    """llm_id by first appearance (smallest record id), 0-based.

    The window runs over one row per model (a dimension), not over records.
    """
    from pyspark.sql import Window
    first = scored.groupBy(ALIAS_COL).agg(F.min("id").alias("first_id"))
    return first.select(ALIAS_COL, (F.row_number().over(Window.orderBy("first_id", ALIAS_COL)) - 1)
                        .cast("int").alias("llm_id"))


def label_names(spark) -> DataFrame:
    """Code -> short name for the three label dimensions."""
    rows = ([("task", c, n) for c, n in zip(TASKS, TASK_NAMES)]
            + [("domain", c, n) for c, n in zip(DOMAINS, DOMAIN_NAMES)]
            + [("level", c, n) for c, n in zip(LEVELS, LEVEL_NAMES)])
    from ..functions.joins import local_table
    return local_table(spark, rows, "dimension STRING, code STRING, name STRING")
