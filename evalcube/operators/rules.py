"""Score rules as rows: how a record's criterion scores become its total.

A rule table has one row for each criterion of a template: (template, rule,
criterion, weight, max_score). Rules:

* ``weighted``  sum(score / max * weight) / sum(weight)
* ``mean``      avg(score / max)
* ``sum``       sum(score)
* ``points``    sum(score, at most the criterion's own maximum)

``share`` is the total on the scale 0 to 1 whatever the rule. Scores that are
NULL, NaN or negative (criteria filled in because the reply lacked them) don't
count and are reported as ``n_missing``; of a criterion that a reply names
twice the highest score counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from .clean import ALIAS_COL


def apply_rules(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, model, template, rule, n_criteria, n_missing, total, share), one row for each record with a counted score.

    ``scores``: (id, model, template, criterion, score). Two aggregates over the same leading
    keys after one dimension join: a record's handful of criteria is the only group.
    """
    key = ["id", ALIAS_COL, "template"]
    good = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= 0))
    one = good.groupBy(*key, "criterion").agg(F.max("score").alias("s"))
    j = one.join(broadcast_if_small(rules), ["template", "criterion"])
    s, w, m = F.col("s"), F.col("weight"), F.col("max_score")
    agg = j.groupBy(*key, "rule").agg(
        F.count(F.lit(1)).alias("n_criteria"), F.max("n_rule").alias("n_rule"), F.sum(s).alias("_sum"),
        F.sum(F.least(s, m)).alias("_points"), F.sum(m).alias("_max"), F.sum(s / m * w).alias("_sw"),
        F.sum(w).alias("_w"), F.avg(s / m).alias("_mean"))
    rule = F.col("rule")
    weighted = F.when(F.col("_w") > 0, F.col("_sw") / F.col("_w"))
    total = (F.when(rule == "weighted", weighted).when(rule == "mean", F.col("_mean"))
             .when(rule == "sum", F.col("_sum")).when(rule == "points", F.col("_points")))
    share = (F.when(rule.isin("weighted", "mean"), total).when(F.col("_max") > 0, total / F.col("_max")))
    return agg.select(*key, "rule", "n_criteria", (F.col("n_rule") - F.col("n_criteria")).alias("n_missing"),
                      F.round(total, 9).alias("total"), F.round(share, 9).alias("share"))


def rule_table(rows: DataFrame) -> DataFrame:
    """``rows`` checked (rule known, maximum above 0) with ``n_rule``, the number of a template's criteria."""
    known = F.col("rule").isin("weighted", "mean", "sum", "points") & (F.col("max_score") > 0)
    checked = rows.withColumn("rule", F.when(known, F.col("rule")).otherwise(F.raise_error(
        F.concat(F.lit("no such rule or no maximum: "), F.coalesce("rule", F.lit("NULL"))))))
    n = checked.groupBy("template").agg(F.count(F.lit(1)).cast("bigint").alias("n_rule"))
    return checked.join(n, "template")
