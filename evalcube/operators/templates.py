"""Prompt templates as data: template files become segment rows, records are rendered by one join.

A template file holds blocks ``name: |`` with an indented body. A body knows
``{{ variable }}``, ``{% for c in criteria_list %} .. {% endfor %}`` with
``{{ loop.index }}``, ``{{ c.name }}``, ``{{ c.description }}``,
``{{ c.max_score }}`` and ``{{ c.weight }}``, and ``{% if variable %} .. {% endif %}``.
Loops and conditions don't nest in their own kind; any other tag, an open tag or
a loop over something else ends the query with the template's name.

Templates and criteria are dimensions: loops are unrolled once for each template,
so a record meets one array of segments and its own texts are never searched for
tags. The compiled table is written and broadcast only if its files are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import broadcast_written

# What a criterion counts where its table leaves it open.
DEFAULT_MAX_SCORE, DEFAULT_WEIGHT = 10.0, 1.0

_KEY = r"^([^\s#:][^:\n]*?)[ ]*:[ ]*\|[-+]?[ ]*$"
_FOR, _IF = r"^\{%\s*for\s+(\w+)\s+in\s+(\w+)\s*%\}$", r"^\{%\s*if\s+(\w+)\s*%\}$"
_VAR = r"^\{\{\s*(\w+(?:\.\w+)?)\s*\}\}$"


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(template, body) of every block in the files; of a repeated name the block last by (file, place).

    Blank lines at a body's end are dropped, a line that is not indented ends the block.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    blocks = files.select("file", F.posexplode(F.split("value", r"(?m)(?=" + _KEY + ")")).alias("place", "block"))
    blocks = blocks.withColumn("template", F.regexp_extract("block", "(?m)" + _KEY, 1)).filter("template <> ''")
    body = F.regexp_replace(F.regexp_replace("block", r"\A[^\n]*\n?", ""), r"(?ms)^[^\s].*", "")
    indent = F.regexp_extract(body, r"\A(?:[ ]*\n)*([ ]+)", 1)
    body = F.regexp_replace(body, F.concat(F.lit("(?m)^(?:"), indent, F.lit("|[ ]*$)")), F.lit(""))
    body = F.regexp_replace(body, r"\n+\z", "")
    return (blocks.select("template", F.struct("file", "place", body.alias("body")).alias("b"))
            .groupBy("template").agg(F.max("b")["body"].alias("body")))


def criteria_rows(criteria: DataFrame, templates: list[str]) -> DataFrame:
    """The criteria dimension from user rows (template, position, name, description, max_score, weight).

    A row without a template holds for each of ``templates``; an open maximum is
    10, an open weight 1, an open description empty. Rows without a name are left out.
    Places are counted anew within a template by (position, name).
    """
    every = F.array(*[F.lit(t) for t in templates]).cast("array<string>")
    rows = criteria.filter("name IS NOT NULL").withColumn(
        "template", F.explode(F.when(F.col("template").isNull(), every).otherwise(F.array("template"))))
    order = Window.partitionBy("template").orderBy("position", "name")
    return rows.select("template", F.row_number().over(order).alias("position"), "name",
                       F.coalesce("description", F.lit("")).alias("description"),
                       F.coalesce("max_score", F.lit(DEFAULT_MAX_SCORE)).alias("max_score"),
                       F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight"))


def _bad(template: Column, what: Column) -> Column:
    return F.raise_error(F.concat(F.lit("template "), template, F.lit(": not supported: "), what)).cast("string")


def segments(templates: DataFrame, criteria: DataFrame) -> DataFrame:
    """(template, at, item, place, kind, value, cond): a template's pieces in order (at, item, place), loops unrolled.

    kind ``text`` is literal, ``var`` names a value of the record; a piece with a
    ``cond`` is written only where that value is not empty.
    """
    t, piece = F.col("template"), F.col("piece")
    pieces = templates.select(t, F.posexplode(F.split("body", r"(?=\{\{|\{%)|(?<=\}\}|%\})")).alias("place", "piece"))
    kind = (F.when(piece.rlike(_VAR), "var").when(piece.rlike(_FOR), "for").when(piece.rlike(_IF), "if")
            .when(piece.rlike(r"^\{%\s*endfor\s*%\}$"), "endfor").when(piece.rlike(r"^\{%\s*endif\s*%\}$"), "endif")
            .when(piece.rlike(r"^\{[\{%]"), _bad(t, piece)).otherwise("text"))
    pieces = pieces.withColumn("kind", kind)
    k, w = F.col("kind"), Window.partitionBy("template").orderBy("place")
    whole = Window.partitionBy("template")

    def depth(opens: str) -> Column:
        return F.when(k == opens, 1).when(k == "end" + opens, -1).otherwise(0)

    loop_list = F.regexp_extract(piece, _FOR, 2)
    marked = (pieces
              .withColumn("loop_at", F.last(F.when(k == "for", F.col("place")).when(k == "endfor", -1), True).over(w))
              .withColumn("loop_var", F.last(F.when(k == "for", F.regexp_extract(piece, _FOR, 1)), True).over(w))
              .withColumn("cond", F.last(F.when(k == "if", F.regexp_extract(piece, _IF, 1)).when(k == "endif", ""), True).over(w))
              .withColumns({f"{o}_depth": F.sum(depth(o)).over(w) for o in ("for", "if")})
              .withColumns({f"{o}_end": F.sum(depth(o)).over(whole) for o in ("for", "if")}))
    wrong = (~F.col("for_depth").between(0, 1) | ~F.col("if_depth").between(0, 1) | (F.col("for_end") != 0)
             | (F.col("if_end") != 0) | ((k == "for") & (loop_list != "criteria_list")))
    marked = marked.withColumn("kind", F.when(wrong, _bad(t, piece)).otherwise(k))
    # The check is part of ``kind``, which the filter reads for every piece.
    parts = marked.filter(F.col("kind").isin("text", "var")).select(
        t, "place", "kind", F.coalesce("loop_at", F.lit(-1)).alias("loop_at"), "loop_var", F.coalesce("cond", F.lit("")).alias("cond"),
        F.when(F.col("kind") == "var", F.regexp_extract(piece, _VAR, 1)).otherwise(piece).alias("value"))
    plain = parts.filter("loop_at < 0").select(t, F.col("place").alias("at"), F.lit(0).alias("item"), "place", "kind", "value", "cond")
    v = F.col("value")
    own = F.concat(F.col("loop_var"), F.lit("."))
    field = F.when(F.startswith(v, own), F.substring_index(v, ".", -1)).when(v == "loop.index", F.lit("index"))
    text = (F.when(field == "index", F.col("position").cast("string")).when(field == "name", F.col("name"))
            .when(field == "description", F.col("description")).when(field == "max_score", F.col("max_score").cast("string"))
            .when(field == "weight", F.col("weight").cast("string")).otherwise(F.lit("")))
    filled = (F.col("kind") == "var") & field.isNotNull()
    looped = parts.filter("loop_at >= 0").join(criteria, "template").select(
        t, F.col("loop_at").alias("at"), F.col("position").alias("item"), "place",
        F.when(filled, "text").otherwise(F.col("kind")).alias("kind"), F.when(filled, text).otherwise(v).alias("value"), "cond")
    return plain.unionByName(looped)


def compile_templates(templates: DataFrame, criteria: DataFrame) -> DataFrame:
    """(template, segments): one row for each template; the array is as long as its body with the criteria filled in."""
    one = F.struct("at", "item", "place", "kind", "value", "cond")
    return segments(templates, criteria).groupBy("template").agg(F.array_sort(F.collect_list(one)).alias("segments"))


def render(records: DataFrame, compiled: DataFrame, values: dict[str, Column], out: str = "eval_prompt") -> DataFrame:
    """``records`` (with a column ``template``) and the rendered text and ``route_status``.

    Status: ``unrouted`` (no template named), ``no_template`` (not in the store) or
    ``routed``; the first two have a NULL text. Unknown names and NULL values are empty.
    """
    def named(name: Column) -> Column:
        expr = F.lit("")
        for key, value in values.items():
            expr = F.when(name == key, F.coalesce(value, F.lit(""))).otherwise(expr)
        return expr

    kept = F.filter("_segments", lambda s: (s["cond"] == "") | (named(s["cond"]) != ""))
    text = F.array_join(F.transform(kept, lambda s: F.when(s["kind"] == "text", s["value"]).otherwise(named(s["value"]))), "")
    dim = broadcast_written(compiled.withColumnRenamed("segments", "_segments"), "compiled-templates")
    status = (F.when(F.col("template").isNull(), "unrouted").when(F.col("_segments").isNull(), "no_template").otherwise("routed"))
    return records.join(dim, "template", "left").withColumns({out: text, "route_status": status}).drop("_segments")
