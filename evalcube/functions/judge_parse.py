"""Column expressions that read judge output (total score JSON, provider shapes).

Everything here is a native Spark expression: the text is parsed once per row
inside whole-stage codegen, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data contract: key of the total score (0..1) and of the
# judge's comment inside the JSON object the rubric asks for.
TOTAL_KEY = "총점"
COMMENT_KEY = "평가의견"

STATUS_OK = "ok"
STATUS_NO_SCORE = "no_score"
STATUS_BAD = "bad"

_WRAP_SCHEMA = f"w ARRAY<STRUCT<`{TOTAL_KEY}`: STRING>>, `end` INT, _corrupt_record STRING"
_JSON_OPTS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "allowSingleQuotes": "false",
}


# Fixed values of the data contract: what is stripped around a reply, and which backslashes are doubled. They
# decide which replies count as repaired.
OUTER_SPACE = r"(?U)^\s+|\s+$"
FENCE = r"(?i)^```json\s*|\s*```$"
STRAY_BACKSLASH = r'(?<!\\)\\(?![\\/"bfnrtu])'


def strip_fence(text: Column) -> Column:
    """Trim, then drop a leading ```json and a trailing ``` (case-insensitive)."""
    trimmed = F.regexp_replace(text, OUTER_SPACE, "")
    return F.regexp_replace(trimmed, FENCE, "")


def escape_repair(text: Column) -> Column:
    """Double every backslash that does not start a legal JSON escape."""
    return F.regexp_replace(text, STRAY_BACKSLASH, r"\\\\")


def _wrapped(text: Column) -> Column:
    # The array wrapper plus the sentinel after it makes Spark's lenient JSON
    # reader as strict as a full-document parser: trailing text, several
    # objects or a closing bracket too many all leave ``end`` unset or corrupt.
    return F.from_json(F.concat(F.lit('{"w":['), text, F.lit('],"end":1}')),
                       _WRAP_SCHEMA, _JSON_OPTS)


def _is_clean(p: Column) -> Column:
    return (p["_corrupt_record"].isNull() & (p["end"] == 1)
            & (F.size(p["w"]) == 1) & p["w"][0].isNotNull())


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    ``fn`` may use its argument many times without copying the (expensive)
    expression; Catalyst substitutes projections into filters, and without
    this binding a parse referenced n times would be evaluated n times.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def _attempt(ok1, ok2, raw) -> Column:
    return F.struct(ok1.alias("ok1"), ok2.alias("ok2"), raw.cast("string").alias("raw"))


def parse_total(text: Column) -> Column:
    """Struct(status, score, repaired) for one judge reply.

    status is ``ok`` (object with a numeric total), ``no_score`` (an object
    without a usable total) or ``bad`` (not exactly one JSON object, also after
    the backslash repair). NULL text gives a NULL struct. The clean text is
    parsed once; the repaired text only when the clean parse failed.
    """
    def second_try(c):
        return bind(_wrapped(escape_repair(c)), lambda p2: bind(
            F.coalesce(_is_clean(p2), F.lit(False)),
            lambda ok2: _attempt(F.lit(False), ok2, F.when(ok2, p2["w"][0][TOTAL_KEY]))))

    def tries(c):
        return bind(_wrapped(c), lambda p1: F.when(
            F.coalesce(_is_clean(p1), F.lit(False)),
            _attempt(F.lit(True), F.lit(False), p1["w"][0][TOTAL_KEY])).otherwise(second_try(c)))

    def finish(r):
        return bind(F.nanvl(r["raw"].try_cast("double"), F.lit(None).cast("double")), lambda score: F.struct(
            F.when(~(r["ok1"] | r["ok2"]), F.lit(STATUS_BAD))
             .when(score.isNull(), F.lit(STATUS_NO_SCORE))
             .otherwise(F.lit(STATUS_OK)).alias("status"),
            score.alias("score"),
            r["ok2"].alias("repaired")))

    return F.when(text.isNotNull(), bind(bind(strip_fence(text), tries), finish))


def with_parsed_total(df, text: Column, out: str = "judge"):
    """Add the ``parse_total`` struct of ``text`` as column ``out``."""
    return df.withColumn(out, parse_total(text))


def extract_embedded_block(text: Column) -> Column:
    """Text between the first ```json and the following ``` ('' if none)."""
    return F.regexp_extract(text, r"(?is)```json\s*(.*?)\s*```", 1)


def parse_total_embedded(text: Column) -> Column:
    """Like ``parse_total`` but reads a fenced block anywhere in the text."""
    block = extract_embedded_block(text)
    return F.when(block != "", parse_total(block)).otherwise(parse_total(text))


_PROVIDER_SCHEMA = (
    "choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>, "
    "content STRING"
)
_CONTENT_LIST_SCHEMA = "content ARRAY<STRUCT<text: STRING>>"


def judge_text(raw: Column) -> Column:
    """Provider-agnostic text of a judge response stored as JSON text.

    chat-completion shape -> choices[0].message.content; a content list ->
    content[0].text; a content string -> content; anything else -> the raw
    text. NULL -> the fixed error message.
    """
    def read(p, plist, raw):
        first_choice = F.try_element_at(p["choices"], F.lit(1))
        from_choices = F.when(F.size(p["choices"]) > 0,
                              F.coalesce(first_choice["message"]["content"], F.lit("")))
        first_part = F.try_element_at(plist["content"], F.lit(1))
        from_list = F.when(F.size(plist["content"]) > 0, first_part["text"])
        content_str = p["content"]
        # a JSON list reads as one in the list schema; a string that merely starts with '[' doesn't
        from_content = F.when(content_str.isNotNull() & (content_str != "") & plist["content"].isNull(), content_str)
        return F.coalesce(from_choices, from_list, from_content, raw)

    # Each shape is parsed once per row (bound), however often it is read; the
    # lambda sees only its bound struct (no outer column inside the lambda).
    both = F.struct(raw.alias("raw"), F.from_json(raw, _PROVIDER_SCHEMA).alias("p"),
                    F.from_json(raw, _CONTENT_LIST_SCHEMA).alias("pl"))
    parsed = bind(both, lambda b: read(b["p"], b["pl"], b["raw"]))
    return F.when(raw.isNull(), F.lit("Error: Model returned None")).otherwise(parsed)
