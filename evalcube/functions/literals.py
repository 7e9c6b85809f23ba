"""Python literals (lists, dicts, strings, None / True / False) read as JSON, in built-in expressions.

The text is cut into string tokens and what lies between them by one regular
expression without nested repetition, each token is translated on its own, and
the tokens are joined again: the work grows with the text, however deep it is
nested or however many quotes it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .judge_parse import bind

# A noncharacter marks what a backslash had escaped while quotes are looked for.
_MARK = "\ufdd0"
_OWN, _BACKSLASH, _SINGLE, _DOUBLE = (_MARK + d for d in "0123")

_TOKENS = "'[^']*'|\"[^\"]*\"|[^'\"]+"
JSON_OPTS = {"allowUnquotedControlChars": "true"}


def _hide_escapes(text: Column) -> Column:
    """Escaped backslashes and quotes as marks, so that each quote left opens or closes a string."""
    t = F.replace(text, F.lit(_MARK), F.lit(_OWN))
    t = F.replace(t, F.lit("\\\\"), F.lit(_BACKSLASH))
    t = F.replace(t, F.lit("\\'"), F.lit(_SINGLE))
    return F.replace(t, F.lit('\\"'), F.lit(_DOUBLE))


def _string(token: Column) -> Column:
    """A string token in JSON spelling."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    body = F.replace(body, F.lit('"'), F.lit('\\"'))
    body = F.regexp_replace(body, r"\\\r?\n", "")  # a line continued
    body = F.regexp_replace(body, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    for escape, code in (("a", "07"), ("v", "0b")):
        body = F.replace(body, F.lit("\\" + escape), F.lit("\\u00" + code))
    # the backslash of an unknown escape stands for itself
    body = F.regexp_replace(body, r'\\(?!["bfnrt/]|u[0-9a-fA-F]{4})', r"\\\\")
    body = F.replace(body, F.lit(_SINGLE), F.lit("'"))
    body = F.replace(body, F.lit(_DOUBLE), F.lit('\\"'))
    body = F.replace(body, F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(body, F.lit(_OWN), F.lit(_MARK)), F.lit('"'))


def _bare(token: Column) -> Column:
    """What lies between strings: words in JSON spelling, tuples as lists, no comma before a closing bracket."""
    t = token
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        t = F.regexp_replace(t, rf"\b{word}\b", json_word)
    t = F.translate(t, "()", "[]")
    t = F.regexp_replace(t, r",(\s*[\]}])", "$1")
    return F.regexp_replace(t, r"\b[uU]$", "")


def literal_to_json(text: Column) -> Column:
    """JSON text of a Python literal; JSON stays JSON. NULL where a quote is left open."""
    def join(p):
        tokens = F.transform(p["tokens"], lambda t: F.when(F.substring(t, 1, 1).isin("'", '"'), _string(t)).otherwise(_bare(t)))
        whole = F.aggregate(p["tokens"], F.lit(0), lambda n, t: n + F.length(t)) == F.length(p["text"])
        return F.when(whole, F.array_join(tokens, ""))

    hidden = bind(_hide_escapes(text), lambda t: F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(_TOKENS), F.lit(0)).alias("tokens")))
    return bind(hidden, join)


def from_literal(text: Column, ddl: str) -> Column:
    """``text`` read as ``ddl``: as JSON, and if it is none, as a Python literal; unreadable text gives NULL."""
    return F.coalesce(F.from_json(text, ddl), F.from_json(literal_to_json(text), ddl, JSON_OPTS))
