"""Quality rules by distribution divergence, in DataFrame operations only.

Base rules reject texts of few words or of many repeated 5-word windows. The
others are compared with the reference of their language: the distribution of
character classes and of the language's commonest short words, both summed over
all texts that pass the base rules. A text is rejected when either
Jensen-Shannon distance (base 2, 0 to 1) is above its threshold; texts of fewer
than ``min_words`` words are not judged by it.

A language has a reference if its texts that pass the base rules hold at least
``min_ref_words`` words, however small a share of the table that is. Texts of
other languages, and of none, are judged by the base rules alone: another
language's histogram says nothing about them.

Defined cases: null or empty text has no words and fails the base rules; the
distances of a text without a reference are null; repeated rows are judged
alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, with_uid

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"
#: Character classes of the histogram as sets of a regular expression; the rest of a text is one more.
CLASSES = [r"a-z", r"A-Z", r"0-9", r"\x20\x09-\x0D", r".,;:!?'\"()\-", SYMBOLS, r"\p{L}&&[^a-zA-Z]"]


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the set: what is left when runs of others are taken out."""
    if "&&" in chars:  # letters beyond ASCII: a text without any needs no look
        return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(F.regexp_replace(text, f"[^[{chars}]]+", "")))
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for the row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, gram: int) -> Column:
    """Words in windows of ``gram`` words that the text holds twice or more."""

    def covered(p):  # sorted starts: each adds the words that the one before it didn't cover
        return F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-gram).alias("last")),
                           lambda a, x: F.struct((a["n"] + F.least(F.lit(gram), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def twice(s):  # (hash, start) in order: starts with an equal neighbour
        return F.filter(F.transform(s, lambda x, k: F.when(
            F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"])),
            lambda i: i.isNotNull())

    def of_grams(g):
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(
            covered(F.sort_array(_let(pairs, twice))))

    def grams(h):
        return F.when(F.size(h) >= gram, _let(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - gram, F.lit(0))), lambda i: F.xxhash64(
            *(F.get(h, i + k) for k in range(gram)))), of_grams)).otherwise(F.lit(0).cast("bigint"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, letters: int, gram: int = 5) -> DataFrame:
    """(uid, id, lang, short, chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed).

    ``short`` holds the text's short words, lower-cased: all that the references
    and the word distance read, so a text is split once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_uid(docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text")))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "uid", "id", "lang", _short(F.col("words"), letters).alias("short"), F.array(*(_count(F.col("text"), c) for c in CLASSES)).alias("some"), F.length("text").alias("all"),
        F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("words"), gram).alias("n_repeat_words"))
    rest = F.col("all") - F.aggregate("some", F.lit(0), lambda a, x: a + x)
    return rows.select(
        "uid", "id", "lang", "short", F.concat("some", F.array(rest)).alias("chars"), "n_words", "word_chars",
        F.get("some", F.lit(CLASSES.index(SYMBOLS))).cast("bigint").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))


def _short(words: Column, letters: int) -> Column:
    return F.transform(F.filter(words, lambda w: (F.length(w) <= letters) & w.rlike(r"^\p{L}+$")), F.lower)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays, base 2; 1 if just one of them is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    tp, tq = total(p), total(q)

    def term(x, y):
        m = (x + y) / 2
        return (half(x, m) + half(y, m)) / 2

    norm = lambda a, t: F.transform(a, lambda x: x / t)
    sum_ = total(F.zip_with(norm(p, tp), norm(q, tq), term))
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(sum_, F.lit(0.0)))).when(tp == tq, 0.0).otherwise(1.0)


def references(rows: DataFrame, n_common: int, min_ref_words: int) -> DataFrame:
    """(lang, common, q_words, q_chars) of each language with enough words, from staged measures.

    ``q_words`` counts the common words and, last, all other words.
    """
    n_classes = len(CLASSES) + 1
    per_lang = rows.filter(~F.col("base_failed") & F.col("lang").isNotNull()).groupBy("lang").agg(
        F.sum("n_words").alias("n"), F.array(*(F.sum(F.get("chars", F.lit(k))).cast("double") for k in range(n_classes))).alias("q_chars"))
    own = stage(per_lang.filter(F.col("n") >= min_ref_words), "rules-langs")
    words = rows.filter(~F.col("base_failed")).select("lang", F.explode("short").alias("w"))
    counts = stage(words.groupBy("lang", "w").agg(F.count("*").alias("c")), "rules-words")
    every = counts.join(own.select("lang"), "lang", "left_semi")
    top = every.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))).filter(F.col("r") <= n_common)
    known = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "c"))).alias("t"), F.sum("c").alias("known"))
    return (own.join(known, "lang", "left")
            .select("lang", F.coalesce(F.col("t.w"), F.array().cast("array<string>")).alias("common"), "q_chars",
                    F.concat(F.coalesce(F.col("t.c"), F.array().cast("array<bigint>")), F.array(F.col("n") - F.coalesce("known", F.lit(0))))
                    .cast("array<double>").alias("q_words")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 30,
          n_common: int = 16, letters: int = 5, min_ref_words: int = 1_000, max_chars: float = 0.27, max_words: float = 0.45) -> DataFrame:
    """(uid, id, measures, base_failed, js_chars, js_words, kept), one row for each row of ``docs``."""
    rows = stage(measures(docs, id_col, text_col, lang_col, letters), "rules-measures")
    refs = stage(references(rows, n_common, min_ref_words), "rules-references")
    # common words of the text, then how often each occurs; the rest is one more bin
    some = F.filter("short", lambda w: F.array_contains(F.col("common"), w))
    hist = _let(some, lambda s: F.concat(F.transform("common", lambda c: F.size(F.filter(s, lambda w: w == c)).cast("double")),
                                         F.array((F.col("n_words") - F.size(s)).cast("double"))))
    # joined by language, broadcast or not by the size of the written table
    judged = rows.join(refs, "lang", "left").withColumns({
        "js_words": F.when(F.col("common").isNotNull(), _let(hist, lambda p: js_distance(p, F.col("q_words")))),
        "js_chars": F.when(F.col("q_chars").isNotNull(), js_distance(F.col("chars").cast("array<double>"), F.col("q_chars")))})
    odd = (F.col("n_words") >= min_words) & ((F.col("js_chars") > max_chars) | (F.col("js_words") > max_words))
    return stage(judged.select(
        "uid", F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "js_chars", "js_words", (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept")), "rules-verdicts")
