"""One query for each operator, over whole tables, with DuckDB statements where SQL can express the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_windows, conversation_repair, hnsw, language_id, mixing, ngram_join, packing, pu_quality, quality_rules, resampling, sharding,
               suffix_dedup, warc)
from .common import read_documents, stage


def tokenizer_path() -> str:
    """The public vocabulary the packing query uses (installed on every machine)."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(read_documents(spark, sf_dir, "pages"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read_documents(spark, sf_dir), tokenizer_path(), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = language_id.identify(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicate_groups(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, slices = mixing.mix(read_documents(spark, sf_dir))
    taken = slices.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "uid", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


#: A conversation whose texts hold the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"), F.lit(role).alias("role"),
                 F.lit(CONTROL).alias("text")) for k, role in enumerate(("user", "assistant"))))))
    formatted = stage(chat_windows.windows(chats.union(extra)), "chat-windows")
    back = chat_windows.read_back(formatted)
    return back.select(F.col("conv").alias("conv_id"), F.col("n_turns").cast("bigint").alias("n_turns"),
                       F.sha2(F.encode("turns", "UTF-8"), 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"),
                       F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


def op9_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hnsw.vector_groups(read_documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    out = pu_quality.score_quality(docs, read_documents(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.importance_resample(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_documents(spark, sf_dir, "conversations")
    audits, fixed = conversation_repair.repair(conversation_repair.damage(chats))
    # every conversation, also those that the damage left no row of; the parts meet in one aggregate, null ids included
    every = (chats.select(F.col("conv_id").alias("conv")).unionByName(audits, allowMissingColumns=True)
             .unionByName(conversation_repair.digests(stage(fixed, "cr-fixed")), allowMissingColumns=True))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = every.groupBy("conv").agg(*(F.max(c).alias(c) for c in [*counts, "audit", "repaired_sha256"]))
    return one.select(F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = sharding.shard_rows(read_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_warc_index, op3_quality_rules, op4_pattern_packing, op5_language_id, op6_ngram_jaccard,
    op7_source_mixing, op8_chat_windows, op9_hnsw_dedup, op10_pu_quality,
    op11_importance_resampling, op12_conversation_repair, op13_slot_sharding, pipeline)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the resampling features.
_FEATURES = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _crc32(x: str) -> str:
    """crc32 of the UTF-8 bytes of a string, bit by bit."""
    step = f"xor(c, CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({x})), 2 * (i // 8) + 1, 2))::BIGINT ELSE 0 END)"
    return (f"xor(list_reduce(range(8 * octet_length(encode({x}))), lambda c, i: xor({step} >> 1, 3988292384 * ({step} & 1)),"
            " 4294967295::BIGINT), 4294967295)")


ORACLE = {
    "op2_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest FROM d),
m AS (SELECT payload_digest, max(page_id) AS top FROM b GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b JOIN m USING (payload_digest)""",
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, """ + _WORDS.format("coalesce(text, '')") + r""" AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(k) AS n FROM (SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS k FROM s)
      GROUP BY 1),
a AS (SELECT doc_id, lang, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
c0 AS (SELECT *, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS c1, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS c2,
      length(regexp_replace(t, '[^0-9]+', '', 'g')) AS c3, length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) AS c4,
      length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS c5, n_symbols AS c6,
      length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS cl FROM a),
c AS (SELECT *, cl - c1 - c2 AS c7, length(t) - c1 - c2 - c3 - c4 - c5 - c6 - (cl - c1 - c2) AS c8 FROM c0),
own AS (SELECT lang FROM c WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 1000),
e AS (SELECT c.*, c.lang AS ref FROM c JOIN own ON c.lang = own.lang),
sound AS (SELECT * FROM e WHERE NOT base_failed),
qc AS (SELECT ref, [sum(c1), sum(c2), sum(c3), sum(c4), sum(c5), sum(c6), sum(c7), sum(c8)] AS q, sum(n_words) AS n FROM sound GROUP BY 1),
short AS (SELECT doc_id, ref, lower(x) AS x FROM (SELECT doc_id, ref, unnest(w) AS x FROM sound)
          WHERE length(x) <= 5 AND regexp_matches(x, '^\p{L}+$')),
k AS (SELECT ref, x, n, row_number() OVER (PARTITION BY ref ORDER BY n DESC, x) AS r FROM (SELECT ref, x, count(*) AS n FROM short GROUP BY 1, 2)),
top AS (SELECT * FROM k WHERE r <= 16),
qw AS (SELECT ref, list(x ORDER BY r) AS words, list(n ORDER BY r) AS q, sum(n) AS known FROM top GROUP BY 1),
dw AS (SELECT doc_id, ref, lower(x) AS x, count(*) AS n FROM (SELECT doc_id, ref, unnest(w) AS x FROM e) WHERE length(x) <= 5 AND regexp_matches(x, '^\p{L}+$') GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, r, dw.n FROM dw JOIN top ON dw.ref = top.ref AND dw.x = top.x),
bins AS (
  SELECT doc_id, 'c' AS kind, i, [c1, c2, c3, c4, c5, c6, c7, c8][i]::DOUBLE AS p, q[i]::DOUBLE AS q
  FROM (SELECT e.*, qc.q, unnest(range(1, 9)) AS i FROM e JOIN qc USING (ref))
  UNION ALL
  SELECT e.doc_id, 'w', top.r, coalesce(hit.n, 0)::DOUBLE, top.n::DOUBLE FROM e JOIN top USING (ref) LEFT JOIN hit ON hit.doc_id = e.doc_id AND hit.r = top.r
  UNION ALL
  SELECT e.doc_id, 'w', 99, (e.n_words - coalesce(h.n, 0))::DOUBLE, (qc.n - coalesce(qw.known, 0))::DOUBLE
  FROM e JOIN qc USING (ref) LEFT JOIN qw USING (ref) LEFT JOIN (SELECT doc_id, sum(n) AS n FROM hit GROUP BY 1) h ON h.doc_id = e.doc_id),
norm AS (SELECT doc_id, kind, p / nullif(sum(p) OVER v, 0) AS p, q / nullif(sum(q) OVER v, 0) AS q FROM bins WINDOW v AS (PARTITION BY doc_id, kind)),
js AS (SELECT doc_id, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
       + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS j FROM norm GROUP BY 1, 2),
v AS (SELECT doc_id, bool_or((kind = 'c' AND j > 0.27) OR (kind = 'w' AND j > 0.45)) AS odd FROM js GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= 30 AND odd, FALSE) AS kept
FROM c LEFT JOIN v USING (doc_id)""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, """ + _WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')") + r""" AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
t AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
link AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM t p JOIN t q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2)
         JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON n.doc_id = reach.a GROUP BY 1, 2""",
    "op8_chat_windows": r"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER o AS pos, sum(ceil(length(text) / 4.0)::BIGINT + 4) OVER o - (ceil(length(text) / 4.0)::BIGINT + 4) AS start,
      4 + length(role) + 2 + length(text) + 8 + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS n
      FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
w AS (SELECT *, start // 1024 AS win FROM t),
sp AS (SELECT conv_id, win, min(start) AS f FROM w GROUP BY 1, 2),
sys AS (SELECT * FROM w WHERE pos = 1 AND role = 'system'),
c AS (SELECT conv_id, n FROM w
  UNION ALL SELECT w.conv_id, w.n FROM w JOIN sp ON sp.conv_id = w.conv_id AND sp.win = w.win + 1 WHERE sp.f - w.start <= 256
  UNION ALL SELECT sys.conv_id, sys.n FROM sys JOIN sp ON sp.conv_id = sys.conv_id AND sp.win > sys.win
            WHERE NOT (sp.win = sys.win + 1 AND sp.f <= 256)),
h AS (SELECT conv_id, sum(n)::BIGINT AS formatted_chars FROM c GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS u,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS v FROM x GROUP BY 1)
SELECT conv_id, n_turns, sha256(u) AS turns_sha256, length(v) AS loss_chars, sha256(v) AS loss_sha256, formatted_chars
FROM a JOIN h USING (conv_id)""",
    "op11_importance_resampling": r"""
WITH w AS (SELECT doc_id, """ + _FEATURES + r""" AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS x FROM w),
t AS (SELECT unnest(""" + _FEATURES + r""") AS x FROM benchmark),
v AS (SELECT x, """ + _crc32("x") + r""" % 10000 AS b FROM (SELECT x FROM f UNION SELECT x FROM t)),
fs AS (SELECT b, count(*)::DOUBLE AS n FROM f JOIN v USING (x) GROUP BY 1),
ft AS (SELECT b, count(*)::DOUBLE AS n FROM t JOIN v USING (x) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((coalesce(ft.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM fs) + 10000)
        / ((coalesce(fs.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM ft) + 10000))))::BIGINT AS gain
      FROM (SELECT DISTINCT b FROM v) LEFT JOIN fs USING (b) LEFT JOIN ft USING (b)),
d AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN v USING (x) JOIN g USING (b) GROUP BY 1),
s AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= 20
      QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM s LEFT JOIN r USING (doc_id)""",
    "op12_conversation_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS x FROM conversations),
k AS (SELECT *, """ + _crc32("x") + r""" % 20 AS f FROM c),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE f <> 0),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
        lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS ini FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE i > 1 AND substr(before, 1, 1) || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS len FROM g GROUP BY 1),
-- states: n(othing yet), s, u, a; with the turns inserted before the next one
m(st, ins, mid) AS (VALUES ('n', '', 'n'), ('n', 'u', 'u'), ('n', 'ua', 'a'), ('s', '', 's'), ('s', 'u', 'u'), ('s', 'ua', 'a'),
        ('u', '', 'u'), ('u', 'a', 'a'), ('u', 'au', 'u'), ('a', '', 'a'), ('a', 'u', 'u'), ('a', 'ua', 'a')),
e(mid, op, nxt) AS (VALUES ('n', 'D', 'n'), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a'), ('n', 'K', 's'), ('n', 'K', 'u'), ('s', 'K', 'u'),
        ('u', 'K', 'a'), ('a', 'K', 'u'), ('n', 'R', 'u'), ('s', 'R', 'u'), ('u', 'R', 'a'), ('a', 'R', 'u')),
p AS (SELECT st, mid, ins, op, nxt, 2 * length(ins) + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END AS cost, repeat('I', length(ins)) || op AS ed,
        replace(replace(ins, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10)) AS put FROM m JOIN e USING (mid)),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 'n' AS st, 0::BIGINT AS cost, '' AS audit, '' AS rep FROM n
  UNION ALL
  SELECT conv_id, i, st, cost, audit, rep FROM (
    SELECT v.conv_id, g.i, p.nxt AS st, v.cost + p.cost + CASE WHEN g.fault = 'truncated' AND p.op <> 'D' THEN 1 ELSE 0 END AS cost,
      v.audit || p.ed AS audit, v.rep || p.put || CASE p.op WHEN 'D' THEN '' WHEN 'K' THEN g.role || ':' || g.text || chr(10)
        ELSE CASE p.nxt WHEN 'u' THEN 'user:' ELSE 'assistant:' END || g.text || chr(10) END AS rep,
      row_number() OVER (PARTITION BY v.conv_id, p.nxt ORDER BY v.cost + p.cost + CASE WHEN g.fault = 'truncated' AND p.op <> 'D' THEN 1 ELSE 0 END,
        v.audit || p.ed) AS r
    FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1 JOIN p ON p.st = v.st
    WHERE (p.op = 'D' OR g.fault NOT IN ('blank', 'duplicate')) AND (p.op <> 'K' OR p.nxt = g.ini)) WHERE r = 1),
z AS (SELECT v.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal, v.cost + CASE st WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost,
        audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
        rep || CASE st WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS rep
      FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.len = v.i),
y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(CASE WHEN coalesce(rep, '') = '' THEN '' ELSE substr(rep, 1, length(rep) - 1) END) AS repaired_sha256
FROM a LEFT JOIN y ON a.conv_id IS NOT DISTINCT FROM y.conv_id""",
    "op9_hnsw_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
         WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
}
