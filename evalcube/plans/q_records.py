"""Queries over the records: parsing, cleaning, cost and profiles (§2.1-2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small

from ..functions.judge_parse import judge_text, parse_total_embedded, strip_fence, escape_repair
from ..operators import clean as C
from ..operators import profile as P
from ..operators.cost import token_usage
from ..sources.fixtures import eval_response_shapes, judged_records
from ..sources.tables import read_table
from .dashboard import cleaned_records, scored_records, scored_slim
from .oracle_base import with_rec, with_scored, with_text
from .registry import query

A = C.ALIAS_COL
G = C.GROUP_COL


# ---------------------------------------------------------------- parsing
@query("parse_status_counts", with_rec("""
SELECT jstatus AS status, repaired, count(*) AS n FROM cleaned GROUP BY 1, 2"""))
def parse_status_counts(spark, sf_dir):
    df = cleaned_records(spark, sf_dir)
    return df.groupBy(F.col("judge.status").alias("status"),
                      F.col("judge.repaired").alias("repaired")).agg(F.count(F.lit(1)).alias("n"))


@query("judge_parse", with_rec("""
SELECT e AS id, jstatus AS status,
       CASE WHEN jstatus = 'ok' THEN CAST(q100 AS DOUBLE) / 100.0 END AS score
FROM cleaned"""))
def judge_parse(spark, sf_dir):
    df = cleaned_records(spark, sf_dir)
    return df.select("id", F.col("judge.status").alias("status"), F.col("judge.score").alias("score"))


@query("strip_fence", with_text("""
SELECT e AS id, unfenced AS stripped FROM txt2 WHERE eval_result IS NOT NULL"""))
def strip_fence_q(spark, sf_dir):
    df = judged_records(spark, sf_dir).filter(F.col("eval_result").isNotNull())
    return df.select("id", strip_fence(F.col("eval_result")).alias("stripped"))


@query("escape_repair", with_text("""
SELECT e AS id, replace(unfenced, '\\', '\\\\') AS repaired_text
FROM txt2 WHERE eval_result IS NOT NULL AND position('\\' IN eval_result) > 0"""))
def escape_repair_q(spark, sf_dir):
    df = judged_records(spark, sf_dir).filter(F.col("eval_result").contains("\\"))
    return df.select("id", escape_repair(strip_fence(F.col("eval_result"))).alias("repaired_text"))


@query("judge_parse_embedded", with_rec("""
SELECT e AS id,
       CASE WHEN jstatus = 'ok' AND e % 2 = 0 THEN 'ok' ELSE 'bad' END AS status,
       CASE WHEN jstatus = 'ok' AND e % 2 = 0 THEN CAST(q100 AS DOUBLE) / 100.0 END AS score
FROM cleaned"""))
def judge_parse_embedded(spark, sf_dir):
    # Judge replies with prose around them: only a fenced block can be read.
    df = cleaned_records(spark, sf_dir)
    wrapped = F.concat(F.lit("The verdict follows.\n"), F.col("eval_result"), F.lit("\nThat is all."))
    p = parse_total_embedded(wrapped)
    return df.select("id", p["status"].alias("status"), p["score"].alias("score"))


@query("judge_text", with_text("""
SELECT e AS id, coalesce(eval_result, 'Error: Model returned None') AS judge_text FROM txt2"""))
def judge_text_q(spark, sf_dir):
    df = eval_response_shapes(judged_records(spark, sf_dir))
    return df.select("id", judge_text(F.col("eval_response")).alias("judge_text"))


@query("quality_score", with_scored("""
SELECT id, answerer_llm_alias, quality FROM scored"""))
def quality_score(spark, sf_dir):
    return scored_slim(spark, sf_dir).select("id", A, "quality")


# ---------------------------------------------------------------- projection, filters
@query("eval_projection", with_text("""
SELECT e AS id, g AS lr_answer_bronze_id, concat('src', g % 7) AS source_id, messages,
       label_task, label_level, label_domain, alias AS answerer_llm_alias, response,
       concat('r', e) AS content, 200 AS status_code, '' AS ref, concat('q', g) AS req,
       CASE WHEN e % 113 = 0 THEN '' ELSE concat('r', e) END AS res,
       '' AS eval_prompt, '' AS eval_response, '' AS eval_result
FROM txt2"""))
def eval_projection(spark, sf_dir):
    return C.eval_projection(judged_records(spark, sf_dir))


@query("extract_request", with_rec("""
SELECT e AS id, concat('q', g) AS req FROM rec"""))
def extract_request(spark, sf_dir):
    df = judged_records(spark, sf_dir)
    return df.select("id", C.request_text(F.col("messages")).alias("req"))


@query("extract_answer", with_rec("""
SELECT e AS id, CASE WHEN e % 113 = 0 THEN '' ELSE concat('r', e) END AS res FROM rec"""))
def extract_answer(spark, sf_dir):
    df = judged_records(spark, sf_dir)
    return df.select("id", C.answer_text(F.col("response")).alias("res"))


@query("valid_eval_rows", with_rec("""
SELECT e AS id, alias AS answerer_llm_alias FROM rec WHERE label_task IS NOT NULL"""))
def valid_eval_rows(spark, sf_dir):
    return C.valid_eval_rows(judged_records(spark, sf_dir)).select("id", A)


@query("clean_required", with_rec("""
SELECT e AS id, alias AS answerer_llm_alias FROM cleaned"""))
def clean_required(spark, sf_dir):
    return C.clean_required(judged_records(spark, sf_dir)).select("id", A)


@query("primary_task", with_rec("""
SELECT e AS id, label_task[1] AS primary_task FROM cleaned"""))
def primary_task(spark, sf_dir):
    return C.clean_required(judged_records(spark, sf_dir)).select(
        "id", C.primary_task(F.col("label_task")).alias("primary_task"))


@query("poisoned_groups", with_rec("""
SELECT g AS lr_answer_bronze_id, count(*) AS n_rows,
       count(*) FILTER (WHERE jstatus = 'bad') AS n_bad
FROM cleaned WHERE g IN (SELECT g FROM cleaned WHERE jstatus = 'bad') GROUP BY g"""))
def poisoned_groups(spark, sf_dir):
    df = cleaned_records(spark, sf_dir)
    bad = df.filter(F.col("judge.status") == "bad").select(G).distinct()
    return (df.join(bad, G, "left_semi").groupBy(G)
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_if(F.col("judge.status") == "bad").alias("n_bad")))


@query("complete_groups", with_rec("""
SELECT e AS id, g AS lr_answer_bronze_id FROM cleaned
WHERE g IN (SELECT g FROM cleaned GROUP BY g HAVING count(*) = 5)"""))
def complete_groups(spark, sf_dir):
    return C.complete_groups(C.clean_required(judged_records(spark, sf_dir))).select("id", G)


@query("request_literals", with_rec("""
SELECT e AS id, CASE WHEN e % 3 = 2 THEN '' ELSE concat('it''s "q', g, '" \\', chr(10), 'é') END AS req FROM rec"""))
def request_literals(spark, sf_dir):
    """Messages logged as Python literals: None, True, both quotes, escapes, a tuple; by id also JSON and unreadable text."""
    g = F.col(G).cast("string")
    literal = F.concat(F.lit("({'role': 'system', 'content': None, 'cached': True}, {'role': u'user', 'content': 'it\\'s \"q"), g,
                       F.lit("\" \\\\\\n\\xe9'},)"))
    as_json = F.concat(F.lit('[{"role": "system", "content": null}, {"role": "user", "content": "it\'s \\"q'), g, F.lit('\\" \\\\\\n\\u00e9"}]'))
    k = F.col("id") % 3
    df = judged_records(spark, sf_dir).withColumn("messages", F.when(k == 0, literal).when(k == 1, as_json).otherwise("[{'role': 'open"))
    return df.select("id", F.coalesce(C.request_text(F.col("messages")), F.lit("")).alias("req"))


@query("derive_group_id", with_text("""
SELECT e AS id, sha256(messages) AS derived_group_id FROM txt"""))
def derive_group_id(spark, sf_dir):
    df = judged_records(spark, sf_dir)
    return C.derive_group_id(df.drop(G)).select("id", F.col(G).alias("derived_group_id"))


# ---------------------------------------------------------------- cost
@query("token_usage", with_rec("""
SELECT e AS id, ptok AS prompt_tokens, ctok AS completion_tokens FROM rec"""))
def token_usage_q(spark, sf_dir):
    u = token_usage(F.col("response"))
    return judged_records(spark, sf_dir).select(
        "id", u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"))


@query("response_cost", with_scored("""
SELECT id, answerer_llm_alias, round(cost, 12) AS cost,
       CASE WHEN answerer_llm_alias NOT IN (SELECT alias FROM prices) THEN 'unpriced_model'
            WHEN prompt_tokens IS NULL THEN 'no_usage' ELSE 'ok' END AS cost_status
FROM scored"""))
def response_cost(spark, sf_dir):
    return scored_slim(spark, sf_dir).select("id", A, F.round("cost", 12).alias("cost"), "cost_status")


@query("dim_model_prices", with_scored("""
SELECT s.answerer_llm_alias, p.pin AS dollar_per_input_token, p.pout AS dollar_per_output_token,
       count(*) AS n_rows
FROM scored s LEFT JOIN prices p ON s.answerer_llm_alias = p.alias GROUP BY 1, 2, 3"""))
def dim_model_prices(spark, sf_dir):
    from ..sources.registry import model_registry
    reg = model_registry(spark).select(F.col("alias").alias(A), "dollar_per_input_token",
                                      "dollar_per_output_token")
    counts = scored_slim(spark, sf_dir).groupBy(A).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(broadcast_if_small(reg), A, "left").select(
        A, "dollar_per_input_token", "dollar_per_output_token", "n_rows")


@query("dim_unknown_models", with_rec("""
SELECT alias AS answerer_llm_alias, count(*) AS n_rows FROM cleaned
WHERE alias NOT IN (SELECT alias FROM prices) GROUP BY 1"""))
def dim_unknown_models(spark, sf_dir):
    from ..sources.registry import model_registry
    reg = model_registry(spark).select(F.col("key").alias(A))
    df = C.clean_required(judged_records(spark, sf_dir))
    return df.join(broadcast_if_small(reg), A, "left_anti").groupBy(A).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- profiles
_RAW_COLS = ["id", "lr_answer_bronze_id", "source_id", "messages", "label_task", "label_level",
             "label_domain", "answerer_llm_alias", "response", "content", "status_code", "eval_result"]
_NULLS = {"label_task": "count(*) FILTER (WHERE g % 103 = 0)",
          "eval_result": "count(*) FILTER (WHERE e % 101 = 0)"}
_MISSING_SQL = with_rec("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({_NULLS.get(c, '0')} AS BIGINT) AS missing_count, "
    f"round(CAST({_NULLS.get(c, '0')} AS DOUBLE) * 100.0 / count(*), 6) AS missing_pct FROM rec"
    for c in _RAW_COLS))


@query("missing_profile", _MISSING_SQL)
def missing_profile(spark, sf_dir):
    return P.missing_profile(judged_records(spark, sf_dir))


@query("value_counts", with_scored("""
SELECT answerer_llm_alias AS value, count(*) AS n FROM scored GROUP BY 1"""))
def value_counts(spark, sf_dir):
    return P.value_counts(scored_slim(spark, sf_dir), A)


def _dist_sql(expr: str, k: int | None = None, bottom: bool = False, unnest: bool = False) -> str:
    src = f"unnest({expr})" if unnest else expr
    order = "n ASC, value ASC" if bottom else "n DESC, value ASC"
    lim = f" ORDER BY {order} LIMIT {k}" if k else ""
    return with_text(f"""
SELECT value, n FROM (SELECT v AS value, count(*) AS n FROM (SELECT {src} AS v FROM txt2)
WHERE v IS NOT NULL GROUP BY 1){lim}""")


@query("dist_alias", _dist_sql("alias"))
def dist_alias(spark, sf_dir):
    return P.value_counts(judged_records(spark, sf_dir), A)


@query("dist_source", _dist_sql("concat('src', g % 7)"))
def dist_source(spark, sf_dir):
    return P.value_counts(judged_records(spark, sf_dir), "source_id")


@query("dist_task_top10", _dist_sql("label_task", 10, unnest=True))
def dist_task_top10(spark, sf_dir):
    return P.top_k(judged_records(spark, sf_dir), "label_task", 10, explode_lists=True)


@query("dist_task_bottom10", _dist_sql("label_task", 10, bottom=True, unnest=True))
def dist_task_bottom10(spark, sf_dir):
    return P.top_k(judged_records(spark, sf_dir), "label_task", 10, bottom=True, explode_lists=True)


@query("dist_domain", _dist_sql("label_domain", 10, unnest=True))
def dist_domain(spark, sf_dir):
    return P.top_k(judged_records(spark, sf_dir), "label_domain", 10, explode_lists=True)


@query("dist_level", _dist_sql("label_level", unnest=True))
def dist_level(spark, sf_dir):
    return P.value_counts(judged_records(spark, sf_dir), "label_level", explode_lists=True)


@query("group_size_hist", with_rec("""
SELECT group_size, count(*) AS n_groups FROM (SELECT g, count(*) AS group_size FROM cleaned GROUP BY g)
GROUP BY 1"""))
def group_size_hist(spark, sf_dir):
    return P.group_size_hist(C.clean_required(judged_records(spark, sf_dir)), G)


@query("distinct_models", with_scored("""
SELECT DISTINCT answerer_llm_alias FROM scored"""))
def distinct_models(spark, sf_dir):
    return scored_slim(spark, sf_dir).select(A).distinct()


@query("eval_coverage", with_rec("""
SELECT count(*) AS total, count(*) FILTER (WHERE e % 101 <> 0) AS judged,
       count(*) FILTER (WHERE e % 101 = 0) AS not_judged FROM rec"""))
def eval_coverage(spark, sf_dir):
    return P.eval_coverage(judged_records(spark, sf_dir))


@query("quality_summary", with_scored("""
SELECT answerer_llm_alias, count(quality) AS count, round(avg(quality), 3) AS mean,
       round(stddev_samp(quality), 3) AS std, round(min(quality), 3) AS min,
       round(max(quality), 3) AS max, round(median(quality), 3) AS median
FROM scored GROUP BY 1"""))
def quality_summary(spark, sf_dir):
    return P.quality_summary(scored_slim(spark, sf_dir))


def _pct_sql(col: str) -> str:
    return with_scored(f"""
SELECT answerer_llm_alias, round(avg({col}), 9) AS mean,
       round(quantile_cont({col}, 0.05), 9) AS p05, round(quantile_cont({col}, 0.25), 9) AS p25,
       round(quantile_cont({col}, 0.5), 9) AS p50, round(quantile_cont({col}, 0.75), 9) AS p75,
       round(quantile_cont({col}, 0.95), 9) AS p95, round(max({col}), 9) AS max
FROM scored GROUP BY 1""")


@query("quality_percentiles", _pct_sql("quality"))
def quality_percentiles(spark, sf_dir):
    return P.value_percentiles(scored_slim(spark, sf_dir), "quality")


@query("cost_percentiles", _pct_sql("cost"))
def cost_percentiles(spark, sf_dir):
    return P.value_percentiles(scored_slim(spark, sf_dir), "cost")


@query("quality_histogram", with_scored("""
, st AS (
  SELECT answerer_llm_alias,
         CASE WHEN min(quality) = max(quality) THEN min(quality) - 0.5 ELSE min(quality) END AS lo,
         CASE WHEN min(quality) = max(quality) THEN max(quality) + 0.5 ELSE max(quality) END AS hi
  FROM scored GROUP BY 1
), b AS (
  SELECT s.answerer_llm_alias,
         list_sum(list_transform(range(1, 30), lambda i: CASE WHEN st.lo + i * ((st.hi - st.lo) / 30) <= s.quality
                                                         THEN 1 ELSE 0 END)) AS bin
  FROM scored s JOIN st USING (answerer_llm_alias)
), c AS (SELECT answerer_llm_alias, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT st.answerer_llm_alias, CAST(r.bin AS INTEGER) AS bin,
       round(st.lo + r.bin * ((st.hi - st.lo) / 30), 9) AS bin_start,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM st CROSS JOIN (SELECT range AS bin FROM range(0, 30)) r
LEFT JOIN c ON c.answerer_llm_alias = st.answerer_llm_alias AND c.bin = r.bin""".lstrip()))
def quality_histogram(spark, sf_dir):
    return P.histogram(scored_slim(spark, sf_dir), "quality", 30)


@query("quality_overall", with_scored("""
SELECT count(quality) AS count, round(avg(quality), 9) AS mean, round(stddev_samp(quality), 9) AS std,
       round(min(quality), 9) AS min, round(quantile_cont(quality, 0.25), 9) AS p25,
       round(quantile_cont(quality, 0.5), 9) AS p50, round(quantile_cont(quality, 0.75), 9) AS p75,
       round(max(quality), 9) AS max FROM scored"""))
def quality_overall(spark, sf_dir):
    return P.quality_overall(scored_slim(spark, sf_dir))


@query("dist_all", with_text("""
SELECT dimension, value, count(*) AS n FROM (
  SELECT 'answerer_llm_alias' AS dimension, alias AS value FROM txt2
  UNION ALL SELECT 'source_id', concat('src', g % 7) FROM txt2
  UNION ALL SELECT 'label_task', unnest(label_task) FROM txt2
  UNION ALL SELECT 'label_domain', unnest(label_domain) FROM txt2
  UNION ALL SELECT 'label_level', unnest(label_level) FROM txt2
) WHERE value IS NOT NULL GROUP BY 1, 2"""))
def dist_all(spark, sf_dir):
    return P.all_distributions(judged_records(spark, sf_dir), [A, "source_id"],
                               ["label_task", "label_domain", "label_level"])


@query("approx_profile", with_scored("""
SELECT answerer_llm_alias, count(*) AS n_rows, round(avg(quality), 9) AS mean, min(quality) AS min, max(quality) AS max,
       TRUE AS ranks_ok, TRUE AS distinct_ok
FROM scored GROUP BY 1"""))
def approx_profile(spark, sf_dir):
    """Profile merged from two batches' sketches, its percentiles and distinct counts held against the exact ones."""
    from ..operators import sketches as SK
    from ..session import scratch_path
    path, scored = scratch_path(spark, "sketches"), scored_slim(spark, sf_dir)
    for batch in (0, 1, 1):  # the second batch is written again
        SK.append_batch(scored.filter(F.col("id") % 2 == batch), path, str(batch), [A], "quality", G)
    prof = SK.merged_profile(spark, path, [A])
    errors = SK.rank_errors(scored, prof, [A], "quality").select(A, F.greatest(*SK.PCT_NAMES).alias("err"))
    exact = scored.groupBy(A).agg(F.count_distinct(G).alias("exact"))
    out = prof.join(errors, A).join(exact, A)
    return out.select(A, "n_rows", F.round("mean", 9).alias("mean"), "min", "max", (F.col("err") <= 0.02).alias("ranks_ok"),
                      (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.06 * F.col("exact")).alias("distinct_ok"))
