"""Queries of resume / incremental judging (§2.2 B12-B13, §2.3 C1, §2.5 E5, §2.10 J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import ALIAS_COL, eval_projection
from ..session import scratch_path
from ..sources.fixtures import judged_records
from ..streaming import incremental as I
from .oracle_base import with_rec
from .q_scoring import crit_sql
from .registry import query

A = ALIAS_COL


def _work_and_done(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Work table of every record; the first half of the ids judged earlier.

    The half point is a scalar subquery over the records (max id + 1) / 2.
    """
    recs = judged_records(spark, sf_dir)
    half = recs.agg(((F.max("id") + 1) / 2).alias("h")).scalar()
    work = eval_projection(recs)
    done = recs.filter(F.col("id") < half).select(
        "id", F.col("eval_result").alias("eval_response"), "eval_result")
    return work, done


_PENDING = """
, half AS (SELECT (max(e) + 1) / 2 AS h FROM rec),
done AS (SELECT e FROM rec WHERE e < (SELECT h FROM half) AND e % 101 <> 0),
pend AS (SELECT e, alias FROM rec WHERE label_task IS NOT NULL AND e NOT IN (SELECT e FROM done))"""


@query("resume_merge", with_rec(_PENDING + """
SELECT r.e AS id, CASE WHEN r.e < (SELECT h FROM half) AND r.e % 101 <> 0 THEN true ELSE false END AS has_existing
FROM rec r"""))
def resume_merge(spark, sf_dir):
    work, done = _work_and_done(spark, sf_dir)
    m = I.resume_merge(work, done)
    return m.select("id", (F.coalesce(F.col("eval_response_existing"), F.lit("")) != "").alias("has_existing"))


@query("pending_rows", with_rec(_PENDING + """
SELECT e AS id, alias AS answerer_llm_alias FROM pend"""))
def pending_rows(spark, sf_dir):
    work, done = _work_and_done(spark, sf_dir)
    return I.pending_rows(I.resume_merge(work, done)).select("id", A)


@query("resume_point", with_rec(_PENDING + """
SELECT min(e) AS resume_id, count(*) AS n_pending FROM pend"""))
def resume_point(spark, sf_dir):
    work, done = _work_and_done(spark, sf_dir)
    return I.resume_point(I.pending_rows(I.resume_merge(work, done)))


@query("pending_slice", with_rec(_PENDING + """
SELECT e AS id, alias AS answerer_llm_alias FROM pend ORDER BY e LIMIT 3"""))
def pending_slice(spark, sf_dir):
    work, done = _work_and_done(spark, sf_dir)
    return I.pending_slice(I.pending_rows(I.resume_merge(work, done)), 3).select("id", A)


@query("judge_pending", with_rec(_PENDING + """
SELECT e AS id, 'ok' AS status, CAST(0.0 AS DOUBLE) AS score FROM pend"""))
def judge_pending(spark, sf_dir):
    # Offline scorer without a reference: every pending row is judged 0.0.
    work, done = _work_and_done(spark, sf_dir)
    judged = I.judge_pending(work, done)
    return judged.select("id", F.col("judge.status").alias("status"), F.col("judge.score").alias("score"))


@query("resume_latest", with_rec("""
SELECT e AS id, CASE WHEN e % 2 = 0 THEN concat('reply ', e) END AS reply, CASE WHEN e % 2 = 0 THEN 'a' ELSE 'b' END AS prompt FROM rec"""))
def resume_latest(spark, sf_dir):
    """Repeated earlier results: an empty reply under a later prompt doesn't hide the one that was given."""
    recs = judged_records(spark, sf_dir)
    work = eval_projection(recs).select("id")
    row = lambda prompt, reply: F.struct(F.lit(prompt).alias("eval_prompt"), reply.alias("eval_response"))
    reply = F.when(F.col("id") % 2 == 0, F.concat(F.lit("reply "), F.col("id").cast("string")))
    done = recs.select("id", F.inline(F.array(row("b", F.lit(None).cast("string")), row("a", reply))))
    return I.resume_merge(work, done).select("id", F.col("eval_response_existing").alias("reply"), F.col("eval_prompt_existing").alias("prompt"))


@query("stream_incremental", crit_sql("""
SELECT c.e AS id, c.alias AS answerer_llm_alias, r.template, 'ok' AS status, CAST(0.0 AS DOUBLE) AS score
FROM rec c LEFT JOIN routing r ON r.task = c.label_task[1] WHERE c.label_task IS NOT NULL"""))
def stream_incremental(spark, sf_dir):
    """Two file drops judged by two runs, the second after its checkpoint was lost, then a run with nothing new.

    A failed attempt has left an uncommitted part as well. Every record is judged
    exactly once; the committed results are read back.
    """
    recs = judged_records(spark, sf_dir)
    half = recs.agg(((F.max("id") + 1) / 2).alias("h")).scalar()
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    schema = recs.schema
    recs.filter(F.col("id") < half).write.mode("append").parquet(src)
    I.run_incremental(spark, src, sink, ckpt, schema).read(I.RESULT_DDL).limit(3).write.parquet(f"{sink}/parts/failed")
    ckpt = scratch_path(spark, "stream-ckpt")
    recs.filter(F.col("id") >= half).write.mode("append").parquet(src)
    I.run_incremental(spark, src, sink, ckpt, schema)
    return I.run_incremental(spark, src, sink, ckpt, schema).read(I.RESULT_DDL).select("id", A, "template", "status", "score")
