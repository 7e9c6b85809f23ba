"""Incremental judging: resume from earlier results, and a file-stream twin.

Batch form: the work table is left-joined with earlier judge output on ``id``
(one shuffle join; AQE broadcasts the smaller side when it is small), rows
without a judged reply are pending. Stream form: Structured Streaming over a
folder of record files with ``trigger(availableNow=True)`` and a checkpoint in
the shared work folder, so a second run reads only files that arrived since;
results go to a commit log, and what it holds already is not judged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import eval_projection
from ..operators.prompts import with_judge_prompt
from ..operators.scoring import Scorer, judge_batch, offline_scorer
from .commit_log import CommitLog, stream_id

EXISTING_SUFFIX = "_existing"
RESULT_COLUMNS = ["eval_prompt", "eval_response", "eval_result"]


def resume_merge(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Earlier results joined onto the work table as ``<col>_existing`` columns.

    Of several earlier rows of an id one with a reply is taken before one without;
    of those the greatest by (reply, result, prompt).
    """
    cols = [c for c in RESULT_COLUMNS if c in done.columns]
    order = [c for c in ("eval_response", "eval_result", "eval_prompt") if c in cols]
    answered = F.coalesce(F.col("eval_response"), F.lit("")) != "" if "eval_response" in cols else F.lit(True)
    latest = (done.groupBy(key).agg(F.max(F.struct(answered.alias("answered"), *order)).alias("r"))
              .select(key, *(F.col(f"r.{c}").alias(c) for c in cols)))
    prev = latest.select(key, *[F.col(c).alias(c + EXISTING_SUFFIX) for c in cols])
    return work.join(prev, key, "left")


def pending_rows(merged: DataFrame) -> DataFrame:
    """Rows still to judge: no earlier reply (NULL or '') and at least one task label."""
    reply = F.coalesce(F.col("eval_response" + EXISTING_SUFFIX), F.lit(""))
    return merged.filter((reply == "") & (F.coalesce(F.size("label_task"), F.lit(0)) > 0))


def resume_point(pending: DataFrame, key: str = "id") -> DataFrame:
    """Smallest pending id and the number of pending rows (an empty set gives NULL, 0)."""
    return pending.agg(F.min(key).alias("resume_id"), F.count(F.lit(1)).alias("n_pending"))


def pending_slice(pending: DataFrame, batch_size: int = 3, key: str = "id") -> DataFrame:
    """The next batch: the ``batch_size`` smallest pending ids (a top-k, not a sort)."""
    return pending.orderBy(key).limit(batch_size)


def judge_pending(work: DataFrame, done: DataFrame, scorer: Scorer = offline_scorer) -> DataFrame:
    """Render prompts for the pending rows and judge them; earlier rows are not touched."""
    pend = pending_rows(resume_merge(work, done))
    pend = pend.withColumn("primary_task", F.try_element_at("label_task", F.lit(1)))
    pend = with_judge_prompt(pend)
    return judge_batch(pend.drop(*[c for c in RESULT_COLUMNS if c != "eval_prompt"]), scorer)


#: Columns of a committed result.
RESULT_DDL = ("id BIGINT, lr_answer_bronze_id BIGINT, answerer_llm_alias STRING, template STRING, eval_response STRING, "
              "status STRING, score DOUBLE")


def _judge_micro_batch(scorer: Scorer, log: CommitLog, checkpoint_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        own = stream_id(log.spark, checkpoint_dir)
        if log.committed(own, batch_id):
            return  # replayed after its commit: the results are there
        # rows without a task label are not judged, in a stream as in a batch; others once, whatever run has done so
        rows = log.unseen(batch.filter(F.coalesce(F.size("label_task"), F.lit(0)) > 0))
        work = eval_projection(rows).drop("eval_prompt", "eval_response", "eval_result")
        work = work.withColumn("primary_task", F.try_element_at("label_task", F.lit(1)))
        judged = judge_batch(with_judge_prompt(work), scorer)
        log.write(judged.select("id", "lr_answer_bronze_id", "answerer_llm_alias", "template", "eval_response",
                                F.col("judge.status").alias("status"), F.col("judge.score").alias("score")), own, batch_id)
    return run


def run_incremental(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                    schema, scorer: Scorer = offline_scorer) -> CommitLog:
    """Judge every record file that arrived in ``source_dir`` since the last run; the results are the returned log's.

    ``availableNow`` processes what is there and stops; the checkpoint records
    the files already read, so re-running without new files adds nothing and
    a failed run resumes from its last committed micro-batch. Without the
    checkpoint all files are read again, but only ids that no commit holds are
    judged: nothing is lost, doubled or overwritten.
    """
    log = CommitLog(spark, sink_dir)
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(_judge_micro_batch(scorer, log, checkpoint_dir))
               .option("checkpointLocation", checkpoint_dir)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return log
