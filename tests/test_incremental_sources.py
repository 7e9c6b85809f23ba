"""Stream re-runs judge each record once; reader dispatch and list literals."""

import pytest
from pyspark.sql import functions as F

from evalcube.session import scratch_path
from evalcube.sources import readers as RD
from evalcube.sources.fixtures import judged_records
from evalcube.streaming import incremental as I


def test_stream_runs_are_incremental(spark, sf_dir):
    recs = judged_records(spark, sf_dir)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-sink", "t-ckpt"))
    recs.filter("id < 300").write.mode("append").parquet(src)
    log = I.run_incremental(spark, src, sink, ckpt, recs.schema)
    first = log.read(I.RESULT_DDL).count()
    I.run_incremental(spark, src, sink, ckpt, recs.schema)  # nothing new
    labelled = recs.filter("id < 300 AND size(label_task) > 0").count()
    assert log.read(I.RESULT_DDL).count() == first == labelled
    recs.filter("id >= 300").write.mode("append").parquet(src)
    I.run_incremental(spark, src, sink, ckpt, recs.schema)
    out = log.read(I.RESULT_DDL)
    total = recs.filter("size(label_task) > 0").count()
    assert out.count() == total
    assert out.select("id").distinct().count() == total


def test_unknown_suffix_raises(spark):
    with pytest.raises(ValueError):
        RD.read_response_log(spark, "/nowhere/records.pickle")


def test_list_literals(spark):
    df = spark.createDataFrame([("['T1', 'T5']",), ("[None, 'D2']",), ("not a list",), (None,)], "s STRING")
    got = [r.a for r in df.select(RD.parse_list_literal(F.col("s")).alias("a")).collect()]
    assert got == [["T1", "T5"], [None, "D2"], None, None]


def test_pending_rows_exclude_done_and_unlabelled(spark, sf_dir):
    recs = judged_records(spark, sf_dir)
    from evalcube.operators.clean import eval_projection
    work = eval_projection(recs)
    done = recs.filter("id < 500").select("id", F.col("eval_result").alias("eval_response"))
    pend = I.pending_rows(I.resume_merge(work, done))
    ids = {r.id for r in pend.select("id").collect()}
    rows = recs.select("id", "label_task", "eval_result").collect()
    want = {r.id for r in rows if r.label_task and not (r.id < 500 and r.eval_result)}
    assert ids == want
