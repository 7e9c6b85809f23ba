"""Work of a task is bounded by rows, and a text is read once however often its parts are used."""

import json

from pyspark.sql import functions as F

from evalcube.operators import prompts as PR
from evalcube.operators.scoring import rubric_total_audit
from evalcube.sources import readers as RD
from evalcube.sources.fixtures import criteria_replies, judged_records
from evalcube.sources.tables import spread
from evalcube.streaming import commit_log


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_dealt_out_by_rows_whatever_the_splits(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    for first, n in ((0, 450_000), (450_000, 10), (450_010, 10), (450_020, 10), (450_030, 10)):
        spark.range(first, first + n, 1, 1).select(F.col("id").alias("event_id"), F.lit(3.0).alias("value")).write.mode("append").parquet(path)
    sizes = [r["count"] for r in judged_records(spark, str(tmp_path)).select("id").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 450_040 and max(sizes) < 110_000


def test_spread_keeps_repeated_and_null_keys_apart(spark):
    df = spark.range(1_000).select(F.when(F.col("id") < 500, 1).alias("event_id"))
    sizes = [r["count"] for r in spread(df, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000 and max(sizes) < 150


def test_template_lookup_reads_the_task_once(spark):
    df = spark.createDataFrame([("t2",), ("t99",), (None,)], "task string").select(PR.template_of(F.upper("task")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["summary", None, None]
    assert _optimized(df).count("upper(") == 1
    got = spark.createDataFrame([("knowledge",), ("none",), (None,)], "t string").select(F.size(PR.criteria_of(F.col("t"))).alias("n"), PR.criteria_of(F.col("t")).isNull().alias("no"))
    assert [r["no"] for r in got.collect()] == [False, True, True]


def test_audit_reads_the_judge_object_once(spark):
    rows = [(1, "m", "summary", json.dumps({n: 5 for n, _ in PR.RUBRICS["summary"][1][:2]} | {"총점": 0.25})), (2, "m", "summary", "{"), (3, "m", "none", None)]
    df = rubric_total_audit(spark.createDataFrame(rows, "id long, answerer_llm_alias string, template string, judge_object string"))
    assert _optimized(df).count("from_json(") == 1
    one, two, three = df.orderBy("id").collect()
    assert (one.n_criteria, one.recomputed_total, one.claimed_total, one.difference) == (2, 0.5, 0.25, -0.25)
    assert two.recomputed_total is None and three.claimed_total is None and three.rule is None


def test_replies_are_rendered_once(spark):
    src = spark.createDataFrame([(1, "m", 0, ["T1"], 0.5), (2, "m", 0, ["T1"], None)],
                                "id long, answerer_llm_alias string, lr_answer_bronze_id long, label_task array<string>, s double")
    df = criteria_replies(src.select("*", F.struct(F.col("s").alias("score")).alias("judge")).drop("s"))
    assert _optimized(df).count("Scores follow.") == 1
    assert [json.loads(r.judge_object)["총점"] for r in df.orderBy("id").collect()] == [0.5, None]


def test_documents_lists_are_read_in_passing(spark, tmp_path):
    path = str(tmp_path / "log.json")
    recs = [{"id": 1, "label_task": ["T1", "T\"5", None], "answerer_llm_alias": "m"}, {"id": 2, "task": "['T2', 'T3']", "model_name": "k"},
            {"id": 3, "label_task": None, "response": {"a": [1, 2]}}, {"id": 4, "label_task": 7, "label_level": []}, {"id": 5, "label_task": {"a": 1}}]
    spark.range(1).select(F.lit(json.dumps(recs, indent=1)).alias("value")).coalesce(1).write.text(path)
    for bad in ("fail", "keep"):
        df = RD.read_json_records(spark, path, bad=bad)
        assert "variant" in df._jdf.queryExecution().analyzed().toString()
        got = {r.id: r for r in df.collect()}
        assert got[1].label_task == ["T1", 'T"5', None] and got[2].label_task == ["T2", "T3"] and got[2].answerer_llm_alias == "k"
        assert got[3].label_task is None and json.loads(got[3].response) == {"a": [1, 2]}
        assert got[4].label_task is None and got[4].label_level == [] and got[5].label_task is None


def test_a_batch_is_partitioned_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "SPREAD_ROWS", 10)
    rows = spark.range(400).select((F.col("id") % 200).alias("id"), F.lit("x").alias("text"))
    log = commit_log.CommitLog(spark, str(tmp_path / "log"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = log.unseen(rows)
        assert out.rdd.getNumPartitions() == 40 and out.count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
