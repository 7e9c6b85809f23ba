"""Python literals against ast, JSON readers that lose nothing, the commit log under replays and lost checkpoints."""

import ast
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from evalcube.functions.joins import broadcast_if_small, known_size, local_table
from evalcube.functions.literals import from_literal, literal_to_json
from evalcube.operators import clean as C
from evalcube.plans.dashboard import cleaned_records, scored_from
from evalcube.session import scratch_path
from evalcube.sources import readers as RD
from evalcube.sources.fixtures import judged_records
from evalcube.streaming import incremental as I
from evalcube.streaming.commit_log import CommitLog


def _value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind == 0:
        return rng.choice([None, True, False, 0, -3, 2.5])
    if kind <= 3:
        pool = ["'", '"', "\\", "\n", "\t", "é", "﷐", "﷐1", "None", "True]", "{", "a", ",", "(", "\x07", "\x00", "/", "\\x41", "한"]
        return "".join(rng.choice(pool) for _ in range(rng.randrange(6)))
    if kind == 4:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return tuple(_value(rng, depth - 1) for _ in range(rng.randrange(3)))
    return {f"k'{i}": _value(rng, depth - 1) for i in range(rng.randrange(3))}


def _lists(v):
    if isinstance(v, (list, tuple)):
        return [_lists(x) for x in v]
    return {k: _lists(x) for k, x in v.items()} if isinstance(v, dict) else v


def test_literals_equal_ast(spark):
    rng = random.Random(12)
    values = [_value(rng, 4) for _ in range(600)]
    texts = [repr(v) for v in values] + [json.dumps(_lists(v)) for v in values]
    texts += [r"['a\x41é\v\q', u'x', ('t',), [1,],]", "'line\\\n on'"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", literal_to_json(F.col("t")).alias("j")).collect()
    got = {r.i: json.loads(r.j, strict=False) for r in rows}
    for i, t in enumerate(texts):
        want = _lists(values[i % len(values)] if i < 2 * len(values) else ast.literal_eval(t))
        assert got[i] == want, t


def test_unreadable_literals_are_null(spark):
    texts = ["", "not a list", "['open", "[1, 2", None, "['T1', 'T5']", "[None, 'D2']", '["it\'s"]']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(from_literal(F.col("t"), "ARRAY<STRING>").alias("v")).collect()
    assert [r.v for r in rows] == [None, None, None, None, None, ["T1", "T5"], [None, "D2"], ["it's"]]


def test_a_long_literal_takes_linear_time(spark):
    def seconds(n):
        text = "[" + ", ".join("{'role': 'it\\'s', \"content\": None}" for _ in range(n)) + "]"
        df = spark.createDataFrame([(text,)], "t string").select(F.size(from_literal(F.col("t"), "ARRAY<STRUCT<role: STRING>>")).alias("n"))
        t0 = time.time()
        assert df.first().n == n
        return time.time() - t0
    seconds(100)
    seconds(2_000)
    assert seconds(60_000) < 20  # 2 MB


def test_request_of_a_python_literal(spark):
    text = "[{'role': 'system', 'name': None, 'content': 'a'}, {'role': 'user', 'name': None, 'content': \"it's\"}]"
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(C.request_text(F.col("m")).alias("r")).first().r == "it's"


def test_json_logs_lose_nothing(spark, tmp_path):
    rec = {"id": 1, "answerer_llm_alias": "m", "label_task": ["T1"], "model_name": None}
    path = str(tmp_path / "doc.json")
    open(path, "w").write(json.dumps([rec, rec | {"id": 2, "label_task": "['T2', 'T3']"}], indent=2))
    assert sorted((r.id, tuple(r.label_task)) for r in RD.read_response_log(spark, path).collect()) == [(1, ("T1",)), (2, ("T2", "T3"))]
    one = str(tmp_path / "one.json")
    open(one, "w").write(json.dumps(rec, indent=2))
    assert RD.read_response_log(spark, one).count() == 1
    lines = str(tmp_path / "lines.json")
    open(lines, "w").write("\n" + json.dumps(rec) + "\n" + json.dumps(rec)[:20] + "\n")
    kept = RD.read_response_log(spark, lines, bad="keep").select("id", RD.CORRUPT).collect()
    assert len(kept) == 2 and sum(r[RD.CORRUPT] is not None for r in kept) == 1
    with pytest.raises(Exception, match="MALFORMED"):
        RD.read_response_log(spark, lines).collect()




def test_a_lost_checkpoint_loses_and_doubles_nothing(spark, sf_dir):
    recs = judged_records(spark, sf_dir)
    src, sink, first, second = (scratch_path(spark, n) for n in ("c-src", "c-sink", "c-ckpt1", "c-ckpt2"))
    recs.filter("id < 300").write.parquet(src)
    log = I.run_incremental(spark, src, sink, first, recs.schema)
    before = {tuple(r) for r in log.read(I.RESULT_DDL).collect()}
    # an attempt that failed before its commit
    log.read(I.RESULT_DDL).write.parquet(f"{sink}/parts/failed")
    recs.filter("id >= 250 AND id < 600").write.mode("append").parquet(src)  # 50 records arrive again
    I.run_incremental(spark, src, sink, second, recs.schema)
    out = log.read(I.RESULT_DDL).collect()
    want = recs.filter("id < 600 AND size(label_task) > 0").count()
    assert len(out) == len({r.id for r in out}) == want
    assert before <= {tuple(r) for r in out}
    assert log.commits().select("run").distinct().count() == 2
    assert log.vacuum() == 1 and log.read(I.RESULT_DDL).count() == want


def test_a_replayed_batch_is_committed_once(spark):
    log = CommitLog(spark, scratch_path(spark, "c-replay"))
    rows = spark.range(5).select("id", F.lit("x").alias("v"))
    assert log.read(rows.schema).count() == 0 and log.vacuum() == 0
    assert log.write(rows, "r", 0) and not log.write(rows, "r", 0)
    assert log.write(rows.filter("id > 9"), "r", 1)  # an empty part
    twice = spark.createDataFrame([(4, "a"), (7, "b"), (7, "a"), (7, "a"), (None, None)], "id bigint, v string")
    left = [r.id for r in log.unseen(twice).collect()]
    assert sorted(left, key=str) == [7, None]
    assert log.unseen(twice.filter("id > 100")).count() == 0
    assert log.read(rows.schema).count() == 5
    assert log.read(rows.schema, low=5, high=9).count() == 0


def test_scoring_parses_once(spark, sf_dir):
    scored = scored_from(spark, cleaned_records(spark, sf_dir))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "총점" not in plan and plan.count("Relation") >= 2


def test_only_known_sizes_are_broadcast(spark):
    dim = local_table(spark, [("a", 1), ("b", 2)], "k string, v int")
    assert known_size(dim) is not None
    guessed = spark.range(10).groupBy("id").count()
    assert known_size(guessed) is None and broadcast_if_small(guessed) is guessed


def test_resume_prefers_the_reply_given(spark):
    work = spark.createDataFrame([(1, ["T1"]), (2, ["T1"]), (3, ["T1"])], "id bigint, label_task array<string>")
    done = spark.createDataFrame([(1, "a", "reply"), (1, "b", ""), (1, "c", None), (2, "z", "")], "id bigint, eval_prompt string, eval_response string")
    assert sorted(r.id for r in I.pending_rows(I.resume_merge(work, done)).collect()) == [2, 3]
