"""Edge table of judge replies (FIXTURES.md §4): parse status and score."""

import pytest
from pyspark.sql import functions as F

from evalcube.functions.judge_parse import parse_total, parse_total_embedded

S = "총점"
CASES = [
    ('{"%s": 0.85, "c":"x"}' % S, "ok", 0.85),
    ('```json\n{"%s": 0.85}\n```' % S, "ok", 0.85),
    ('```JSON{"%s": 1}```' % S, "ok", 1.0),
    ('{"%s": "0.7"}' % S, "ok", 0.7),
    ('{"%s": 1}' % S, "ok", 1.0),
    ('{"%s":0.1,"%s":0.2}' % (S, S), "ok", 0.2),
    ('{"%s":0.4,"c":"\\Delta x"}' % S, "ok", 0.4),
    ('{"%s":0.4,"c":"\\\\alpha"}' % S, "ok", 0.4),
    ('{"%s": null}' % S, "no_score", None),
    ('{"x": 1}', "no_score", None),
    ('{"%s": NaN}' % S, "no_score", None),
    ('{"%s": true}' % S, "no_score", None),
    ('{"%s": {"a":1}}' % S, "no_score", None),
    ('{"%s": 0.5} trailing' % S, "bad", None),
    ('{"%s":1},{"%s":2}' % (S, S), "bad", None),
    ('{"%s":1}]' % S, "bad", None),
    ('{"%s":1}]}' % S, "bad", None),
    ('{"%s":1}]} {"a":[{"%s":2}' % (S, S), "bad", None),
    ('{"end":5,"%s":0.2}' % S, "ok", 0.2),
    ('{"%s": "NaN"}' % S, "no_score", None),
    ("{'%s': 0.5}" % S, "bad", None),
    ('{"%s": 0.5' % S, "bad", None),
    ('{"%s":0.4,}' % S, "bad", None),
    ('{%s:0.4}' % S, "bad", None),
    ('{"%s": 00.4}' % S, "bad", None),
    ('{"%s":0.4,"c":"\\underline"}' % S, "bad", None),
    ('{"%s":0.4,"c":"a\nb"}' % S, "bad", None),
    ("", "bad", None),
    ("null", "bad", None),
    ("0.8", "bad", None),
    ('[{"%s":1}]' % S, "bad", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i INT, t STRING")
    rows = df.select("i", parse_total(F.col("t")).alias("p")).collect()
    return {r.i: r.p for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_edge(parsed, i):
    _, status, score = CASES[i]
    p = parsed[i]
    assert p.status == status, CASES[i][0]
    if score is None:
        assert p.score is None
    else:
        assert p.score == pytest.approx(score)


def test_null_text_gives_null(spark):
    df = spark.createDataFrame([(None,)], "t STRING")
    assert df.select(parse_total(F.col("t")).alias("p")).first().p is None


def test_embedded_block(spark):
    text = 'Here it is:\n```json\n{"%s": 0.3}\n```\nThanks.' % S
    df = spark.createDataFrame([(text,)], "t STRING")
    p = df.select(parse_total(F.col("t")).alias("a"), parse_total_embedded(F.col("t")).alias("b")).first()
    assert p.a.status == "bad"
    assert p.b.status == "ok" and p.b.score == pytest.approx(0.3)
