"""Templates as data, score rules, answers written back, results documents and provider ids on small edge tables."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalcube.operators.answers import AnswerLog, fill_missing
from evalcube.operators.rules import apply_rules, rule_table
from evalcube.operators.templates import compile_templates, criteria_rows, read_templates, render
from evalcube.sources.registry import with_provider_id
from evalcube.sources.results_document import read_documents, read_results, results_documents, write_documents, write_flat

CRIT = "template STRING, position INT, name STRING, description STRING, max_score DOUBLE, weight DOUBLE"


def _store(spark, tmp_path, *files):
    for i, text in enumerate(files):
        (tmp_path / f"{i}.yaml").write_text(text, encoding="utf-8", newline="")
    return read_templates(spark, str(tmp_path))


def _render(spark, store, rows, criteria=(), **values):
    dim = criteria_rows(spark.createDataFrame(list(criteria), CRIT), ["a", "b"])
    recs = spark.createDataFrame(rows, "id INT, template STRING, prompt STRING, ref STRING")
    out = render(recs, compile_templates(store, dim), {"prompt": F.col("prompt"), "ref": F.col("ref")})
    return {r["id"]: (r["route_status"], r["eval_prompt"]) for r in out.collect()}


def test_template_files(spark, tmp_path):
    store = _store(spark, tmp_path, "# note\na: |\r\n  one\r\n\r\n    two: |\r\n\r\nb: |-\n   x\n# end\n", "a: |\n\n  newer\n\nempty: |\n")
    assert {r["template"]: r["body"] for r in store.collect()} == {"a": "\nnewer", "b": "x", "empty": ""}


def test_render_statuses_conditions_and_loops(spark, tmp_path):
    store = _store(spark, tmp_path, "a: |\n  {% if ref %}R={{ref}};{% endif %}{% for x in criteria_list %}{{loop.index}}{{x.name}}"
                                    "{{x.max_score}}/{{x.weight}}{{x.description}}{{x.other}},{% endfor %}{{prompt}}{{none}}\n")
    rows = [(1, "a", "{{ref}} {% if %}", "r"), (2, "a", None, ""), (3, "a", "p", None), (4, "zz", "p", "r"), (5, None, "p", "r")]
    crit = [("a", 7, "n7", None, 5.0, 0.5), (None, 2, "n2", "d", None, None), ("a", 1, None, "nameless", 1.0, 1.0), ("b", 1, "b", "", 1.0, 1.0)]
    loop = "1n210.0/1.0d,2n75.0/0.5,"
    assert _render(spark, store, rows, crit) == {
        1: ("routed", f"R=r;{loop}{{{{ref}}}} {{% if %}}"), 2: ("routed", loop), 3: ("routed", loop + "p"),
        4: ("no_template", None), 5: ("unrouted", None)}
    assert _render(spark, store, rows[2:3])[3] == ("routed", "p")  # no criteria: the loop writes nothing
    assert _render(spark, store.limit(0), rows[:1])[1] == ("no_template", None)
    assert _render(spark, store, []) == {}


@pytest.mark.parametrize("body", ["{% else %}", "{% for c in other %}{% endfor %}", "{% if x %}", "{% endif %}", "{{ a b }}",
                                  "{% for c in criteria_list %}{% for d in criteria_list %}{% endfor %}{% endfor %}"])
def test_unsupported_template_ends_the_query(spark, tmp_path, body):
    store = _store(spark, tmp_path, f"a: |\n  text {body} text\n")
    with pytest.raises(Exception, match="template a: not supported"):
        _render(spark, store, [(1, "a", "p", "r")])


RULE = "template STRING, rule STRING, criterion STRING, weight DOUBLE, max_score DOUBLE"
SCORE = "id INT, answerer_llm_alias STRING, template STRING, criterion STRING, score DOUBLE"


def test_rules(spark):
    rules = rule_table(spark.createDataFrame(
        [(t, t, c, w, m) for t in ("weighted", "mean", "sum", "points") for c, w, m in (("x", 3.0, 10.0), ("y", 1.0, 2.0))], RULE))
    rows = [(1, "m", t, c, s) for t in ("weighted", "mean", "sum", "points") for c, s in (("x", 5.0), ("y", 4.0))]
    rows += [(2, "m", "mean", "x", -1.0), (2, "m", "mean", "y", 1.0), (2, "m", "mean", "other", 9.0),  # filled in, unknown
             (3, "m", "sum", "x", None), (3, "m", "sum", "y", float("nan")),  # nothing counts: no row
             (4, None, "sum", "x", 2.0), (4, None, "sum", "x", 3.0), (5, "m", "none", "x", 1.0)]  # twice; no rule
    got = {(r["id"], r["rule"]): (r["n_criteria"], r["n_missing"], r["total"], r["share"])
           for r in apply_rules(spark.createDataFrame(rows, SCORE), rules).collect()}
    assert got == {(1, "weighted"): (2, 0, 0.875, 0.875), (1, "mean"): (2, 0, 1.25, 1.25), (1, "sum"): (2, 0, 9.0, 0.75),
                   (1, "points"): (2, 0, 7.0, round(7 / 12, 9)), (2, "mean"): (1, 1, 0.5, 0.5), (4, "sum"): (1, 1, 3.0, 0.3)}
    assert apply_rules(spark.createDataFrame([], SCORE), rules).count() == 0


@pytest.mark.parametrize("rule,top", [("median", 10.0), ("mean", 0.0), (None, 1.0)])
def test_unknown_rule_ends_the_query(spark, rule, top):
    with pytest.raises(Exception, match="no such rule or no maximum"):
        rule_table(spark.createDataFrame([("t", rule, "x", 1.0, top)], RULE)).collect()


def test_answers_are_written_once(spark, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "answers"))
    prompts = spark.createDataFrame([(1, "p1"), (1, "p0"), (2, "p2"), (3, ""), (4, None), (5, "bad")], "lr_answer_bronze_id LONG, prompt STRING")
    log.append(spark.createDataFrame([(2, "a", "old"), (2, "b", "")], "lr_answer_bronze_id LONG, answerer_llm_alias STRING, content STRING"), 0)

    def gen(pdf: pd.DataFrame) -> pd.Series:
        if (pdf["prompt"] == "bad").any():
            raise ValueError("refused")
        return pdf["answerer_llm_alias"] + pdf["prompt"]

    want = {(1, "a"): "ap0", (1, "b"): "bp0", (2, "a"): "old", (2, "b"): "bp2", (5, "a"): "", (5, "b"): ""}
    for run in (1, 2):
        latest = fill_missing(log, prompts, ["a", "b"], gen, run).collect()
        assert {(r["lr_answer_bronze_id"], r["answerer_llm_alias"]): r["content"] for r in latest} == want
    rows = log.versions().collect()
    assert len([r for r in rows if r["run"] == 2]) == 2  # only the refused pairs are asked anew
    assert {r["error"] for r in rows if r["lr_answer_bronze_id"] == 5} == {"ValueError: refused"}


def test_latest_answer_prefers_text(spark, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "answers"))
    assert log.latest().count() == 0
    ddl = "lr_answer_bronze_id LONG, answerer_llm_alias STRING, content STRING"
    for run, text in ((0, "first"), (1, ""), (2, None), (1, "second"), (1, "second")):
        log.append(spark.createDataFrame([(1, "a", text)], ddl), run)
    assert [tuple(r) for r in log.latest().collect()] == [(1, "a", "second", 1, 5)]


def test_results_documents(spark, tmp_path):
    scores = spark.createDataFrame([("m", "t", "x", 1.0), ("m", "t", "x", 3.0), ("m", "t", "y, \"q\"", 4.0), ("n", "t", "x", -1.0)],
                                   "answerer_llm_alias STRING, template STRING, criterion STRING, score DOUBLE")
    weights = spark.createDataFrame([("t", "x", 3.0)], "template STRING, criterion STRING, weight DOUBLE")
    spans = spark.sql("SELECT 'm' AS answerer_llm_alias, TIMESTAMP'2024-01-01 00:00:00' AS started, TIMESTAMP'2024-01-02 01:02:03' AS ended")
    folder = str(tmp_path / "results")
    write_documents(results_documents(scores, weights, spans), folder + "/run1")
    docs = {r["model_name"]: r for r in read_documents(spark, folder).collect()}
    assert (docs["m"]["weighted_average"], docs["m"]["n_results"], docs["m"]["duration"]) == (2.5, 3, "1 day, 1:02:03")
    assert docs["n"]["duration"] is None and docs["n"]["weighted_average"] == -1.0
    write_flat(read_documents(spark, folder), folder + "/sub/run2")
    rows = sorted((os.path.splitext(r["file"])[1], r["model_name"], r["criterion"], r["average_score"], r["weight"])
                  for r in read_results(spark, folder).collect())
    one = [("m", "x", 2.0, 3.0), ("m", 'y, "q"', 4.0, 1.0), ("n", "x", -1.0, 3.0)]
    assert rows == [(kind, *r) for kind in (".csv", ".json") for r in one]
    (tmp_path / "results" / "cut.json").write_text('{"model_name": "m", "crit')
    with pytest.raises(Exception):
        read_results(spark, folder).collect()


def test_provider_ids(spark):
    reg = spark.createDataFrame([("k1", "id1", "a"), ("k2", "id2", "a"), ("k3", None, "b"), ("k4", "id4", None)], "key STRING, id STRING, alias STRING")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "answerer_llm_alias STRING")
    got = {r["answerer_llm_alias"]: (r["answerer_llm_id"], r["id_status"]) for r in with_provider_id(df, reg).collect()}
    assert got == {"a": ("id2", "ok"), "b": (None, "unknown_model"), "c": (None, "unknown_model"), None: (None, "unknown_model")}
