"""DuckDB CTEs that recompute the judged-record fixture from ``events`` by formula.

The oracle never parses the JSON our engine parses: statuses, quality and
token counts come straight from the formulas that generated the text.
"""

from __future__ import annotations

from ..sources.fixtures import MODEL_ALIASES, MODEL_PRICES

_ALIASES = ", ".join(f"'{a}'" for a in MODEL_ALIASES)
_PRICES = ", ".join(f"('{a}', CAST({pin!r} AS DOUBLE), CAST({pout!r} AS DOUBLE))"
                    for a, pin, pout in MODEL_PRICES)

# rec: every fixture record with its intended judge status.
REC_CTES = f"""
ev AS (
  SELECT event_id AS e, event_id // 5 AS g, CAST(event_id % 5 AS INTEGER) AS m, value
  FROM events
),
rec AS (
  SELECT e, g, m,
    CASE WHEN e % 211 = 0 THEN 'm-unlisted' ELSE ([{_ALIASES}])[m + 1] END AS alias,
    CASE WHEN g % 103 = 0 THEN NULL
         WHEN g % 3 = 0 THEN [concat('T', 1 + g % 12), concat('T', 1 + (g + 5) % 12)]
         ELSE [concat('T', 1 + g % 12)] END AS label_task,
    CASE WHEN g % 4 = 0 THEN [concat('D', 1 + (g // 12) % 10), concat('D', 1 + (g // 12 + 3) % 10)]
         ELSE [concat('D', 1 + (g // 12) % 10)] END AS label_domain,
    [concat('L', 1 + (g // 7) % 3)] AS label_level,
    CAST(floor(value) AS BIGINT) % 51 + 10 * m AS q100,
    CASE WHEN e % 113 = 0 THEN NULL ELSE 50 + (37 * g) % 400 END AS ptok,
    CASE WHEN e % 113 = 0 THEN NULL ELSE 20 + (13 * e) % 700 END AS ctok,
    CASE WHEN e % 101 = 0 THEN 'null' WHEN e % 97 = 0 THEN 'bad'
         WHEN e % 89 = 0 OR e % 83 = 0 THEN 'no_score' ELSE 'ok' END AS jstatus,
    e % 11 = 0 AND e % 101 <> 0 AND e % 97 <> 0 AND e % 89 <> 0 AND e % 83 <> 0 AS repaired
  FROM ev
),
prices(alias, pin, pout) AS (VALUES {_PRICES}),
cleaned AS (SELECT * FROM rec WHERE label_task IS NOT NULL AND jstatus <> 'null')"""

SCORED_CTES = REC_CTES + """,
scored AS (
  SELECT c.e AS id, c.g AS lr_answer_bronze_id, c.alias AS answerer_llm_alias,
         c.label_task, c.label_domain, c.label_level,
         CAST(c.q100 AS DOUBLE) / 100.0 AS quality,
         coalesce(c.ptok * p.pin + c.ctok * p.pout, 0.0) AS cost,
         c.ptok AS prompt_tokens, c.ctok AS completion_tokens
  FROM cleaned c LEFT JOIN prices p ON c.alias = p.alias
  WHERE c.jstatus = 'ok' AND c.g NOT IN (SELECT g FROM cleaned WHERE jstatus = 'bad')
)"""


def with_scored(body: str) -> str:
    return "WITH " + SCORED_CTES + "\n" + body


def with_rec(body: str) -> str:
    return "WITH " + REC_CTES + "\n" + body

# txt: the exact judge text, response JSON and messages of every record.
TEXT_CTES = REC_CTES + """,
txt AS (
  SELECT r.*,
    '{"총점": ' || printf('%.2f', CAST(q100 AS DOUBLE) / 100.0) || ', "평가의견": "'
      || CASE WHEN e % 11 = 0 THEN '\\Delta rises' ELSE 'fine' END || '"}' AS body,
    CASE WHEN e % 113 = 0 THEN '{"choices":[]}'
         ELSE '{"id":"c' || e || '","choices":[{"index":0,"message":{"role":"assistant","content":"r'
              || e || '"}}],"usage":{"prompt_tokens":' || ptok || ',"completion_tokens":' || ctok || '}}'
    END AS response,
    '[{"role":"system","content":"Answer briefly."},{"role":"user","content":"q' || g || '"}]' AS messages
  FROM rec r
),
txt2 AS (
  SELECT *,
    CASE WHEN e % 101 = 0 THEN NULL
         WHEN e % 97 = 0 THEN '{"총점": ' || printf('%.2f', CAST(q100 AS DOUBLE) / 100.0) || ', "평가의견": "cut'
         WHEN e % 89 = 0 THEN '{"평가의견": "no total"}'
         WHEN e % 83 = 0 THEN '{"총점": null, "평가의견": "empty total"}'
         WHEN e % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
         ELSE body END AS eval_result,
    CASE WHEN e % 101 = 0 THEN NULL
         WHEN e % 97 = 0 THEN '{"총점": ' || printf('%.2f', CAST(q100 AS DOUBLE) / 100.0) || ', "평가의견": "cut'
         WHEN e % 89 = 0 THEN '{"평가의견": "no total"}'
         WHEN e % 83 = 0 THEN '{"총점": null, "평가의견": "empty total"}'
         ELSE body END AS unfenced
  FROM txt
)"""


def with_text(body: str) -> str:
    return "WITH " + TEXT_CTES + "\n" + body
