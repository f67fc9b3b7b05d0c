"""Streaming queries (#98-#100)."""

from __future__ import annotations

from ..sources import fixtures as FX
from ..streaming import stream as ST
from .oracle_fixtures import with_fixtures
from .q_scoring import RULE_CTE, SCORED_RULE_COLS, _flat, _gb
from .registry import query


@query("stream_score", with_fixtures(RULE_CTE) + f"SELECT {SCORED_RULE_COLS} FROM scored_rule")
def q_stream_score(spark, sf_dir):
    """#98: tickets arriving as files, scored by a streaming query (same rows as #42)."""
    t = FX.tickets(spark, sf_dir)
    return _flat(ST.stream_roundtrip(spark, t, lambda s: ST.score_stream(s), "stream-score"))


@query("stream_greeting_filter", with_fixtures(RULE_CTE) + f"SELECT {SCORED_RULE_COLS} FROM scored_rule "
       f"WHERE ticket_id IN (SELECT ticket_id FROM tickets WHERE NOT {_gb})")
def q_stream_greeting_filter(spark, sf_dir):
    """#100: greetings dropped from the stream before scoring."""
    t = FX.tickets(spark, sf_dir)
    return _flat(ST.stream_roundtrip(spark, t, lambda s: ST.score_stream(ST.drop_greetings(s)), "stream-greet"))


@query("stream_fanout", with_fixtures(RULE_CTE) + f""", kept AS (SELECT * FROM scored_rule
  WHERE ticket_id IN (SELECT ticket_id FROM tickets WHERE NOT {_gb}))
 SELECT 'tickets' AS sink, 'Chatbot' AS channel, count(*) AS rows FROM kept
 UNION ALL SELECT 'triage', NULL, count(*) FROM kept WHERE risk_level = 'High' HAVING count(*) > 0
 UNION ALL SELECT 'chat', NULL, 2 * count(*) FROM kept""")
def q_stream_fanout(spark, sf_dir):
    """#99: per micro-batch, ticket, triage and chat rows to three sinks."""
    return ST.stream_fanout(spark, FX.tickets(spark, sf_dir))


@query("stream_assigned_ids", with_fixtures(RULE_CTE) + f""", kept AS (SELECT * FROM scored_rule
  WHERE ticket_id IN (SELECT ticket_id FROM tickets WHERE NOT {_gb})),
 n AS (SELECT count(*) AS n, count(*) FILTER (WHERE risk_level = 'High') AS h FROM kept),
 none AS (SELECT CAST(NULL AS BIGINT) AS x)
 SELECT 'tickets' AS sink, n AS rows, n AS tickets, CASE WHEN n > 0 THEN CAST(1 AS BIGINT) END AS first_id,
  CASE WHEN n > 0 THEN n END AS last_id, CAST(0 AS BIGINT) AS unknown FROM n
 UNION ALL SELECT 'triage', h, h, x, x, 0 FROM n, none
 UNION ALL SELECT 'chat', 2 * n, n, x, x, 0 FROM n, none""")
def q_stream_assigned_ids(spark, sf_dir):
    """#5 inside #99: dense ids given to arriving tickets, batch by batch."""
    return ST.stream_assigned_ids(spark, FX.tickets(spark, sf_dir))
