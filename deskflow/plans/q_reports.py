"""Reporting queries (#62-#75) over the ticket and triage views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as RP
from ..sources import fixtures as FX
from . import sqlgen as G
from .oracle_fixtures import with_fixtures
from .registry import query


def _dist_sql(col: str) -> str:
    return with_fixtures() + f"SELECT {col}, count(*) AS count FROM tickets GROUP BY {col}"


def _reg_dist(name: str, col: str):
    @query(f"dist_{name}", _dist_sql(col))
    def q(spark, sf_dir):
        return RP.distribution(FX.tickets(spark, sf_dir), col)
    q.__doc__ = f"#62: ticket count per {col}."
    return q


for _name, _col in RP.DIMENSIONS.items():
    _reg_dist(_name, _col)


@query("distributions", with_fixtures() + " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM tickets GROUP BY {c}"
    for n, c in RP.DIMENSIONS.items()))
def q_distributions(spark, sf_dir):
    """#62: all five distributions from one grouped pass."""
    return RP.distributions(FX.tickets(spark, sf_dir))


@query("avg_confidence", with_fixtures()
       + f"SELECT {G.py_round('coalesce(avg(confidence_score), 0.0)')} AS avg_confidence FROM tickets")
def q_avg_confidence(spark, sf_dir):
    """#63: mean confidence, 4 decimals."""
    return RP.avg_confidence(FX.tickets(spark, sf_dir))


@query("triage_stats", with_fixtures() + """, s AS (SELECT
  (SELECT count(*) FROM triage WHERE status = 'Pending') AS pending_triage,
  (SELECT count(*) FROM triage WHERE status = 'Resolved') AS resolved_triage,
  (SELECT count(*) FROM tickets) AS total_tickets)
 SELECT pending_triage, resolved_triage, total_tickets, """
       + G.py_round("CASE WHEN total_tickets > 0 THEN (pending_triage + resolved_triage) / total_tickets * 100.0 "
                    "ELSE 0.0 END", 2) + " AS misrouting_rate FROM s")
def q_triage_stats(spark, sf_dir):
    """#64: pending, resolved, misrouting rate (escalated rows not counted)."""
    t = FX.tickets(spark, sf_dir)
    return RP.triage_stats(t, FX.triage(spark, sf_dir, t))


@query("recent_tickets", with_fixtures() + "SELECT * FROM tickets ORDER BY created_at DESC, ticket_id DESC LIMIT 10")
def q_recent_tickets(spark, sf_dir):
    """#65: ten newest tickets."""
    return RP.recent_tickets(FX.tickets(spark, sf_dir))


def _entries_sql(column: str) -> str:
    return (f"(SELECT string_agg(v || '=' || n, ';' ORDER BY v) FROM (SELECT coalesce({column}, 'null') AS v, count(*) AS n "
            f"FROM tickets GROUP BY 1))")


_RECENT = ["ticket_id", "description", "customer_name", "channel", "region", "status", "predicted_category",
           "predicted_priority", "risk_level", "resolution_notes"]
_RECENT_SQL = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in _RECENT)


@query("analytics_summary", with_fixtures() + ", ".join(["SELECT (SELECT count(*) FROM tickets) AS total_tickets",
       *[f"{_entries_sql(c)} AS {d}_distribution" for d, c in RP.DIMENSIONS.items()]]) + f""",
  (SELECT {G.py_round('avg(confidence_score)', 4)} FROM tickets) AS avg_confidence,
  (SELECT count(*) FROM triage WHERE status = 'Pending') AS pending_triage,
  (SELECT count(*) FROM triage WHERE status = 'Resolved') AS resolved_triage,
  (SELECT string_agg({_RECENT_SQL}, chr(10) ORDER BY created_at DESC, ticket_id DESC) FROM
    (SELECT * FROM tickets ORDER BY created_at DESC, ticket_id DESC LIMIT 10)) AS recent_tickets""")
def q_analytics_summary(spark, sf_dir):
    """#66: one report row: the distributions as sorted entries, the ten newest tickets as whole rows."""
    t = FX.tickets(spark, sf_dir)
    r = RP.analytics_summary(t, FX.triage(spark, sf_dir, t))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ";")
    row = lambda e: F.array_join(F.array(*[e[c].cast("string") for c in _RECENT]), "|", "null")
    return r.select("total_tickets", *[text(F.col(f"{d}_distribution")).alias(f"{d}_distribution") for d in RP.DIMENSIONS],
                    "avg_confidence", "pending_triage", "resolved_triage",
                    F.array_join(F.transform("recent_tickets", row), "\n").alias("recent_tickets"))


@query("kpi_cards", with_fixtures() + """SELECT count(*) AS total_tickets,
  count(*) FILTER (WHERE status = 'Open') AS open_tickets,
  count(*) FILTER (WHERE coalesce(is_triage, 0) <> 0) AS triage_tickets,
  count(*) FILTER (WHERE risk_level = 'High') AS high_risk_tickets,
  CAST(CASE WHEN count(*) > 0 THEN floor(sum(coalesce(confidence_score, 0.0)) / count(*) * 100 + 0.5) ELSE 0 END
   AS BIGINT) AS avg_confidence_pct,
  CAST(CASE WHEN count(*) FILTER (WHERE status = 'Resolved' AND resolved_at IS NOT NULL) > 0 THEN
   floor(sum(date_diff('millisecond', created_at, resolved_at)) FILTER (WHERE status = 'Resolved'
    AND resolved_at IS NOT NULL) / count(*) FILTER (WHERE status = 'Resolved' AND resolved_at IS NOT NULL)
    / 3600000.0 + 0.5) ELSE 0 END AS BIGINT) AS avg_resolution_hours
 FROM tickets""")
def q_kpi_cards(spark, sf_dir):
    """#67: KPI cards over the whole ticket table."""
    return RP.kpi_cards(FX.tickets(spark, sf_dir))


# Tickets in which some labels are empty strings, as a form may store them.
BLANKED = """blanked AS (SELECT * REPLACE (CASE WHEN ticket_id % 19 = 0 THEN '' ELSE predicted_category END AS predicted_category,
  CASE WHEN ticket_id % 23 = 0 THEN '' ELSE status END AS status,
  CASE WHEN ticket_id % 29 = 0 THEN '' ELSE risk_level END AS risk_level) FROM tickets)"""


def _blanked(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    for column, k in (("predicted_category", 19), ("status", 23), ("risk_level", 29)):
        t = t.withColumn(column, F.when(F.col("ticket_id") % k == 0, F.lit("")).otherwise(F.col(column)))
    return t


@query("top_departments", with_fixtures(BLANKED) + """SELECT department, count FROM (
  SELECT coalesce(nullif(predicted_category, ''), 'Unknown') AS department, count(*) AS count,
   max(created_at) AS seen, arg_max(ticket_id, created_at) AS seen_id
  FROM blanked GROUP BY 1) ORDER BY count DESC, seen DESC, seen_id DESC LIMIT 6""")
def q_top_departments(spark, sf_dir):
    """#68: six largest departments."""
    return RP.top_departments(_blanked(spark, sf_dir))


@query("status_share", with_fixtures(BLANKED) + """SELECT status, count,
  CAST(floor(count * 100.0 / sum(count) OVER () + 0.5) AS BIGINT) AS pct FROM (
  SELECT coalesce(nullif(status, ''), 'Unknown') AS status, count(*) AS count FROM blanked GROUP BY 1)""")
def q_status_share(spark, sf_dir):
    """#69: status counts with rounded percent share."""
    return RP.status_share(_blanked(spark, sf_dir))


@query("risk_zero_filled", with_fixtures(BLANKED) + """SELECT l.risk_level, coalesce(c.count, 0) AS count, l.ord
 FROM (VALUES ('High', 0), ('Medium', 1), ('Low', 2)) l(risk_level, ord)
 LEFT JOIN (SELECT coalesce(nullif(risk_level, ''), 'Low') AS risk_level, count(*) AS count FROM blanked GROUP BY 1) c
 USING (risk_level)""")
def q_risk_zero_filled(spark, sf_dir):
    """#70: High/Medium/Low always present."""
    return RP.risk_zero_filled(_blanked(spark, sf_dir))


@query("confidence_band", with_fixtures() + """SELECT ticket_id, pct, CASE WHEN pct >= 70 THEN 'success'
  WHEN pct >= 45 THEN 'warning' ELSE 'danger' END AS band FROM (
  SELECT ticket_id, CAST(floor(coalesce(confidence_score, 0.0) * 100 + 0.5) AS BIGINT) AS pct FROM tickets)""")
def q_confidence_band(spark, sf_dir):
    """#71: rounded confidence percent and colour band per ticket."""
    pct, band = RP.confidence_band(F.col("confidence_score"))
    return FX.tickets(spark, sf_dir).select("ticket_id", pct.alias("pct"), band.alias("band"))


@query("distinct_departments", with_fixtures(BLANKED)
       + "SELECT DISTINCT predicted_category FROM blanked WHERE predicted_category IS NOT NULL AND predicted_category <> ''")
def q_distinct_departments(spark, sf_dir):
    """#72: distinct non-null departments."""
    return RP.distinct_departments(_blanked(spark, sf_dir))


@query("ticket_timeline", with_fixtures() + """SELECT ticket_id, 1 AS step, 'Ticket Created' AS event, created_at AS at
  FROM tickets
 UNION ALL SELECT ticket_id, 2, 'Last Updated', updated_at FROM tickets
  WHERE updated_at IS NOT NULL AND updated_at <> created_at
 UNION ALL SELECT ticket_id, 3, 'Resolved', resolved_at FROM tickets WHERE resolved_at IS NOT NULL""")
def q_ticket_timeline(spark, sf_dir):
    """#73: timeline events per ticket."""
    return RP.ticket_timeline(FX.tickets(spark, sf_dir))


def _display_input(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.withColumn("resolution", F.when(F.col("ticket_id") % 13 == 0, F.lit("closed")))


@query("ticket_display", with_fixtures() + """, d AS (SELECT *, CASE WHEN ticket_id % 13 = 0 THEN 'closed' END
  AS resolution FROM tickets)
 SELECT ticket_id,
  'TN-' || CASE WHEN length(CAST(ticket_id AS VARCHAR)) < 4 THEN lpad(CAST(ticket_id AS VARCHAR), 4, '0')
   ELSE CAST(ticket_id AS VARCHAR) END AS code,
  CASE WHEN description IS NULL OR description = '' THEN '-' WHEN length(description) > 50
   THEN substr(description, 1, 50) || '...' ELSE description END AS description_short,
  CASE WHEN coalesce(is_triage, 0) <> 0 THEN 'Yes' ELSE 'No' END AS human_triage,
  coalesce(nullif(resolution, ''), nullif(resolution_notes, ''), '-') AS resolution_shown,
  CASE WHEN created_at IS NULL THEN '-' ELSE strftime(created_at, '%d %b %Y, %I:%M ')
   || lower(strftime(created_at, '%p')) END AS created_shown
 FROM d""")
def q_ticket_display(spark, sf_dir):
    """#74: ticket table display row."""
    return RP.ticket_display(_display_input(spark, sf_dir))


@query("gauge_values", with_fixtures() + """, g AS (SELECT ticket_id, status, confidence_score,
  CASE WHEN ticket_id % 17 = 0 THEN NULL ELSE 1 - confidence_score END AS risk_score FROM tickets)
 SELECT ticket_id,
  CAST(floor(least(100.0, greatest(0.0, coalesce(confidence_score, 0.0) * 100)) + 0.5) AS BIGINT) AS confidence_gauge,
  CAST(floor(least(100.0, greatest(0.0, CASE WHEN risk_score IS NULL OR risk_score = 0 THEN 50.0
   ELSE risk_score * 100 END)) + 0.5) AS BIGINT) AS risk_gauge,
  CASE WHEN status = 'Resolved' THEN 100 ELSE 45 END AS progress FROM g""")
def q_gauge_values(spark, sf_dir):
    """#75: gauge and progress values per ticket."""
    t = FX.tickets(spark, sf_dir).withColumn(
        "risk_score", F.when(F.col("ticket_id") % 17 == 0, F.lit(None).cast("double"))
        .otherwise(1 - F.col("confidence_score")))
    return RP.gauge_values(t)
