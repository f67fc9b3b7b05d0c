"""Ticket-table queries (#4-#8, #52-#61)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formatting import py_round
from ..operators import score as S
from ..operators import store as ST
from ..operators import tickets as TK
from ..operators.terms import spread
from ..session import scratch_path
from ..sources import files as FL
from ..sources import fixtures as FX
from ..sources.tables import read_table
from . import sqlgen as G
from .oracle_fixtures import with_fixtures
from .q_scoring import RULE_CTE
from .registry import query

SOURCE_KEYS = ["ticket_id", "description", "customer_name", "channel", "created_at"]

TICKET_ROW_COLS = ["ticket_id", "description", "customer_name", "customer_email", "channel", "predicted_category",
                   "predicted_intent", "predicted_priority", "confidence_score", "intent_confidence",
                   "risk_level", "risk_score", "sentiment_score", "category_probabilities",
                   "intent_probabilities", "status", "assigned_department", "is_triage", "misrouting_risk",
                   "route", "requires_human", "resolution", "assigned_to", "resolution_notes", "created_at",
                   "updated_at", "resolved_at"]


ROWS_SQL = """SELECT s.ticket_id, t.description, t.customer_name, '' AS customer_email, t.channel,
  s.category AS predicted_category, s.intent AS predicted_intent, s.priority AS predicted_priority,
  s.confidence AS confidence_score, s.intent_confidence, s.risk_level, s.risk_score, s.sentiment_score,
  '{"' || s.category || '": ' || CAST(r.conf AS VARCHAR) || '}' AS category_probabilities,
  '{"' || s.intent || '": ' || CAST(r.conf AS VARCHAR) || '}' AS intent_probabilities,
  CASE WHEN s.risk_level = 'High' THEN 'Triage' ELSE 'Open' END AS status, s.category AS assigned_department,
  CASE WHEN s.risk_level = 'High' THEN 1 ELSE 0 END AS is_triage, s.risk_level AS misrouting_risk,
  s.category AS route, CASE WHEN s.risk_level = 'High' THEN 1 ELSE 0 END AS requires_human,
  CAST(NULL AS VARCHAR) AS resolution, CAST(NULL AS VARCHAR) AS assigned_to, CAST(NULL AS VARCHAR) AS resolution_notes,
  t.created_at, t.created_at AS updated_at, CAST(NULL AS TIMESTAMP) AS resolved_at
 FROM scored_rule s JOIN tickets t USING (ticket_id) JOIN rp1 r USING (ticket_id)"""


@query("append_tickets", with_fixtures(RULE_CTE) + ROWS_SQL)
def q_append_tickets(spark, sf_dir):
    """#4: score, build ticket rows, append to a status-partitioned parquet
    table in the shared checkpoint folder and read the table back."""
    scored = S.score_tickets(FX.tickets(spark, sf_dir), keys=SOURCE_KEYS)
    return TK.write_then_read(TK.ticket_rows(scored), "tickets").select(*TICKET_ROW_COLS)


@query("assign_ticket_id", with_fixtures() + """SELECT conv_id, turn,
  (SELECT max(ticket_id) FROM tickets) + row_number() OVER (ORDER BY conv_id, turn) AS ticket_id
 FROM conversations WHERE role = 'user'""")
def q_assign_ticket_id(spark, sf_dir):
    """#5: new tickets from user chat turns get ids after the table's max id."""
    t = FX.tickets(spark, sf_dir)
    new = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn")
    start = t.select(F.max("ticket_id")).scalar()
    return TK.assign_ids(new, ["conv_id", "turn"], start_after=start, id_col="ticket_id")


@query("evolve_schema", with_fixtures() + """SELECT ticket_id, CAST(NULL AS VARCHAR) AS misrouting_risk,
  CAST(NULL AS VARCHAR) AS route, 0 AS requires_human, CAST(NULL AS VARCHAR) AS resolution FROM tickets""")
def q_evolve_schema(spark, sf_dir):
    """#6: the four later columns added to an older ticket table."""
    t = TK.evolve_schema(FX.tickets(spark, sf_dir))
    return t.select("ticket_id", "misrouting_risk", "route", "requires_human", "resolution")


@query("validate_input", with_fixtures() + """, inp AS (
  SELECT 'ticket' AS source, ticket_id AS id, description AS text, customer_name, channel FROM tickets
  UNION ALL SELECT 'document', doc_id, text, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM documents),
 chk AS (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 5 THEN 'too_short'
  WHEN length(text) > 2000 THEN 'too_long' END AS reason FROM inp)
 SELECT source, id, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN coalesce(customer_name, 'Anonymous') ELSE customer_name END AS customer_name,
  CASE WHEN reason IS NULL THEN '' END AS customer_email,
  CASE WHEN reason IS NULL THEN coalesce(channel, 'Chatbot') ELSE channel END AS channel FROM chk""")
def q_validate_input(spark, sf_dir):
    """#7: ticket texts and whole documents checked against 5..2000 characters."""
    t = FX.tickets(spark, sf_dir).select(F.lit("ticket").alias("source"), F.col("ticket_id").alias("id"),
                                        F.col("description").alias("text"), "customer_name", "channel")
    d = read_table(spark, sf_dir, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text",
        F.lit(None).cast("string").alias("customer_name"), F.lit(None).cast("string").alias("channel"))
    accepted, rejected = TK.validate_input(t.unionByName(d), "text")
    cols = ["source", "id", "accepted", "reason", "customer_name", "customer_email", "channel"]
    a = accepted.select("source", "id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
                        "customer_name", "customer_email", "channel")
    r = rejected.select("source", "id", F.lit(False).alias("accepted"), "reason", "customer_name",
                        F.lit(None).cast("string").alias("customer_email"), "channel")
    return a.unionByName(r).select(*cols)


@query("prediction_history", with_fixtures(RULE_CTE) + """SELECT s.ticket_id, t.description AS complaint_text,
  s.category AS predicted_department, s.intent, s.priority, s.confidence AS confidence_score,
  s.sentiment_label AS sentiment, s.risk_level, t.created_at AS prediction_timestamp
 FROM scored_rule s JOIN tickets t USING (ticket_id)""")
def q_prediction_history(spark, sf_dir):
    """#8: documented 9-column history table, newest first."""
    scored = S.score_tickets(FX.tickets(spark, sf_dir), keys=SOURCE_KEYS)
    return TK.prediction_history(scored)


@query("list_tickets", with_fixtures() + """SELECT * FROM tickets WHERE status = 'Open' AND risk_level = 'High'
 ORDER BY created_at DESC, ticket_id DESC LIMIT 100 OFFSET 20""")
def q_list_tickets(spark, sf_dir):
    """#52: one page (offset 20, limit 100) of open high-risk tickets, newest first."""
    return TK.list_tickets(FX.tickets(spark, sf_dir), limit=100, offset=20, status="Open", risk_level="High")


@query("list_tickets_department", with_fixtures() + """SELECT * FROM tickets
 WHERE predicted_category = 'ACCOUNT' AND predicted_priority = 'High'
 ORDER BY created_at DESC, ticket_id DESC LIMIT 50""")
def q_list_tickets_department(spark, sf_dir):
    """#52 with the department (predicted category) and priority filters."""
    return TK.list_tickets(FX.tickets(spark, sf_dir), limit=50, department="ACCOUNT", priority="High")


@query("count_tickets", with_fixtures() + """SELECT count(*) AS total FROM tickets
 WHERE status = 'Open' AND risk_level = 'High'""")
def q_count_tickets(spark, sf_dir):
    """#53: total under the #52 filters."""
    return TK.count_tickets(FX.tickets(spark, sf_dir), status="Open", risk_level="High")


_REQ = "req AS (SELECT DISTINCT ticket_id * 2 + 1 AS ticket_id FROM patches)"


@query("get_ticket", with_fixtures(_REQ) + """SELECT t.ticket_id, t.status, t.description
 FROM tickets t WHERE t.ticket_id IN (SELECT ticket_id FROM req)""")
def q_get_ticket(spark, sf_dir):
    """#54: requested tickets that exist (ids requested: 2k+1 for patched k)."""
    t = FX.tickets(spark, sf_dir)
    ids = FX.patches(spark, sf_dir, t).select((F.col("ticket_id") * 2 + 1).alias("id"))
    found, _ = TK.get_tickets(t, ids)
    return found.select("ticket_id", "status", "description")


@query("get_ticket_missing", with_fixtures(_REQ) + """SELECT ticket_id FROM req
 WHERE ticket_id NOT IN (SELECT ticket_id FROM tickets)""")
def q_get_ticket_missing(spark, sf_dir):
    """#54: requested ids with no ticket (reported as not found)."""
    t = FX.tickets(spark, sf_dir)
    ids = FX.patches(spark, sf_dir, t).select((F.col("ticket_id") * 2 + 1).alias("id"))
    _, missing = TK.get_tickets(t, ids)
    return missing


@query("parse_probabilities", with_fixtures() + f"SELECT ticket_id, label, {G.py_round('p')} AS p FROM probabilities")
def q_parse_probabilities(spark, sf_dir):
    """#55: per-ticket JSON probability text (as stored) parsed back to a map."""
    probs = FX.probabilities(spark, sf_dir)
    stored = probs.groupBy("ticket_id").agg(
        TK.probabilities_json(F.map_from_entries(F.collect_list(F.struct("label", py_round(F.col("p"), 4)))))
        .alias("category_probabilities"))
    parsed = stored.select("ticket_id", TK.parse_probabilities(F.col("category_probabilities")).alias("m"))
    return parsed.select("ticket_id", F.explode("m").alias("label", "p"))


# Patches with all six fields (the view has two of them); '' and NULL mean no change.
MORE_PATCH_FIELDS = {"assigned_to": (20, "agent7", 5), "resolution_notes": (30, "called back", 10),
                     "resolution": (25, "refunded", 0), "predicted_priority": (35, "Low", 15)}
FULL_PATCHES = "full_patches AS (SELECT *, " + ", ".join(
    f"CASE WHEN ticket_id % {k} = 0 THEN '{v}' WHEN ticket_id % {k} = {e} THEN '' END AS {c}"
    for c, (k, v, e) in MORE_PATCH_FIELDS.items()) + " FROM patches)"
PATCHED = """patched AS (SELECT t.* REPLACE (coalesce(nullif(p.status, ''), t.status) AS status,
  coalesce(nullif(p.resolution_notes, ''), t.resolution_notes) AS resolution_notes,
  coalesce(nullif(p.predicted_priority, ''), t.predicted_priority) AS predicted_priority,
  coalesce(p.patched_at, t.updated_at) AS updated_at,
  CASE WHEN p.status = 'Resolved' THEN p.patched_at ELSE t.resolved_at END AS resolved_at),
  nullif(p.assigned_to, '') AS assigned_to, nullif(p.resolution, '') AS resolution,
  coalesce(nullif(p.assigned_department, ''), t.predicted_category) AS assigned_department
 FROM tickets t LEFT JOIN full_patches p USING (ticket_id))"""


def _full_patches(spark, sf_dir, t):
    p = FX.patches(spark, sf_dir, t)
    for c, (k, v, e) in MORE_PATCH_FIELDS.items():
        p = p.withColumn(c, F.when(F.col("ticket_id") % k == 0, v).when(F.col("ticket_id") % k == e, ""))
    return p


@query("patch_tickets", with_fixtures(FULL_PATCHES, PATCHED) + """SELECT ticket_id, status, assigned_department, assigned_to,
  resolution_notes, resolution, predicted_priority, updated_at, resolved_at FROM patched""")
def q_patch_tickets(spark, sf_dir):
    """#56: patches of all six fields applied; empty fields leave the value unchanged."""
    t = FX.tickets(spark, sf_dir)
    t2 = t.withColumn("assigned_department", F.col("predicted_category"))
    out = TK.patch_tickets(t2, _full_patches(spark, sf_dir, t))
    return out.select("ticket_id", "status", "assigned_department", "assigned_to", "resolution_notes", "resolution",
                      "predicted_priority", "updated_at", "resolved_at")


@query("patch_stored_tickets", with_fixtures(FULL_PATCHES, PATCHED) + """SELECT ticket_id, status, assigned_department, assigned_to,
  resolution_notes, resolution, predicted_priority, updated_at, resolved_at FROM patched""")
def q_patch_stored_tickets(spark, sf_dir):
    """#56 on a written table, in overlapping batches, one of them twice: what one batch would leave."""
    t = FX.tickets(spark, sf_dir)
    table = ST.create_tickets(spark, scratch_path(spark, "stored-tickets"), t, "timestamp_ntz", buckets=16)
    patches = _full_patches(spark, sf_dir, t)
    for batch in (patches.where("ticket_id % 10 = 0"), patches, patches.where("ticket_id % 10 = 0")):
        ST.apply_patches(table, batch)
    return table.read().select("ticket_id", "status", "assigned_department", "assigned_to", "resolution_notes", "resolution",
                               "predicted_priority", "updated_at", "resolved_at")


@query("triage_queue", with_fixtures() + """SELECT t.*, a.triage_id, a.reason AS triage_reason,
  a.status AS triage_status, CAST(NULL AS VARCHAR) AS triage_assigned_to, CAST(NULL AS VARCHAR) AS action_taken
 FROM triage a JOIN tickets t ON a.ticket_id = t.ticket_id ORDER BY a.created_at DESC""")
def q_triage_queue(spark, sf_dir):
    """#57: triage queue joined to tickets, newest first."""
    t = FX.tickets(spark, sf_dir)
    return TK.triage_queue(FX.triage(spark, sf_dir, t), t)


REPLAY_COLS = ["ticket_id", "queue_status", "action_taken", "new_department", "queue_assigned_to",
               "queue_resolved_at", "ticket_status", "is_triage", "assigned_department", "assigned_to",
               "predicted_priority", "updated_at"]


def _replay_sql(kinds: tuple[str, ...]) -> str:
    ks = ", ".join(G.q(k) for k in kinds)

    def f(writers):
        w = [k for k in writers if k in kinds]
        return "(" + (", ".join(G.q(k) for k in w) if w else "NULL") + ")"

    def last(expr, writers):
        return f"arg_max_null({expr}, seq) FILTER (WHERE action IN {f(writers)})"

    def n(writers):
        return f"count(*) FILTER (WHERE action IN {f(writers)})"

    ALL = ("accept", "reassign", "escalate")
    return with_fixtures(f"""acts AS (SELECT * FROM actions WHERE action IN ({ks})),
fold AS (SELECT ticket_id,
  {last("CASE WHEN action = 'escalate' THEN 'Escalated' ELSE 'Resolved' END", ALL)} AS queue_status, {n(ALL)} AS n_all,
  {last("CASE action WHEN 'accept' THEN 'Accepted AI prediction' WHEN 'reassign' THEN 'Reassigned to ' || coalesce(new_department, 'None') ELSE 'Escalated' END", ALL)} AS action_taken,
  {last("new_department", ("reassign",))} AS new_department, {n(("reassign",))} AS n_re,
  {last("assigned_to", ("reassign", "escalate"))} AS queue_assigned_to, {n(("reassign", "escalate"))} AS n_re_es,
  {last("acted_at", ("accept", "reassign"))} AS queue_resolved_at, {n(("accept", "reassign"))} AS n_ac_re,
  {last("CASE WHEN action = 'escalate' THEN 'Escalated' ELSE 'Open' END", ALL)} AS ticket_status,
  {n(("escalate",))} AS n_es,
  {last("acted_at", ALL)} AS updated_at
 FROM acts GROUP BY ticket_id)""") + """SELECT a.ticket_id,
  CASE WHEN f.n_all > 0 THEN f.queue_status ELSE a.status END AS queue_status,
  CASE WHEN f.n_all > 0 THEN f.action_taken END AS action_taken,
  CASE WHEN f.n_re > 0 THEN f.new_department END AS new_department,
  CASE WHEN f.n_re_es > 0 THEN f.queue_assigned_to END AS queue_assigned_to,
  CASE WHEN f.n_ac_re > 0 THEN f.queue_resolved_at END AS queue_resolved_at,
  CASE WHEN f.n_all > 0 THEN f.ticket_status ELSE t.status END AS ticket_status,
  CASE WHEN f.n_ac_re > 0 THEN 0 ELSE t.is_triage END AS is_triage,
  CASE WHEN f.n_re > 0 THEN f.new_department ELSE t.predicted_category END AS assigned_department,
  CASE WHEN f.n_re > 0 THEN (SELECT arg_max_null(assigned_to, seq) FROM acts x
    WHERE x.ticket_id = a.ticket_id AND x.action = 'reassign') END AS assigned_to,
  CASE WHEN f.n_es > 0 THEN 'Critical' ELSE t.predicted_priority END AS predicted_priority,
  CASE WHEN f.n_all > 0 THEN f.updated_at ELSE t.updated_at END AS updated_at
 FROM triage a JOIN tickets t USING (ticket_id) LEFT JOIN fold f USING (ticket_id)"""


def _apply(spark, sf_dir, kinds):
    t = FX.tickets(spark, sf_dir)
    a = FX.triage(spark, sf_dir, t)
    return TK.apply_triage_actions(a, t, FX.actions(spark, sf_dir, a), kinds).select(*REPLAY_COLS)


@query("triage_accept", _replay_sql(("accept",)))
def q_triage_accept(spark, sf_dir):
    """#58: accept actions: queue Resolved with action text; ticket Open, flag 0."""
    return _apply(spark, sf_dir, ("accept",))


@query("triage_reassign", _replay_sql(("reassign",)))
def q_triage_reassign(spark, sf_dir):
    """#59: reassign actions: as accept plus new department and assignee."""
    return _apply(spark, sf_dir, ("reassign",))


@query("triage_escalate", _replay_sql(("escalate",)))
def q_triage_escalate(spark, sf_dir):
    """#60: escalate actions: Escalated, priority Critical, resolved_at untouched."""
    return _apply(spark, sf_dir, ("escalate",))


@query("triage_replay", _replay_sql(("accept", "reassign", "escalate")))
def q_triage_replay(spark, sf_dir):
    """#61: the whole ordered action log folded per column (last writer wins)."""
    return _apply(spark, sf_dir, ("accept", "reassign", "escalate"))


@query("triage_two_batches", _replay_sql(("accept", "reassign", "escalate")))
def q_triage_two_batches(spark, sf_dir):
    """#58-#61 in two batches: first actions, then the later ones on the tables the first left; as one batch."""
    t = FX.tickets(spark, sf_dir)
    a = FX.triage(spark, sf_dir, t)
    acts = FX.actions(spark, sf_dir, a)
    queue, t1 = TK.replay_tables(a, t, acts.where("seq = 1"))
    queue, t2 = TK.replay_tables(queue, t1, acts.where("seq > 1"))
    return TK.queue_state(queue, t2).select(*REPLAY_COLS)


@query("triage_stored_tables", _replay_sql(("accept", "reassign", "escalate")))
def q_triage_stored_tables(spark, sf_dir):
    """#58-#61 on a written queue and ticket table: the first actions, the whole log over them, the first ones again."""
    t = FX.tickets(spark, sf_dir)
    a = FX.triage(spark, sf_dir, t)
    queue = ST.create_queue(spark, scratch_path(spark, "stored-queue"), a, buckets=16)
    table = ST.create_tickets(spark, scratch_path(spark, "stored-tickets"), t, "bigint", buckets=16)
    acts = FX.actions(spark, sf_dir, a)
    for batch in (acts.where("seq = 1"), acts, acts.where("seq = 1")):
        ST.apply_actions(queue, table, batch)
    return TK.queue_state(queue.read(), table.read()).select(*REPLAY_COLS)


_CHAIN = f"""rows AS ({ROWS_SQL}),
queue AS (SELECT ticket_id, created_at FROM scored_rule JOIN tickets USING (ticket_id) WHERE scored_rule.risk_level = 'High'),
acts AS (SELECT q.ticket_id, s.seq, CASE (q.ticket_id + s.seq) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reassign' ELSE 'escalate'
   END AS action, q.created_at + to_hours(CAST(s.seq AS INT)) AS acted_at
 FROM queue q JOIN steps s ON s.seq <= 1 + q.ticket_id % 3),
done AS (SELECT ticket_id, arg_max(action, seq) AS act, max(acted_at) AS at, count(*) FILTER (WHERE action = 'escalate') AS n_es,
  count(*) FILTER (WHERE action = 'reassign') AS n_re, count(*) FILTER (WHERE action <> 'escalate') AS n_not_es FROM acts GROUP BY 1)"""


@query("ticket_chain", with_fixtures(RULE_CTE, FULL_PATCHES, _CHAIN) + """SELECT r.ticket_id,
  CASE WHEN d.act = 'escalate' THEN 'Escalated' WHEN d.act IS NOT NULL THEN 'Open' ELSE
    coalesce(nullif(p.status, ''), r.status) END AS status,
  CASE WHEN d.n_re > 0 THEN 'ACCOUNT' ELSE coalesce(nullif(p.assigned_department, ''), r.assigned_department) END
    AS assigned_department,
  CASE WHEN d.n_es > 0 THEN 'Critical' ELSE coalesce(nullif(p.predicted_priority, ''), r.predicted_priority) END
    AS predicted_priority,
  CASE WHEN d.n_not_es > 0 THEN 0 ELSE r.is_triage END AS is_triage,
  coalesce(d.at, p.patched_at, r.updated_at) AS updated_at,
  CASE WHEN p.status = 'Resolved' THEN p.patched_at END AS resolved_at,
  CASE WHEN d.act = 'escalate' THEN 'Escalated' ELSE 'Resolved' END AS triage_status,
  CASE d.act WHEN 'accept' THEN 'Accepted AI prediction' WHEN 'reassign' THEN 'Reassigned to ACCOUNT' ELSE 'Escalated' END
    AS action_taken
 FROM rows r JOIN done d USING (ticket_id) LEFT JOIN full_patches p USING (ticket_id)""")
def q_ticket_chain(spark, sf_dir):
    """Score -> append in two parts -> patch -> queue -> replay -> list the queue (#42, #4, #56, #48, #61, #57)."""
    t = FX.tickets(spark, sf_dir)
    scored = FL.stored(S.score_tickets(spread(t), keys=SOURCE_KEYS), scratch_path(spark, "chain-scored"))  # four steps read it
    rows = TK.ticket_rows(scored)
    path = scratch_path(spark, "chain-tickets")
    TK.append_tickets(rows.where("ticket_id % 2 = 0"), path)
    TK.append_tickets(rows.where("ticket_id % 2 = 1"), path)  # onto a table that has rows
    patched = TK.patch_tickets(spark.read.parquet(path), _full_patches(spark, sf_dir, t))
    queue = S.queue_rows(scored)
    queue, tickets = TK.replay_tables(queue, patched, FX.actions(spark, sf_dir, queue.select("ticket_id", "created_at")))
    return TK.triage_queue(queue, tickets).select(
        "ticket_id", "status", "assigned_department", "predicted_priority", "is_triage", "updated_at", "resolved_at",
        "triage_status", "action_taken")
