"""Scoring queries (#28-#51) over the ticket view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.formatting import py_round
from ..operators import score as S
from ..operators.terms import spread
from ..sources import fixtures as FX
from . import sqlgen as G
from .oracle_fixtures import with_fixtures
from .registry import query

FEATURES_FLAT = ["text_length", "word_count", "has_question", "exclamation_count"]


def _flat(scored):
    return scored.select(*[c for c in scored.columns if c not in (
        "features", "category_probabilities", "intent_probabilities")],
        *[F.col(f"features.{c}").alias(c) for c in FEATURES_FLAT])


# ---------------------------------------------------------------- #42 flagship
_fcols, _fcat, _fconf = G.fallback_sql("description")
_feat = G.feature_sql("description")
RULE_CTE = f"""rp0 AS (
 SELECT ticket_id, description, {_fcols},
  {_feat['urgency_score']} AS urgency_score, {_feat['sentiment_score']} AS sent,
  {_feat['text_length']} AS text_length, {_feat['word_count']} AS word_count,
  {_feat['has_question']} AS has_question, {_feat['exclamation_count']} AS exclamation_count
 FROM tickets),
rp1 AS (SELECT *, {_fcat} AS category, {_fconf} AS conf FROM rp0),
scored_rule AS (
 SELECT ticket_id, description, category, lower(category) || '_general' AS intent,
  {G.priority_from_urgency('urgency_score')} AS priority,
  round(conf, 4) AS confidence, round(conf * 0.8, 4) AS intent_confidence,
  {G.risk_tier_level('conf')} AS risk_level, round(1 - conf, 4) AS risk_score,
  round(conf * 0.5, 4) AS ambiguity_gap, CAST(sent AS DOUBLE) AS sentiment_score,
  {G.sentiment_score_label('sent')} AS sentiment_label, urgency_score,
  text_length, word_count, has_question, exclamation_count
 FROM rp1)"""

SCORED_RULE_COLS = ("ticket_id, category, intent, priority, confidence, intent_confidence, risk_level, "
                    "risk_score, ambiguity_gap, sentiment_score, sentiment_label, urgency_score, "
                    "text_length, word_count, has_question, exclamation_count")


@query("score_tickets", with_fixtures(RULE_CTE) + f"SELECT {SCORED_RULE_COLS} FROM scored_rule")
def q_score_tickets(spark, sf_dir):
    """#42: rule-path prediction for every ticket (flat columns)."""
    return _flat(S.score_tickets(FX.tickets(spark, sf_dir)))


# ---------------------------------------------------------------- #28-#35 text
from ..functions import routing as R  # noqa: E402
from ..functions import text as X  # noqa: E402
from ..sources.tables import read_table  # noqa: E402


@query("clean_text", "SELECT doc_id, " + G.clean("text") + " AS clean_text FROM documents")
def q_clean_text(spark, sf_dir):
    """#28 on whole raw documents."""
    return read_table(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("clean_text"))


_df = G.feature_sql("text")


@query("text_features", "SELECT doc_id, " + ", ".join(
    f"{_df[c]} AS {c}" for c in ["text_length", "word_count", "avg_word_length", "has_question", "exclamation_count"])
    + " FROM documents")
def q_text_features(spark, sf_dir):
    """#29 on whole raw documents (Unicode white space as Python's split)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.text_length("text").alias("text_length"), X.word_count("text").alias("word_count"),
                    X.avg_word_length("text").alias("avg_word_length"),
                    X.has_question("text").alias("has_question"),
                    X.exclamation_count("text").alias("exclamation_count"))


@query("lexicon_counts", with_fixtures() + "SELECT ticket_id, " + ", ".join(
    f"{_feat[c]} AS {c}" for c in ["urgency_score", "negative_word_count", "positive_word_count", "sentiment_score"])
    + " FROM tickets")
def q_lexicon_counts(spark, sf_dir):
    """#30: distinct lexicon entries found as substrings, per ticket."""
    t = FX.tickets(spark, sf_dir)
    return X.with_features(t, "description", ["urgency_score", "negative_word_count",
                                              "positive_word_count", "sentiment_score"]) \
        .select("ticket_id", "urgency_score", "negative_word_count", "positive_word_count", "sentiment_score")


@query("sentiment_lexicon", with_fixtures() + "SELECT ticket_id, "
       + G.sentiment_lexicon("description") + " AS sentiment_label FROM tickets")
def q_sentiment_lexicon(spark, sf_dir):
    """#31: whole-word sentiment label."""
    return FX.tickets(spark, sf_dir).select("ticket_id", X.sentiment_lexicon("description").alias("sentiment_label"))


@query("sentiment_score_label", with_fixtures() + f"SELECT ticket_id, {_feat['sentiment_score']} AS sentiment_score, "
       + G.sentiment_score_label(_feat["sentiment_score"]) + " AS sentiment_label FROM tickets")
def q_sentiment_score_label(spark, sf_dir):
    """#32: label from the lexicon score."""
    t = FX.tickets(spark, sf_dir)
    s = X.positive_word_count("description") - X.negative_word_count("description")
    return t.select("ticket_id", s.alias("sentiment_score")).select(
        "ticket_id", "sentiment_score", X.sentiment_score_label(F.col("sentiment_score")).alias("sentiment_label"))


@query("priority_urgency", with_fixtures() + f"SELECT ticket_id, {_feat['urgency_score']} AS urgency_score, "
       + G.priority_from_urgency(_feat["urgency_score"]) + " AS priority FROM tickets")
def q_priority_urgency(spark, sf_dir):
    """#33: priority from urgency count."""
    t = FX.tickets(spark, sf_dir).select("ticket_id", X.urgency_score("description").alias("urgency_score"))
    return t.select("ticket_id", "urgency_score", X.priority_from_urgency(F.col("urgency_score")).alias("priority"))


@query("priority_keywords", with_fixtures() + "SELECT ticket_id, "
       + G.priority_from_keywords("description") + " AS priority FROM tickets")
def q_priority_keywords(spark, sf_dir):
    """#34: priority from the high/medium keyword lists."""
    return FX.tickets(spark, sf_dir).select("ticket_id", X.priority_from_keywords("description").alias("priority"))


def _greet_sql(t: str) -> tuple[str, str]:
    back = f"lower({G.strip_ws(t)})"
    ui = G.strip_ws(f"lower(coalesce({t}, ''))")
    exact = ", ".join(G.q(g) for g in L.GREETINGS)
    pref_b = " OR ".join(f"starts_with({back}, {G.q(p)})" for p in L.GREETING_PREFIXES)
    pref_u = " OR ".join(f"starts_with({ui}, {G.q(g + s)})" for g in L.GREETINGS for s in L.UI_GREETING_SEPARATORS)
    return f"({back} IN ({exact}) OR {pref_b})", f"({ui} IN ({exact}) OR {pref_u})"


_gb, _gu = _greet_sql("description")


@query("greeting_filter", with_fixtures() + f"SELECT ticket_id, {_gb} AS is_greeting, {_gu} AS is_greeting_ui "
       "FROM tickets")
def q_greeting_filter(spark, sf_dir):
    """#35: greeting flags, backend and chat-window variants."""
    return FX.tickets(spark, sf_dir).select(
        "ticket_id", X.is_greeting("description").alias("is_greeting"),
        X.is_greeting_ui("description").alias("is_greeting_ui"))


# ---------------------------------------------------------------- #36-#47 routing
HITS_CTE = "kh AS (SELECT ticket_id, description, " + ", ".join(G.dept_hits_cols("description")) + " FROM tickets)"


@query("keyword_hits", with_fixtures(HITS_CTE) + " UNION ALL ".join(
    f"SELECT ticket_id, {G.q(d)} AS department, hits_{i} AS hits FROM kh WHERE hits_{i} > 0"
    for i, (d, _) in enumerate(L.ROUTING_RULES)))
def q_keyword_hits(spark, sf_dir):
    """#36: per ticket x department hit counts (departments with hits only)."""
    return S.keyword_hits_long(FX.tickets(spark, sf_dir))


ROUTER_CTE = HITS_CTE + f",\nrt AS (SELECT ticket_id, description, kh.* EXCLUDE (ticket_id, description), " \
    f"{G.router_sql('description')} AS department FROM kh)"


@query("department_router", with_fixtures(ROUTER_CTE)
       + f"SELECT ticket_id, department, {G.routed_hits('department')} AS department_hits FROM rt")
def q_department_router(spark, sf_dir):
    """#37: keyword router with first-wins ties and technical precedence."""
    return S.route_departments(FX.tickets(spark, sf_dir))


@query("fallback_category", with_fixtures(f"fb AS (SELECT ticket_id, {_fcols} FROM tickets)")
       + f"SELECT ticket_id, {_fcat} AS category, round({_fconf}, 4) AS confidence FROM fb")
def q_fallback_category(spark, sf_dir):
    """#38: ten-category rule classifier with hits/3 confidence."""
    return S.score_tickets(FX.tickets(spark, sf_dir)).select("ticket_id", "category", "confidence")


PF_CTE = f"""pr0 AS (SELECT ticket_id, label, p, {G.py_round('p')} AS p4 FROM probabilities),
pr AS (SELECT ticket_id, label, p, p4,
  row_number() OVER (PARTITION BY ticket_id ORDER BY p DESC, label) AS rn,
  row_number() OVER (PARTITION BY ticket_id ORDER BY p4 DESC, label) AS rn4 FROM pr0),
pf AS (SELECT ticket_id, max(CASE WHEN rn = 1 THEN label END) AS model_label, max(p) AS model_p,
  max(CASE WHEN rn4 = 1 THEN p4 END) - max(CASE WHEN rn4 = 2 THEN p4 END) AS model_gap
 FROM pr GROUP BY ticket_id)"""


@query("keyword_override", with_fixtures(PF_CTE) + "SELECT t.ticket_id, pf.model_label, "
       + G.override_sql("t.description", "pf.model_label") + " AS category FROM tickets t JOIN pf USING (ticket_id)")
def q_keyword_override(spark, sf_dir):
    """#39: override routes replace the model's label when any keyword hits."""
    t = FX.tickets(spark, sf_dir)
    folded = S.fold_probabilities(FX.probabilities(spark, sf_dir, t))
    return t.join(folded, "ticket_id").select(
        "ticket_id", "model_label", R.keyword_override("description", F.col("model_label")).alias("category"))


_LABELS_SQL = ", ".join(G.q(x) for x in FX.LABELS11)
MODEL_CTE = HITS_CTE + ",\n" + PF_CTE + f""",
mt1 AS (SELECT kh.*, pf.model_label, pf.model_p, pf.model_gap,
  CASE WHEN pf.model_p >= 0.5 THEN pf.model_label ELSE {G.router_sql('kh.description')} END AS arbitrated
 FROM kh JOIN pf USING (ticket_id)),
mt2 AS (SELECT *, CASE WHEN model_p >= 0.5 THEN {G.py_round('model_p')}
  ELSE round(least(0.95::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * {G.routed_hits('arbitrated')}), 4) END AS conf,
  {G.override_sql('description', 'arbitrated')} AS category FROM mt1),
scored_model AS (SELECT ticket_id, description, arbitrated, category, {G.intent_sql('category')} AS intent,
  {G.priority_from_keywords('description')} AS priority, round(conf, 4) AS confidence,
  round(least(0.99::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * {G.routed_hits('category')}), 4) AS intent_confidence,
  {G.risk_tier_level('conf')} AS risk_level, round({G.risk_tier_score('conf')}, 4) AS risk_score,
  {G.py_round(f"CASE WHEN category IN ({_LABELS_SQL}) THEN model_gap ELSE greatest(0.0::DOUBLE, 2.0 * conf - 1.0) END")}
   AS ambiguity_gap,
  CAST({_feat['sentiment_score']} AS DOUBLE) AS sentiment_score,
  {G.sentiment_lexicon('description')} AS sentiment_label, {_feat['urgency_score']} AS urgency_score,
  {_feat['text_length']} AS text_length, {_feat['word_count']} AS word_count,
  {_feat['has_question']} AS has_question, {_feat['exclamation_count']} AS exclamation_count
 FROM mt2)"""


def _model_scored(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return S.score_tickets_model(t, FX.probabilities(spark, sf_dir, t))


@query("arbitrate_model_rules", with_fixtures(MODEL_CTE)
       + "SELECT ticket_id, arbitrated AS department, conf AS confidence FROM mt2")
def q_arbitrate(spark, sf_dir):
    """#40: model label at >= 0.5, else the router's label and confidence."""
    t = FX.tickets(spark, sf_dir)
    folded = S.fold_probabilities(FX.probabilities(spark, sf_dir, t))
    a = S.arbitrate(S.with_routing_counts(t, "description", ["ticket_id"]), folded)
    return a.select("ticket_id", F.col("_arbitrated").alias("department"), F.col("_conf").alias("confidence"))


@query("intent_from_department", with_fixtures(MODEL_CTE)
       + f"SELECT ticket_id, arbitrated AS department, {G.intent_sql('arbitrated')} AS intent FROM mt2")
def q_intent_from_department(spark, sf_dir):
    """#41: mapped intent or snake_case fallback, for the arbitrated label."""
    a = q_arbitrate(spark, sf_dir)
    return a.select("ticket_id", "department", R.intent_from_department(F.col("department")).alias("intent"))


MODEL_COLS = ("ticket_id, category, intent, priority, confidence, intent_confidence, risk_level, risk_score, "
              "ambiguity_gap, sentiment_score, sentiment_label, urgency_score, text_length, word_count, "
              "has_question, exclamation_count")


@query("score_tickets_model", with_fixtures(MODEL_CTE) + f"SELECT {MODEL_COLS} FROM scored_model")
def q_score_tickets_model(spark, sf_dir):
    """#43: model-path prediction joined to the class probabilities."""
    return _flat(_model_scored(spark, sf_dir))


@query("ambiguity_gap", with_fixtures(MODEL_CTE) + "SELECT ticket_id, category, ambiguity_gap FROM scored_model")
def q_ambiguity_gap(spark, sf_dir):
    """#44: top-2 gap when the model label is kept, confidence proxy otherwise."""
    return _model_scored(spark, sf_dir).select("ticket_id", "category", "ambiguity_gap")


@query("risk_tiers", with_fixtures() + "SELECT ticket_id, " + G.risk_tier_level("confidence_score")
       + " AS risk_level, " + G.risk_tier_score("confidence_score") + " AS risk_score FROM tickets")
def q_risk_tiers(spark, sf_dir):
    """#45: confidence tiers on the stored ticket confidence."""
    level, score = R.risk_tier(F.col("confidence_score"))
    return FX.tickets(spark, sf_dir).select("ticket_id", level.alias("risk_level"), score.alias("risk_score"))


RISKF_CTE = """rk AS (SELECT ticket_id, p, row_number() OVER (PARTITION BY ticket_id ORDER BY p DESC, label) AS rn
 FROM probabilities),
rf0 AS (SELECT ticket_id, max(p) AS conf, max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END) AS gap
 FROM rk GROUP BY ticket_id),
rf AS (SELECT ticket_id, conf, gap,
  (1 - conf) * 0.6::DOUBLE + (1 - least(gap * 2, 1.0::DOUBLE)) * 0.4::DOUBLE AS risk FROM rf0)"""


def risk_formula_frame(probs):
    """Per ticket: top probability, top-2 gap and the #46 risk score/level."""
    g = probs.groupBy("ticket_id").agg(F.sort_array(F.collect_list("p"), False).alias("ps"))
    g = g.select("ticket_id", F.element_at("ps", 1).alias("conf"), R.top2_gap(F.col("ps")).alias("gap"))
    risk, level = R.risk_formula(F.col("conf"), F.col("gap"))
    return g.select("ticket_id", "conf", "gap", risk.alias("risk"), level.alias("risk_level"))


@query("risk_formula", with_fixtures(RISKF_CTE) + f"SELECT ticket_id, {G.py_round('risk')} AS risk, CASE WHEN risk > 0.6 "
       "THEN 'High' WHEN risk > 0.35 THEN 'Medium' ELSE 'Low' END AS risk_level FROM rf")
def q_risk_formula(spark, sf_dir):
    """#46: evaluation risk from top probability and top-2 gap."""
    r = risk_formula_frame(FX.probabilities(spark, sf_dir))
    return r.select("ticket_id", py_round(F.col("risk"), 4).alias("risk"), "risk_level")


@query("intent_confidence", with_fixtures(MODEL_CTE) + "SELECT ticket_id, category, intent_confidence FROM scored_model")
def q_intent_confidence(spark, sf_dir):
    """#47: 0.6 + 0.1 per hit of the final label's routing list, capped at 0.99."""
    return _model_scored(spark, sf_dir).select("ticket_id", "category", "intent_confidence")


# ---------------------------------------------------------------- #48-#51 outcome
_REASONS_SQL = ("coalesce(nullif(concat_ws(' | ', "
                f"CASE WHEN confidence < 0.6 THEN 'Low confidence: ' || {G.percent_1dp('confidence')} END, "
                f"CASE WHEN coalesce(ambiguity_gap, 1.0) < 0.15 THEN {G.q(L.TRIAGE_AMBIGUOUS_REASON)} END, "
                f"CASE WHEN sentiment_score < -1 THEN {G.q(L.TRIAGE_NEGATIVE_REASON)} END), ''), "
                f"{G.q(L.TRIAGE_DEFAULT_REASON)})")


@query("triage_reasons", with_fixtures(RULE_CTE) + f"SELECT ticket_id, {_REASONS_SQL} AS reason "
       "FROM scored_rule WHERE risk_level = 'High'")
def q_triage_reasons(spark, sf_dir):
    """#48: reasons for each High-risk ticket of the live (rule) path."""
    s = S.score_tickets(FX.tickets(spark, sf_dir))
    return s.where(F.col("risk_level") == "High").select("ticket_id", S.triage_reasons(s).alias("reason"))


@query("triage_reasons_model", with_fixtures(MODEL_CTE) + f"SELECT ticket_id, {_REASONS_SQL} AS reason "
       "FROM scored_model WHERE risk_level = 'High'")
def q_triage_reasons_model(spark, sf_dir):
    """#48 on the model path (percentages need Python's exact rounding)."""
    s = _model_scored(spark, sf_dir)
    return s.where(F.col("risk_level") == "High").select("ticket_id", S.triage_reasons(s).alias("reason"))


@query("routing_outcome", with_fixtures(RULE_CTE) + """SELECT ticket_id,
  CASE WHEN risk_level = 'High' THEN 'Triage' ELSE 'Open' END AS status,
  CASE WHEN risk_level = 'High' THEN 1 ELSE 0 END AS is_triage,
  CASE WHEN risk_level = 'High' THEN 1 ELSE 0 END AS requires_human,
  category AS route, risk_level AS misrouting_risk,
  CASE WHEN risk_level = 'High' THEN 'triage' ELSE 'auto_routed' END AS outcome,
  'Ticket #' || CAST(ticket_id AS VARCHAR) || ' created and ' || CASE WHEN risk_level = 'High'
   THEN 'sent to Triage Team for manual review' ELSE 'auto-routed to ' || category || ' department' END AS message
 FROM scored_rule""")
def q_routing_outcome(spark, sf_dir):
    """#49: status, flags, route and message per scored ticket."""
    s = S.score_tickets(FX.tickets(spark, sf_dir)).select("ticket_id", "category", "risk_level")
    return S.with_routing_outcome(s).drop("category", "risk_level")


_REPLY_SQL = (f"CASE WHEN sentiment_label = 'Negative' OR priority = 'High' THEN {G.q(L.CHAT_REPLY_APOLOGY)} "
              f"WHEN sentiment_label = 'Positive' THEN {G.q(L.CHAT_REPLY_THANKS)} ELSE {G.q(L.CHAT_REPLY_NEUTRAL)} END")


@query("chat_reply", with_fixtures(RULE_CTE) + f"SELECT ticket_id, {_REPLY_SQL} AS reply FROM scored_rule")
def q_chat_reply(spark, sf_dir):
    """#50: bot reply chosen from sentiment and priority."""
    s = S.score_tickets(FX.tickets(spark, sf_dir))
    return s.select("ticket_id", S.chat_reply(F.col("sentiment_label"), F.col("priority")).alias("reply"))


@query("chat_log", with_fixtures(RULE_CTE) + f"""SELECT ticket_id, 1 AS seq, 'user' AS sender, description AS message,
  'text' AS message_type FROM scored_rule
 UNION ALL SELECT ticket_id, 2 AS seq, 'bot' AS sender, {_REPLY_SQL} AS message, 'text' AS message_type FROM scored_rule""")
def q_chat_log(spark, sf_dir):
    """#51: user and bot rows per ticket."""
    t = FX.tickets(spark, sf_dir)
    s = S.score_tickets(t, keys=["ticket_id", "description"])
    return S.chat_log(s)


# Real texts instead of assembled sentences: every turn of the conversations and
# every whole document is routed and scored.
_TURNS = ("WITH tickets AS (SELECT conv_id * 1000 + turn AS ticket_id, text AS description FROM conversations),\n")
_TEXTS = "WITH tickets AS (SELECT doc_id AS ticket_id, text AS description FROM documents),\n"


def _turns(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ticket_id"), F.col("text").alias("description")))


def _texts(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket_id"), F.col("text").alias("description")))


@query("score_conversations", _TURNS + RULE_CTE + f" SELECT {SCORED_RULE_COLS} FROM scored_rule")
def q_score_conversations(spark, sf_dir):
    """#42 over the texts of all conversation turns."""
    return _flat(S.score_tickets(_turns(spark, sf_dir)))


@query("score_documents", _TEXTS + RULE_CTE + f" SELECT {SCORED_RULE_COLS} FROM scored_rule")
def q_score_documents(spark, sf_dir):
    """#42 over whole documents."""
    return _flat(S.score_tickets(_texts(spark, sf_dir)))


@query("route_conversations", _TURNS + ROUTER_CTE
       + f" SELECT ticket_id, department, {G.routed_hits('department')} AS department_hits FROM rt")
def q_route_conversations(spark, sf_dir):
    """#37 over the texts of all conversation turns."""
    return S.route_departments(_turns(spark, sf_dir))


@query("route_documents", _TEXTS + ROUTER_CTE
       + f" SELECT ticket_id, department, {G.routed_hits('department')} AS department_hits FROM rt")
def q_route_documents(spark, sf_dir):
    """#37 over whole documents."""
    return S.route_departments(_texts(spark, sf_dir))
