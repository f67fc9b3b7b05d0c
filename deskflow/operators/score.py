"""Ticket scoring (#42, #43) and what follows from a score (#48-#51).

Both scorers are one projection chain over the ticket rows. The rule path
(#42) never shuffles; the model path (#43) joins each ticket to its class
probabilities, which are first folded to one row per ticket (a group bounded
by the number of classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import routing as R
from ..functions import text as X
from ..functions.formatting import percent_1dp, py_round, py_round_columns

PREDICTION_COLUMNS = [
    "category", "intent", "priority", "confidence", "intent_confidence",
    "risk_level", "risk_score", "ambiguity_gap", "sentiment_score",
    "sentiment_label", "urgency_score",
]


def _features_struct(text: str) -> Column:
    return F.struct(
        X.text_length(text).alias("text_length"),
        X.word_count(text).alias("word_count"),
        X.has_question(text).alias("has_question"),
        X.exclamation_count(text).alias("exclamation_count"),
    )


def _with_text(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Stage 1: keys, raw text and the lower-cased text, computed once per row."""
    cols = list(dict.fromkeys(keys + [text]))
    return df.select(*cols, X.lower_text(text).alias("_low"))


def score_tickets(df: DataFrame, text: str = "description", keys: list[str] | None = None) -> DataFrame:
    """#42 rule-path prediction record for every row of ``df``.

    Category from the ten-category keyword rules (#38), priority from urgency
    (#33), sentiment label from the score (#32), risk from confidence tiers
    (#45) with ``risk_score = 1 - confidence``. Built in stages (text ->
    keyword counts -> labels -> rounded outputs) so every keyword count is
    evaluated once per row; no shuffle.
    """
    keys = keys if keys is not None else ["ticket_id"]
    low = F.col("_low")
    counts = R.fallback_counts(low)
    a = _with_text(df, text, keys)
    b = a.select(
        "*",
        *[c.alias(f"_f{i}") for i, c in enumerate(counts)],
        X.count_contained(low, L.URGENCY_KEYWORDS).alias("urgency_score"),
        (X.count_contained(low, L.POSITIVE_WORDS) - X.count_contained(low, L.NEGATIVE_WORDS)).alias("_sent"),
        _features_struct(text).alias("features"),
    )
    category, conf, _ = R.fallback_category(counts=[F.col(f"_f{i}") for i in range(len(counts))])
    c = b.select(*keys, "urgency_score", "_sent", "features",
                 category.alias("category"), conf.alias("_conf"))
    cf = F.col("_conf")
    level, _ = R.risk_tier(cf)
    intent = F.concat(F.lower(F.col("category")), F.lit("_general"))
    return c.select(
        *keys,
        F.col("category"),
        intent.alias("intent"),
        X.priority_from_urgency(F.col("urgency_score")).alias("priority"),
        py_round(cf, 4).alias("confidence"),
        py_round(cf * 0.8, 4).alias("intent_confidence"),
        level.alias("risk_level"),
        py_round(1 - cf, 4).alias("risk_score"),
        py_round(cf * 0.5, 4).alias("ambiguity_gap"),
        F.col("_sent").cast("double").alias("sentiment_score"),
        X.sentiment_score_label(F.col("_sent")).alias("sentiment_label"),
        F.col("urgency_score"),
        F.create_map(F.col("category"), cf).alias("category_probabilities"),
        F.create_map(intent, cf).alias("intent_probabilities"),
        F.col("features"),
    )


def fold_probabilities(probs: DataFrame, key: str = "ticket_id") -> DataFrame:
    """One row per ticket from long-form (key, label, p).

    Adds the argmax label (ties to the first label in class order), its raw
    probability, the label -> round(p, 4) map and the gap between the two
    largest rounded values. Each group holds one row per class, so it is
    bounded by the class count however large the table is. For stored tables in
    the long form only: a model's probabilities are one array per ticket
    (``model_columns``) and need neither this shuffle nor a join.
    """
    top = F.min(F.struct((-F.col("p")).alias("neg_p"), F.col("label").alias("label")))
    r = probs.select(key, "label", "p", py_round(F.col("p"), 4).alias("_p4"))
    g = r.groupBy(key).agg(top.alias("_top"), F.collect_list(F.struct(F.col("label"), F.col("_p4"))).alias("_l"))
    values = F.sort_array(F.transform("_l", lambda e: e["_p4"]), False)
    return g.select(key, F.col("_top.label").alias("model_label"), (-F.col("_top.neg_p")).alias("model_p"),
                    F.map_from_entries("_l").alias("category_probabilities"), R.top2_gap(values).alias("model_gap"))


def with_routing_counts(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Text stage plus the twelve department hit counts (hits_0..hits_11), the
    technical-signal flag and the four override route counts (_o_<route>)."""
    low = F.col("_low")
    a = _with_text(df, text, keys)
    hits = R.department_hits_from(low)
    return a.select(
        "*",
        *[h.alias(n) for h, n in zip(hits, R.department_hit_columns())],
        R.tech_signal(low).alias("_signal"),
        *[c.alias(f"_o_{i}") for i, c in enumerate(R.override_counts(low).values())],
    )


def _override_cols() -> dict[str, Column]:
    return {name: F.col(f"_o_{i}") for i, (name, _) in enumerate(L.OVERRIDE_ROUTES)}


MODEL_COLUMNS = ["model_label", "model_p", "category_probabilities", "model_gap"]


def model_columns(labels: list[str], probabilities: Column) -> list[Column]:
    """The columns of ``fold_probabilities`` from one array of probabilities per row, in the order of ``labels``."""
    names = F.array(*[F.lit(x) for x in labels])
    rounded = F.transform(probabilities, lambda p: py_round_columns(p, 4))
    top = F.array_max(probabilities)
    return [F.element_at(names, F.array_position(probabilities, top).cast("int")).alias("model_label"),
            top.alias("model_p"), F.map_from_arrays(names, rounded).alias("category_probabilities"),
            R.top2_gap(rounded).alias("model_gap")]


def arbitrate(routed: DataFrame, folded: DataFrame | None, key: str = "ticket_id") -> DataFrame:
    """#40 on a frame with routing counts: choose the model label (p >= 0.5) or
    the router's label and confidence. The model's columns come from ``folded``
    by a join, or are in the rows already (None)."""
    hits = [F.col(n) for n in R.department_hit_columns()]
    j = routed if folded is None else routed.join(folded, key, "inner")
    kept = F.col("model_p") >= L.MODEL_CONFIDENCE_MIN
    rule_dept = R.department_router(hits, signal=F.col("_signal"))
    a = j.select("*", F.when(kept, F.col("model_label")).otherwise(rule_dept).alias("_arbitrated"))
    a = a.select("*", R.routed_hits(F.col("_arbitrated"), hits).alias("_arb_hits"))
    return a.select("*", F.when(kept, py_round(F.col("model_p"), 4))
                    .otherwise(R.router_confidence(F.col("_arb_hits"))).alias("_conf"))


def score_tickets_model(df: DataFrame, probs: DataFrame | None, text: str = "description",
                        key: str = "ticket_id") -> DataFrame:
    """#43 model-path prediction: arbitration (#40), override (#39), intent (#41),
    keyword priority (#34), lexicon sentiment (#31), gap (#44), risk tiers (#45).

    Staged: keyword counts per ticket, then one join to the per-ticket folded
    probabilities (both sides hashed on the key), then label and rounding
    projections over plain columns. With ``probs`` None the rows carry
    ``model_columns`` of a model that scored them, and nothing is joined.
    """
    low = F.col("_low")
    routed = with_routing_counts(df, text, [key, *([] if probs is not None else MODEL_COLUMNS)]).select(
        "*",
        X.count_contained(low, L.URGENCY_KEYWORDS).alias("urgency_score"),
        (X.count_contained(low, L.POSITIVE_WORDS) - X.count_contained(low, L.NEGATIVE_WORDS)).alias("_sent"),
        X.priority_from_lowered(low).alias("priority"),
        X.sentiment_lexicon(text).alias("sentiment_label"),
        _features_struct(text).alias("features"),
    )
    a = arbitrate(routed, None if probs is None else fold_probabilities(probs, key), key)
    hits = [F.col(n) for n in R.department_hit_columns()]
    b = a.select("*", R.override_label(_override_cols(), F.col("_arbitrated")).alias("category"))
    b = b.select("*", R.routed_hits(F.col("category"), hits).alias("_cat_hits"),
                 F.array_contains(F.map_keys("category_probabilities"), F.col("category")).alias("_in_map"))
    cf = F.col("_conf")
    gap = F.when(F.col("_in_map"), F.col("model_gap")).otherwise(R.gap_proxy(cf))
    b = b.select("*", gap.alias("_gap"))
    level, risk_score = R.risk_tier(cf)
    s2 = b.select(
        key,
        F.col("category"),
        R.intent_from_department(F.col("category")).alias("intent"),
        F.col("priority"),
        py_round(cf, 4).alias("confidence"),
        R.intent_confidence_from_hits(F.col("_cat_hits")).alias("intent_confidence"),
        level.alias("risk_level"),
        py_round(risk_score, 4).alias("risk_score"),
        py_round(F.col("_gap"), 4).alias("ambiguity_gap"),
        F.col("_sent").cast("double").alias("sentiment_score"),
        F.col("sentiment_label"),
        F.col("urgency_score"),
        F.col("category_probabilities"),
        F.col("features"),
    )
    return s2.withColumn("intent_probabilities", F.create_map(F.col("intent"), F.col("intent_confidence")))


def triage_reasons(scored: DataFrame) -> Column:
    """#48: reasons a High-risk ticket goes to a person, ' | '-joined."""
    parts = F.concat_ws(
        " | ",
        F.when(F.col("confidence") < L.RISK_HIGH_BELOW_CONF,
               F.concat(F.lit("Low confidence: "), percent_1dp(F.col("confidence")))),
        F.when(F.coalesce(F.col("ambiguity_gap"), F.lit(1.0)) < L.AMBIGUITY_MIN_GAP,
               F.lit(L.TRIAGE_AMBIGUOUS_REASON)),
        F.when(F.col("sentiment_score") < -1, F.lit(L.TRIAGE_NEGATIVE_REASON)),
    )
    return F.when(parts == "", F.lit(L.TRIAGE_DEFAULT_REASON)).otherwise(parts)


def with_routing_outcome(scored: DataFrame, key: str = "ticket_id") -> DataFrame:
    """#49: status, triage flags, route and the outcome message."""
    high = F.col("risk_level") == "High"
    return scored.select(
        "*",
        F.when(high, "Triage").otherwise("Open").alias("status"),
        F.when(high, 1).otherwise(0).alias("is_triage"),
        F.when(high, 1).otherwise(0).alias("requires_human"),
        F.col("category").alias("route"),
        F.col("risk_level").alias("misrouting_risk"),
        F.when(high, "triage").otherwise("auto_routed").alias("outcome"),
        F.concat(F.lit("Ticket #"), F.col(key).cast("string"), F.lit(" created and "),
                 F.when(high, F.lit("sent to Triage Team for manual review"))
                  .otherwise(F.concat(F.lit("auto-routed to "), F.col("category"), F.lit(" department"))))
         .alias("message"),
    )


def chat_reply(sentiment_label: Column, priority: Column) -> Column:
    """#50: apology for Negative or High, thanks for Positive, else neutral."""
    return (F.when((sentiment_label == "Negative") | (priority == "High"), F.lit(L.CHAT_REPLY_APOLOGY))
            .when(sentiment_label == "Positive", F.lit(L.CHAT_REPLY_THANKS))
            .otherwise(F.lit(L.CHAT_REPLY_NEUTRAL)))


def chat_log(scored_with_text: DataFrame, text: str = "description", key: str = "ticket_id") -> DataFrame:
    """#51: two chat rows per ticket -- the user's text, then the bot reply."""
    reply = chat_reply(F.col("sentiment_label"), F.col("priority"))
    return scored_with_text.select(
        key,
        F.inline(F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("user").alias("sender"), F.col(text).alias("message")),
            F.struct(F.lit(2).alias("seq"), F.lit("bot").alias("sender"), reply.alias("message")),
        )),
    ).withColumn("message_type", F.lit("text"))


def triage_rows(scored: DataFrame, key: str = "ticket_id", chat: bool = False) -> DataFrame:
    """Triage-queue rows for High-risk tickets (reason per #48, constant on chat)."""
    reason = F.lit(L.TRIAGE_CHAT_REASON) if chat else triage_reasons(scored)
    return scored.where(F.col("risk_level") == "High").select(
        F.col(key).alias("ticket_id"), reason.alias("reason"),
        F.col("category").alias("original_prediction"), F.lit("Pending").alias("status"))


def queue_rows(scored: DataFrame, key: str = "ticket_id", time_col: str = "created_at", chat: bool = False) -> DataFrame:
    """Whole triage-queue rows (#48 feeding #57-#61): id, reason, prediction, status and the columns actions fill.

    A ticket enters the queue once, so its id serves as the queue row's id.
    """
    high = scored.where(F.col("risk_level") == "High")
    empty = F.lit(None).cast("string")
    reason = F.lit(L.TRIAGE_CHAT_REASON) if chat else triage_reasons(scored)
    return high.select(
        F.col(key).alias("triage_id"), F.col(key).alias("ticket_id"), reason.alias("reason"),
        F.col("category").alias("original_prediction"), empty.alias("assigned_to"), empty.alias("action_taken"),
        empty.alias("new_department"), F.lit("Pending").alias("status"), F.col(time_col).alias("created_at"),
        F.lit(None).cast(scored.schema[time_col].dataType).alias("resolved_at"))


def keyword_hits_long(df: DataFrame, text: str = "description", key: str = "ticket_id") -> DataFrame:
    """#36 long form: (key, department, hits) for every department with hits > 0.

    The twelve counts are computed in one projection and unpivoted with
    ``inline`` -- no cross join with a keyword table and no shuffle.
    """
    a = _with_text(df, text, [key])
    hits = R.department_hits_from(F.col("_low"))
    names = [d for d, _ in L.ROUTING_RULES]
    rows = F.array(*[F.struct(F.lit(d).alias("department"), h.alias("hits")) for d, h in zip(names, hits)])
    return a.select(key, F.inline(rows)).where(F.col("hits") > 0)


def route_departments(df: DataFrame, text: str = "description", key: str = "ticket_id") -> DataFrame:
    """#37: department chosen by the keyword router, with the hits of its list."""
    t = with_routing_counts(df, text, [key])
    hits = [F.col(n) for n in R.department_hit_columns()]
    d = t.select(key, R.department_router(hits, signal=F.col("_signal")).alias("department"),
                 *R.department_hit_columns())
    return d.select(key, "department", R.routed_hits(F.col("department"), hits).alias("department_hits"))
