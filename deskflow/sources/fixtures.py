"""Derived input views (FIXTURES.md part 2) built from the driver's ``events``.

Each view only produces rows in the schema a job expects; none of them does
any scoring or reporting work. One ticket per ``events`` row, so every view
grows linearly with the driver tables. Small fixed vocabularies (phrases,
tones, labels) are literal arrays indexed per row -- a projection, not a join,
so building the views never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# FIXED VALUES (FIXTURES.md): (category, intent, phrase) by index 0..23.
PHRASES = [
    ("PAYMENT", "payment_issue", "The bank card was charged twice for one invoice payment"),
    ("ACCOUNT", "recover_password", "I forgot my password and the login page rejects me"),
    ("ORDER", "track_order", "Where is the order for delivery on Monday"),
    ("DELIVERY", "delivery_period", "The courier left a damaged package at the door"),
    ("REFUND", "get_refund", "I want my money back for the return"),
    ("SUBSCRIPTION", "newsletter_subscription", "Please downgrade the membership plan"),
    ("CONTACT", "contact_human_agent", "Nobody responded to the previous ticket"),
    ("FEEDBACK", "review", "Lovely shop, a missing feature is dark colours"),
    ("CANCEL", "check_cancellation_fee", "What does it cost to cancel before the end of May"),
    ("INVOICE", "get_invoice", "Send the billing statement for March"),
    ("SHIPPING", "change_shipping_address", "The shipping label shows the wrong address"),
    ("ACCOUNT", "edit_account", "The app crashes when I edit my profile"),
    ("PAYMENT", "payment_issue", "A timeout appears on the payment screen"),
    ("ACCOUNT", "registration_problems", "The otp for verification never arrives"),
    ("ORDER", "change_order", "The coupon gives no discount at checkout"),
    ("ORDER", "place_order", "Is the blue lamp back in stock"),
    ("CONTACT", "complaint", "Service unavailable, the website is not loading"),
    ("ACCOUNT", "delete_account", "Somebody hacked me, this looks like fraud"),
    ("PAYMENT", "check_payment_methods", "zxq wvut blorf 12345"),
    ("REFUND", "track_refund", "Still waiting for the reimbursement"),
    ("CONTACT", "contact_customer_service", "hello there"),
    ("FEEDBACK", "complaint", "Bad quality, terrible product and a ridiculous offer"),
    ("DELIVERY", "delivery_options", "Late again"),
    ("INVOICE", "check_invoice", "hi"),
]

# FIXED VALUES (FIXTURES.md): tone suffix by index 0..9.
TONES = [
    "",
    " Thank you, great and kind help!",
    " This is urgent, fix it immediately, asap!!",
    " I am angry and frustrated.",
    " Can you help me right now?",
    " It is not working.",
    " I cannot accept this error!",
    " Please advise.",
    "   ",
    " Excellent, I am happy and satisfied!",
]

# FIXED VALUES (FIXTURES.md): the eleven model labels, in class (alphabetical) order.
LABELS11 = [
    "ACCOUNT", "CANCEL", "CONTACT", "DELIVERY", "FEEDBACK", "INVOICE",
    "ORDER", "PAYMENT", "REFUND", "SHIPPING", "SUBSCRIPTION",
]


def _hours(ts: Column, n: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts)


def _pick(values: list, index: Column) -> Column:
    """``values[index]`` for a small literal list (0-based index)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View T: one ticket per ``events`` row (key ``ticket_id``)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    eid, uid = F.col("event_id"), F.col("user_id")
    p_idx = eid % 24
    t_idx = F.floor(eid / 24) % 10
    phrase = _pick([p[2] for p in PHRASES], p_idx)
    tone = _pick(TONES, t_idx)
    category = _pick([p[0] for p in PHRASES], p_idx)
    intent = _pick([p[1] for p in PHRASES], p_idx)
    code = (eid * 37) % 1000
    shift = (eid % 72).cast("int")
    return e.select(
        eid.alias("ticket_id"),
        F.when(F.floor(eid / 240) % 3 == 0, F.concat(phrase, tone))
         .otherwise(F.concat(phrase, tone, F.lit(" ref "), eid.cast("string"))).alias("description"),
        F.concat(F.lit("User "), uid.cast("string")).alias("customer_name"),
        F.when(uid % 3 == 0, "Chatbot").when(uid % 3 == 1, "Email").otherwise("Seed").alias("channel"),
        F.when(uid % 4 == 0, "north").when(uid % 4 == 1, "south").when(uid % 4 == 2, "east")
         .otherwise("west").alias("region"),
        F.when(F.col("event_type") == "view", "Open").when(F.col("event_type") == "click", "In Progress")
         .when(F.col("event_type") == "purchase", "Resolved").when(F.col("event_type") == "error", "Triage")
         .otherwise("Escalated").alias("status"),
        category.alias("true_category"),
        intent.alias("true_intent"),
        F.when(eid % 53 == 0, F.lit(None).cast("string")).otherwise(category).alias("predicted_category"),
        F.when(eid % 5 == 0, "High").when(eid % 5 == 1, "Medium").when(eid % 5 == 2, "Critical")
         .otherwise("Low").alias("predicted_priority"),
        (code.cast("double") / 1000).alias("confidence_score"),
        F.when(code >= 800, "Low").when(code < 600, "High").otherwise("Medium").alias("risk_level"),
        F.when(code < 600, 1).otherwise(0).alias("is_triage"),
        F.when(eid % 11 == 0, "").when(eid % 11 == 1, F.lit(None).cast("string"))
         .otherwise("noted").alias("resolution_notes"),
        F.col("ts").alias("created_at"),
        F.when(eid % 4 == 0, F.col("ts")).otherwise(_hours(F.col("ts"), shift)).alias("updated_at"),
        F.when(F.col("event_type") == "purchase", _hours(F.col("ts"), shift)).alias("resolved_at"),
    )


def triage(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """View A: triage rows for tickets with confidence below 0.60."""
    t = tickets(spark, sf_dir) if t is None else t
    tid = F.col("ticket_id")
    return t.where(F.col("is_triage") == 1).select(
        tid.alias("triage_id"), tid,
        F.lit("High risk score").alias("reason"),
        F.col("true_category").alias("original_prediction"),
        F.when(tid % 3 == 0, "Pending").when(tid % 3 == 1, "Resolved").otherwise("Escalated").alias("status"),
        F.col("created_at"),
    )


def actions(spark: SparkSession, sf_dir: str, a: DataFrame | None = None) -> DataFrame:
    """View L: 1-3 triage actions per triage row, key (ticket_id, seq)."""
    a = triage(spark, sf_dir) if a is None else a
    tid = F.col("ticket_id")
    steps = a.select(tid, "created_at",
                     F.explode(F.sequence(F.lit(1), (1 + tid % 3).cast("int"))).alias("seq"))
    kind = (tid + F.col("seq")) % 3
    return steps.select(
        tid, F.col("seq"),
        F.when(kind == 0, "accept").when(kind == 1, "reassign").otherwise("escalate").alias("action"),
        F.when(kind == 1, F.lit("ACCOUNT")).alias("new_department"),
        F.when(tid % 2 == 0, F.concat(F.lit("agent"), F.col("seq").cast("string"))).alias("assigned_to"),
        _hours(F.col("created_at"), F.col("seq")).alias("acted_at"),
    )


def patches(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """Patch rows for every fifth ticket; empty string or NULL means 'no change'."""
    t = tickets(spark, sf_dir) if t is None else t
    tid = F.col("ticket_id")
    return t.where(tid % 5 == 0).select(
        tid,
        F.when(tid % 15 == 0, "Resolved").when(tid % 15 == 5, "").alias("status"),
        F.when(tid % 10 == 0, F.lit("ORDER")).alias("assigned_department"),
        _hours(F.col("created_at"), F.lit(100)).alias("patched_at"),
    )


def probabilities(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """View P: eleven (label, p) rows per ticket, p summing to 1.

    The eleven weights are built as one array per ticket, so the per-ticket
    normaliser is an in-row ``aggregate`` rather than a window over a shuffle.
    """
    t = tickets(spark, sf_dir) if t is None else t
    tid = F.col("ticket_id")
    ks = F.sequence(F.lit(0), F.lit(len(LABELS11) - 1))
    weights = F.transform(
        ks,
        lambda k: 1 + (tid * (k + 3)) % 97
        + F.when(tid % 11 == k, ((tid * 37) % 1000) * 6).otherwise(0),
    )
    w = t.select(tid, weights.alias("w"))
    w = w.select(tid, "w", F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))
    labels = F.array(*[F.lit(x) for x in LABELS11])
    return w.select(
        tid,
        F.posexplode(F.arrays_zip(labels.alias("label"), F.col("w").alias("wt"))).alias("k", "lw"),
        "total",
    ).select(tid, F.col("lw.label").alias("label"),
             (F.col("lw.wt").cast("double") / F.col("total")).alias("p"))


def corpus(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """View X: labelled corpus (id, instruction, intent, category)."""
    t = tickets(spark, sf_dir) if t is None else t
    return t.select(F.col("ticket_id").alias("id"), F.col("description").alias("instruction"),
                    F.col("true_intent").alias("intent"), F.col("true_category").alias("category"))
