"""Own sentences covering every routing, rule-path and greeting branch."""

import pytest
from pyspark.sql import functions as F

from deskflow.functions import routing as R
from deskflow.functions import text as X
from deskflow.operators import score as S

ROUTER_CASES = [
    ("My parcel shipment is late", "Logistics Department"),                 # single winner
    ("A coupon for my membership", "Subscription Team"),                    # tie, no signal: first in list
    ("A timeout at the bank", "Technical Support"),                         # tie with technical signal
    ("An error with my bank card payment", "Payment Department"),           # signal but lower score
    ("zzz qqq", "Customer Service"),                                        # no hit
    ("The item is unavailable", "Inventory Team"),                          # substring inside a word
    ("The app got a software update", "Technical Support"),                 # plain highest score
    ("I forgot my password and my account is locked", "Account Support"),
    ("Someone hacked me, this is fraud", "Security Team"),
]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ticket_id long, description string")


def test_router(spark):
    df = _frame(spark, [t for t, _ in ROUTER_CASES])
    got = {r.ticket_id: r.department for r in S.route_departments(df).collect()}
    for i, (text, want) in enumerate(ROUTER_CASES):
        assert got[i] == want, text


RULE_CASES = [  # text, category, confidence, risk level
    ("hello there", "CONTACT", 0.3, "High"),
    ("my password", "ACCOUNT", 0.3333, "High"),
    ("password and login", "ACCOUNT", 0.6667, "Medium"),
    ("account login password locked", "ACCOUNT", 0.9, "Low"),
    ("Please send my invoice", "BILLING", 0.3333, "High"),   # 'send' hits 'end': tie, BILLING first
]


def test_rule_path(spark):
    df = _frame(spark, [c[0] for c in RULE_CASES])
    got = {r.ticket_id: r for r in S.score_tickets(df).collect()}
    for i, (text, cat, conf, risk) in enumerate(RULE_CASES):
        r = got[i]
        assert (r.category, r.confidence, r.risk_level) == (cat, conf, risk), text
        assert r.intent == cat.lower() + "_general"
        assert r.risk_score == round(1 - {0.3333: 1 / 3, 0.6667: 2 / 3}.get(conf, conf), 4)


@pytest.mark.parametrize("text,urgency,priority", [
    ("nothing special", 0, "Low"), ("urgent", 1, "Medium"), ("urgent asap", 2, "High"),
    ("urgent asap emergency", 3, "Critical"), ("urgent asap emergency, help me right now", 5, "Critical"),
])
def test_urgency_priority(spark, text, urgency, priority):
    r = _frame(spark, [text]).select(X.urgency_score("description").alias("u")).first()
    assert r.u == urgency
    assert S.score_tickets(_frame(spark, [text])).first().priority == priority


@pytest.mark.parametrize("text,label", [
    ("thank you, great and kind help", "Positive"), ("angry frustrated terrible", "Negative"), ("ok", "Neutral"),
    ("good but bad", "Neutral"),
])
def test_sentiment_score_label(spark, text, label):
    assert S.score_tickets(_frame(spark, [text])).first().sentiment_label == label


@pytest.mark.parametrize("text,backend,ui", [
    ("hi", True, True), ("Hi there", True, True), ("hiking trip", False, False), ("  hello  ", True, True),
    ("hey,", False, True), ("greetings!", False, True), ("howdy", True, True), ("good morning team", True, True),
])
def test_greetings(spark, text, backend, ui):
    r = _frame(spark, [text]).select(X.is_greeting("description").alias("b"), X.is_greeting_ui("description").alias("u")).first()
    assert (r.b, r.u) == (backend, ui)


@pytest.mark.parametrize("text,category", [
    ("The app crashes when I pay my invoice", "Technical Support"),
    ("login error", "Technical Support"),          # tie: Technical Support first
    ("billing account", "PAYMENT"),                # tie: PAYMENT before ACCOUNT
    ("nothing to see", "ORDER"),                   # no hit: category kept
])
def test_keyword_override(spark, text, category):
    r = _frame(spark, [text]).select(R.keyword_override("description", F.lit("ORDER")).alias("c")).first()
    assert r.c == category


def test_intent_fallback(spark):
    df = spark.createDataFrame([("Refund Department",), ("CANCEL",), ("Some New Team",)], "d string")
    got = [r.i for r in df.select(R.intent_from_department(F.col("d")).alias("i")).collect()]
    assert got == ["request_refund", "cancel_request", "some_new_team_request"]


def test_validate_input(spark):
    from deskflow.operators.tickets import validate_input
    df = spark.createDataFrame([(1, "hi"), (2, "hello there"), (3, "x" * 2001), (4, None)], "id long, description string")
    acc, rej = validate_input(df)
    assert [r.id for r in acc.collect()] == [2]
    assert acc.first().customer_name == "Anonymous" and acc.first().channel == "Chatbot"
    assert {r.id: r.reason for r in rej.collect()} == {1: "too_short", 3: "too_long", 4: "missing"}
