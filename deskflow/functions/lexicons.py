"""Word lists, label maps and thresholds used by scoring and reporting.

FIXED VALUES. Everything below must equal the behaviour being reproduced
(keyword lists, their order, label names, thresholds). Lists are kept in
their natural order because order decides ties: the first label in a list
wins a tie on hit counts. Nothing here is derived; edit only to change
behaviour on purpose.
"""

from __future__ import annotations

# --- FIXED VALUES: engineered-feature lexicons -------------------------------

URGENCY_KEYWORDS = [
    "urgent", "immediately", "asap", "emergency", "critical",
    "right now", "help me", "desperate", "not working", "broken",
    "cannot", "can't", "unable", "failed", "error", "crash",
]

NEGATIVE_WORDS = [
    "angry", "frustrated", "terrible", "worst", "horrible", "hate",
    "disappointed", "unacceptable", "ridiculous", "waste", "scam",
    "refuse", "complaint", "problem", "issue", "wrong", "bad",
]

POSITIVE_WORDS = [
    "thank", "please", "appreciate", "great", "good", "help",
    "kind", "wonderful", "excellent", "love", "happy", "satisfied",
]

# --- FIXED VALUES: whole-word sentiment sets ----------------------------------

SENTIMENT_POSITIVE_SET = [
    "good", "great", "excellent", "amazing", "love", "happy", "satisfied",
    "awesome", "perfect", "wonderful", "thank", "thanks", "nice", "best",
    "fantastic", "pleased", "recommend",
]

SENTIMENT_NEGATIVE_SET = [
    "bad", "terrible", "awful", "hate", "worst", "horrible", "angry",
    "frustrated", "disappointed", "unacceptable", "broken", "error", "fail",
    "failed", "crash", "slow", "scam", "fraud", "hacked", "unauthorized",
    "stolen", "issue", "problem", "complaint", "urgent", "delay", "late",
    "damaged", "not working", "cannot", "unable", "wrong", "poor",
]

# --- FIXED VALUES: keyword priority -------------------------------------------

HIGH_PRIORITY_KEYWORDS = [
    "fraud", "security", "hacked", "unauthorized", "otp",
    "deducted", "not delivered", "urgent", "immediately",
    "legal", "lawsuit", "scam",
]

MEDIUM_PRIORITY_KEYWORDS = [
    "refund", "cancel", "not working", "crash", "error",
    "delay", "late", "damaged",
]

# --- FIXED VALUES: department routing rules (order = tie order) ---------------

ROUTING_RULES: list[tuple[str, list[str]]] = [
    ("Payment Department", [
        "payment", "transaction", "card", "bank", "charged",
        "billing", "invoice", "deducted",
        "payment failed", "payment declined", "overcharged",
        "charged twice", "duplicate charge", "billing issue",
        "receipt", "charged incorrectly", "subscription fee",
        "transaction amount", "extra charge", "unexpected charge",
        "bank charge", "wrong amount", "incorrect amount",
        "charge dispute", "unauthorized charge", "double charged",
        "double billing", "payment error", "billing statement",
        "amount deducted", "money taken", "billed",
        "auto-deducted", "charged extra", "charged the wrong amount",
        "refunded", "credit",
    ]),
    ("Refund Department", [
        "refund", "return", "money back", "reimbursement", "cancel charge",
        "get my money back", "request refund", "want a refund",
        "refund request", "reimburse",
    ]),
    ("Logistics Department", [
        "delivery", "shipment", "package", "shipping",
        "not delivered", "late delivery", "damaged",
        "lost package", "tracking", "courier", "dispatch",
        "delivery status", "wrong address",
    ]),
    ("Technical Support", [
        "bug", "error", "software", "update", "not working",
        "crash", "crashes", "freezes", "frozen", "hangs",
        "app", "application", "application issue", "application problem",
        "website", "website issue", "website problem",
        "not loading", "unable to load", "failed to load", "loading issue",
        "page not loading", "page error",
        "system error", "server error", "system problem", "system down",
        "service unavailable", "connection error", "timeout",
        "technical issue", "technical problem",
        "slow response", "unexpected error",
        "broken", "cannot open", "fails to load", "not responding",
        "keeps crashing", "blank screen", "404", "500 error",
        "latency", "glitch", "unresponsive", "not syncing",
        "failed to connect", "sync error", "app issue", "platform issue",
        "keeps failing", "not launching", "software error",
        "application error", "app error", "system failure",
        "internal error", "database error", "interface error",
    ]),
    ("Account Support", [
        "login", "account", "password", "username", "access", "credential",
        "sign in", "logged out", "locked", "suspended",
        "cannot access", "reset password", "forgotten password",
        "account blocked", "account frozen", "account disabled",
        "access denied", "sign-in", "log in", "cannot log in",
        "account suspended", "account locked",
        "profile", "my account", "account details", "change email",
        "2fa", "mfa", "two-factor", "account recovery",
        "verify account", "forgot password", "account issue",
        "cannot sign in", "unable to login", "unable to log in",
    ]),
    ("Security Team", [
        "authentication", "otp", "two factor", "security",
        "verification", "fraud", "unauthorized", "hacked",
        "suspicious", "data breach", "identity theft",
    ]),
    ("Subscription Team", [
        "subscription", "plan", "membership",
        "cancel subscription", "upgrade", "downgrade",
        "renew", "auto-renewal", "billing cycle",
    ]),
    ("Product Team", [
        "product", "quality", "feature", "missing feature",
        "feature request", "product defect", "product issue",
    ]),
    ("Inventory Team", [
        "stock", "available", "inventory", "out of stock",
        "availability", "restock", "back in stock",
    ]),
    ("Order Management", [
        "order", "cancel order", "order status",
        "order confirmation", "wrong item", "missing item",
    ]),
    ("Promotions Team", [
        "coupon", "discount", "offer", "promo",
        "voucher", "promotional", "deal",
    ]),
    ("Customer Service", [
        "complaint", "issue", "problem", "help",
        "contacted support", "no response", "support request",
        "unresolved complaint", "waiting for response", "support team",
        "haven't heard back", "follow up", "no reply", "still waiting",
        "previous ticket", "raised a ticket", "escalate complaint",
        "ticket open", "reach out",
        "no one replied", "reached out", "still no update",
        "follow-up request", "been waiting", "nobody responded",
        "open request", "pending ticket", "contact support",
        "get in touch", "no update", "never responded",
        "still unresolved", "submitted a ticket", "already contacted",
    ]),
]

DEFAULT_DEPARTMENT = "Customer Service"
TECHNICAL_DEPARTMENT = "Technical Support"

# FIXED VALUES: a text with one of these goes to the technical team unless another list hits more often.
TECH_PRIORITY_KEYWORDS = [
    "crash", "crashes", "freezes", "frozen", "hangs",
    "not loading", "unable to load", "failed to load", "loading issue",
    "page not loading", "page error",
    "system error", "server error", "system down",
    "service unavailable", "connection error", "timeout",
    "technical issue", "technical problem", "system problem",
    "application issue", "application problem",
    "website issue", "website problem",
    "slow response", "unexpected error",
    "not working", "error", "bug",
]

# --- FIXED VALUES: rule-path categories (order = tie order) -------------------

FALLBACK_CATEGORIES: list[tuple[str, list[str]]] = [
    ("ACCOUNT", ["account", "login", "password", "credential", "access", "locked", "suspended"]),
    ("BILLING", ["bill", "charge", "payment", "invoice", "price", "refund", "money"]),
    ("CANCELLATION", ["cancel", "unsubscribe", "terminate", "end", "stop"]),
    ("DELIVERY", ["deliver", "ship", "track", "order", "package"]),
    ("FEEDBACK", ["suggest", "feature", "improve", "feedback", "recommendation"]),
    ("ORDER", ["order", "purchase", "buy", "checkout", "cart"]),
    ("REFUND", ["refund", "return", "money back", "reimburse"]),
    ("SHIPPING", ["shipping", "delivery", "courier", "package"]),
    ("CONTACT", ["contact", "reach", "speak", "call", "email"]),
    ("NEWSLETTER", ["newsletter", "email", "unsubscribe", "subscribe"]),
]
FALLBACK_DEFAULT_CATEGORY = "CONTACT"
FALLBACK_DEFAULT_CONFIDENCE = 0.3
FALLBACK_CONFIDENCE_CAP = 0.9

# --- FIXED VALUES: keyword override of the model category ---------------------

OVERRIDE_ROUTES: list[tuple[str, list[str]]] = [
    ("PAYMENT", [
        "charged", "deducted", "payment", "billing", "invoice",
        "duplicate charge", "refund", "payment failed",
        "payment declined", "overcharged", "charged twice",
        "billing issue", "receipt", "charged incorrectly",
        "subscription fee", "transaction amount",
        "extra charge", "unexpected charge",
        "bank charge", "wrong amount", "incorrect amount",
        "charge dispute", "unauthorized charge", "double charged",
        "double billing", "payment error", "billing statement",
        "amount deducted", "money taken", "billed",
        "auto-deducted", "charged extra", "charged the wrong amount",
        "refunded", "credit",
    ]),
    ("ACCOUNT", [
        "account", "password", "login", "logged out", "account access",
        "locked", "suspended", "logs out", "sign in", "sign-in",
        "cannot access account", "reset password", "forgotten password",
        "account blocked", "account frozen", "account disabled",
        "access denied", "cannot log in", "account suspended",
        "account locked", "credential", "username",
        "profile", "my account", "account details", "change email",
        "2fa", "mfa", "two-factor", "account recovery",
        "verify account", "forgot password", "account issue",
        "cannot sign in", "unable to login", "unable to log in",
    ]),
    ("CONTACT", [
        "contacted support", "no response", "unresolved complaint",
        "support request", "waiting for response", "support team",
        "haven't heard back", "follow up", "no reply", "still waiting",
        "previous ticket", "raised a ticket", "escalate complaint",
        "ticket open", "reach out to support",
        "no one replied", "reached out", "still no update",
        "follow-up request", "been waiting", "nobody responded",
        "open request", "pending ticket", "contact support",
        "no update", "never responded", "still unresolved",
        "submitted a ticket", "already contacted",
    ]),
    ("Technical Support", [
        "bug", "crash", "crashes", "error", "application", "app",
        "website", "software", "not working", "not loading",
        "server error", "freezes", "frozen", "timeout", "system error",
        "system down", "service unavailable", "connection error",
        "page error", "loading issue", "unexpected error",
        "technical issue", "broken", "cannot open", "fails to load",
        "not responding", "keeps crashing", "blank screen",
        "500 error", "404", "latency", "glitch", "unresponsive",
        "not syncing", "failed to connect", "sync error",
        "app issue", "platform issue", "keeps failing",
        "not launching", "software error", "application error",
        "system failure", "hangs", "page not loading",
        "unable to load", "failed to load",
    ]),
]
# Tie order of the override (differs from the list order above).
OVERRIDE_TIE_ORDER = ["Technical Support", "PAYMENT", "ACCOUNT", "CONTACT"]

# --- FIXED VALUES: intent per department --------------------------------------

DEPARTMENT_INTENT: list[tuple[str, str]] = [
    ("Refund Department", "request_refund"),
    ("Payment Department", "payment_issue"),
    ("Account Support", "account_access"),
    ("Security Team", "security_concern"),
    ("Subscription Team", "subscription_management"),
    ("Technical Support", "technical_issue"),
    ("Product Team", "feature_request"),
    ("Logistics Department", "delivery_issue"),
    ("Inventory Team", "inventory_issue"),
    ("Order Management", "order_issue"),
    ("Promotions Team", "promotion_issue"),
    ("Customer Service", "general_inquiry"),
    ("ACCOUNT", "account_access"),
    ("REFUND", "request_refund"),
    ("Payment Problem", "payment_issue"),
    ("Security Concern", "security_concern"),
    ("Subscription Cancellation", "subscription_management"),
    ("Performance Issue", "technical_issue"),
    ("Feature Request", "feature_request"),
    ("Account Suspension", "account_access"),
]

# --- FIXED VALUES: greetings ---------------------------------------------------

GREETINGS = [
    "hi", "hello", "hey", "good morning", "good afternoon", "good evening",
    "howdy", "greetings",
]
# Backend prefix form: greeting followed by a space (six of the eight).
GREETING_PREFIXES = [
    "hi ", "hello ", "hey ", "good morning ", "good afternoon ", "good evening ",
]
# Chat-window form: any greeting followed by one of these characters.
UI_GREETING_SEPARATORS = [" ", ",", "!"]

# --- FIXED VALUES: thresholds and texts ---------------------------------------

MODEL_CONFIDENCE_MIN = 0.5          # model label kept at or above
ROUTER_CONFIDENCE_BASE = 0.6
ROUTER_CONFIDENCE_STEP = 0.1
ROUTER_CONFIDENCE_CAP = 0.95
INTENT_CONFIDENCE_CAP = 0.99
RISK_LOW_MIN_CONF = 0.80            # >= -> Low risk, score 0.2
RISK_HIGH_BELOW_CONF = 0.60         # <  -> High risk, score 0.75; else Medium 0.5
RISK_TIER_SCORES = {"Low": 0.2, "Medium": 0.5, "High": 0.75}
AMBIGUITY_MIN_GAP = 0.15
FORMULA_RISK_HIGH = 0.6
FORMULA_RISK_MEDIUM = 0.35
CATEGORY_CONFIDENCE_THRESHOLD = 0.5
INTENT_CONFIDENCE_THRESHOLD = 0.4
TEXT_MIN_CHARS = 5
TEXT_MAX_CHARS = 2000

TRIAGE_DEFAULT_REASON = "High risk score"
TRIAGE_CHAT_REASON = "High misrouting risk detected"
TRIAGE_AMBIGUOUS_REASON = "Ambiguous: multiple categories likely"
TRIAGE_NEGATIVE_REASON = "Very negative sentiment detected"

CHAT_REPLY_APOLOGY = (
    "I understand how frustrating this must be. "
    "I've created a support ticket for you, and our team will look into this right away."
)
CHAT_REPLY_THANKS = (
    "Thank you for reaching out! "
    "I've created a support ticket for you. Our team will review it shortly. "
    "Is there anything else I can help with?"
)
CHAT_REPLY_NEUTRAL = (
    "I've created a support ticket for you. "
    "Our support team will review it and take the necessary action."
)


# FIXED VALUE: channel of tickets that the chat opens.
CHAT_CHANNEL = "Chatbot"
