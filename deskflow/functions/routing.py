"""Routing, arbitration and risk as column expressions (#36-#47).

Every rule is a projection over one ticket row: hit counts are
``size(filter(<literal keyword array>, k -> instr(text, k) > 0))`` and
"first label in list order wins a tie" is a ``when`` chain over the maximum.
Nothing here shuffles or calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .formatting import let, py_round
from .text import any_contained, count_contained, lower_text


def first_max_label(labels: list[str], scores: list[Column]) -> tuple[Column, Column]:
    """(label, score) of the highest score; ties go to the earliest label."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    label = None
    for lab, s in zip(labels, scores):
        label = F.when(s == best, F.lit(lab)) if label is None else label.when(s == best, F.lit(lab))
    return label, best


def department_hits(text) -> dict[str, Column]:
    """#36 wide form: hit count per routing department (substring, distinct entries)."""
    low = lower_text(text)
    return {dept: count_contained(low, kws) for dept, kws in L.ROUTING_RULES}


def department_hits_from(lowered: Column) -> list[Column]:
    """#36 counts over an already lower-cased text column, in department order."""
    return [count_contained(lowered, kws) for _, kws in L.ROUTING_RULES]


def department_hit_columns() -> list[str]:
    return [f"hits_{i}" for i in range(len(L.ROUTING_RULES))]


def tech_signal(lowered: Column) -> Column:
    """Any high-signal technical phrase in the (lower-cased) text."""
    return any_contained(lowered, L.TECH_PRIORITY_KEYWORDS)


def department_router(hits: list[Column], text=None, signal: Column | None = None) -> Column:
    """#37 on precomputed per-department hits (list order of ROUTING_RULES).

    Highest hits wins, ties to the first department; no hits -> Customer Service.
    Technical Support takes precedence when a technical signal phrase is present
    and its hits are at least every rival's. Pass ``hits`` (and ``signal``) as
    column references so each keyword count is evaluated once.
    """
    names = [d for d, _ in L.ROUTING_RULES]
    best_label, best = first_max_label(names, hits)
    tech_i = names.index(L.TECHNICAL_DEPARTMENT)
    tech = hits[tech_i]
    rivals = [h for i, h in enumerate(hits) if i != tech_i]
    rival_max = F.greatest(*rivals)
    if signal is None:
        signal = tech_signal(lower_text(text))
    return (F.when(best == 0, F.lit(L.DEFAULT_DEPARTMENT))
            .when((tech > 0) & signal & (tech >= rival_max), F.lit(L.TECHNICAL_DEPARTMENT))
            .otherwise(best_label))


def routed_hits(department: Column, hits: list[Column]) -> Column:
    """Hits of the keyword list that belongs to ``department`` (0 if it has none)."""
    expr = None
    for (dept, _), h in zip(L.ROUTING_RULES, hits):
        expr = F.when(department == dept, h) if expr is None else expr.when(department == dept, h)
    return expr.otherwise(F.lit(0))


def router_confidence(hits_of_label: Column) -> Column:
    """#40 router branch: round(min(0.95, 0.6 + 0.1 * hits), 4)."""
    return py_round(F.least(F.lit(L.ROUTER_CONFIDENCE_CAP),
                           L.ROUTER_CONFIDENCE_BASE + L.ROUTER_CONFIDENCE_STEP * hits_of_label), 4)


def fallback_counts(lowered: Column) -> list[Column]:
    """#38 hit counts per rule-path category, in list order."""
    return [count_contained(lowered, kws) for _, kws in L.FALLBACK_CATEGORIES]


def fallback_category(text=None, counts: list[Column] | None = None) -> tuple[Column, Column, Column]:
    """#38: (category, confidence, best hits) of the rule-path classifier.

    Pass ``counts`` as column references (from ``fallback_counts``) so that each
    keyword count is evaluated once per row.
    """
    names = [c for c, _ in L.FALLBACK_CATEGORIES]
    scores = counts if counts is not None else fallback_counts(lower_text(text))
    label, best = first_max_label(names, scores)
    category = F.when(best > 0, label).otherwise(F.lit(L.FALLBACK_DEFAULT_CATEGORY))
    confidence = F.when(best > 0, F.least(best / 3.0, F.lit(L.FALLBACK_CONFIDENCE_CAP))) \
                  .otherwise(F.lit(L.FALLBACK_DEFAULT_CONFIDENCE))
    return category, confidence, best


def override_counts(lowered: Column) -> dict[str, Column]:
    """#39 hit counts per override route, keyed by route name."""
    return {name: count_contained(lowered, kws) for name, kws in L.OVERRIDE_ROUTES}


def override_label(counts: dict[str, Column], category: Column) -> Column:
    """#39 on precomputed route counts: best route (tie order Technical Support,
    PAYMENT, ACCOUNT, CONTACT) replaces ``category`` when any list hits."""
    order = L.OVERRIDE_TIE_ORDER
    label, best = first_max_label(order, [counts[n] for n in order])
    return F.when(best > 0, label).otherwise(category)


def keyword_override(text, category: Column) -> Column:
    """#39 straight from text; the text is lowered and each route counted once per row."""
    names = [name for name, _ in L.OVERRIDE_ROUTES]
    counted = let(lower_text(text), lambda low: F.struct(*[c.alias(f"r{i}") for i, c in enumerate(override_counts(low).values())]))
    return let(counted, lambda c: override_label({n: c[f"r{i}"] for i, n in enumerate(names)}, category))


def intent_from_department(department: Column) -> Column:
    """#41: mapped intent, else snake_case(label) + '_request'."""
    m = F.create_map(*[F.lit(x) for pair in L.DEPARTMENT_INTENT for x in pair])
    snake = F.regexp_replace(F.regexp_replace(F.lower(department), "[^a-z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.element_at(m, department), F.concat(snake, F.lit("_request")))


def intent_confidence_from_hits(h: Column) -> Column:
    """#47: round(min(0.99, 0.6 + 0.1 * h), 4) for the hits of the final label's list."""
    return py_round(F.least(F.lit(L.INTENT_CONFIDENCE_CAP),
                            L.ROUTER_CONFIDENCE_BASE + L.ROUTER_CONFIDENCE_STEP * h), 4)


def intent_confidence(department: Column, hits: list[Column]) -> Column:
    """#47 from a label and the twelve hit columns."""
    return intent_confidence_from_hits(routed_hits(department, hits))


def risk_tier(confidence: Column) -> tuple[Column, Column]:
    """#45: conf >= 0.80 Low/0.2; < 0.60 High/0.75; else Medium/0.5."""
    level = (F.when(confidence >= L.RISK_LOW_MIN_CONF, "Low")
             .when(confidence < L.RISK_HIGH_BELOW_CONF, "High").otherwise("Medium"))
    score = (F.when(confidence >= L.RISK_LOW_MIN_CONF, L.RISK_TIER_SCORES["Low"])
             .when(confidence < L.RISK_HIGH_BELOW_CONF, L.RISK_TIER_SCORES["High"])
             .otherwise(L.RISK_TIER_SCORES["Medium"]))
    return level, score


def risk_formula(confidence: Column, gap: Column) -> tuple[Column, Column]:
    """#46: 0.6(1-conf) + 0.4(1-min(2 gap, 1)); > 0.6 High, > 0.35 Medium, else Low."""
    risk = (1 - confidence) * 0.6 + (1 - F.least(gap * 2, F.lit(1.0))) * 0.4
    level = (F.when(risk > L.FORMULA_RISK_HIGH, "High")
             .when(risk > L.FORMULA_RISK_MEDIUM, "Medium").otherwise("Low"))
    return risk, level


def gap_proxy(confidence: Column) -> Column:
    """#44, label replaced: max(0, 2 conf - 1)."""
    return F.greatest(F.lit(0.0), 2.0 * confidence - 1.0)


def top2_gap(values: Column) -> Column:
    """#44, label kept: p1 - p2 of an array of probabilities (1.0 if single)."""
    s = F.sort_array(values, asc=False)
    return F.when(F.size(values) > 1, F.element_at(s, 1) - F.element_at(s, 2)).otherwise(F.lit(1.0))
