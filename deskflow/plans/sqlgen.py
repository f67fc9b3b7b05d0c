"""Small builders for the DuckDB oracle SQL text (never executed by Spark).

The oracle restates each rule in plain SQL so the driver can check the Spark
result independently; these helpers only spell the keyword lists as SQL lists.
"""

from __future__ import annotations

from ..functions import lexicons as L
from ..functions.text import WS_CLASS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def low(expr: str) -> str:
    return f"lower(coalesce({expr}, ''))"


def count_contained(lowered: str, kws: list[str]) -> str:
    return f"CAST(len(list_filter({sql_list(kws)}, lambda k: contains({lowered}, k))) AS INTEGER)"


def any_contained(lowered: str, kws: list[str]) -> str:
    return f"({count_contained(lowered, kws)} > 0)"


def first_max(labels: list[str], scores: list[str]) -> tuple[str, str]:
    best = f"greatest({', '.join(scores)})"
    case = "CASE " + " ".join(f"WHEN {s} = {best} THEN {q(l)}" for l, s in zip(labels, scores)) + " END"
    return case, best


def clean(expr: str) -> str:
    return f"trim(regexp_replace({low(expr)}, '[^a-z]+', ' ', 'g'))"


def words(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{WS_CLASS}+'), "
            f"lambda w: w <> '')")


def strip_ws(expr: str) -> str:
    return f"regexp_replace(coalesce({expr}, ''), '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def feature_sql(t: str) -> dict[str, str]:
    lo = low(t)
    pos = count_contained(lo, L.POSITIVE_WORDS)
    neg = count_contained(lo, L.NEGATIVE_WORDS)
    wc = f"CAST(len({words(t)}) AS INTEGER)"
    letters = f"length(regexp_replace(coalesce({t}, ''), '{WS_CLASS}', '', 'g'))"
    return {
        "text_length": f"CAST(length(coalesce({t}, '')) AS INTEGER)",
        "word_count": wc,
        "avg_word_length": f"(CASE WHEN {wc} > 0 THEN CAST({letters} AS DOUBLE) / {wc} ELSE 0.0::DOUBLE END)",
        "urgency_score": count_contained(lo, L.URGENCY_KEYWORDS),
        "negative_word_count": neg,
        "positive_word_count": pos,
        "sentiment_score": f"({pos} - {neg})",
        "has_question": f"(CASE WHEN contains(coalesce({t}, ''), '?') THEN 1 ELSE 0 END)",
        "exclamation_count": f"CAST(length(coalesce({t}, '')) - length(replace(coalesce({t}, ''), '!', '')) AS INTEGER)",
    }


def priority_from_urgency(u: str) -> str:
    return (f"(CASE WHEN {u} >= 3 THEN 'Critical' WHEN {u} >= 2 THEN 'High' "
            f"WHEN {u} >= 1 THEN 'Medium' ELSE 'Low' END)")


def sentiment_score_label(s: str) -> str:
    return f"(CASE WHEN {s} > 1 THEN 'Positive' WHEN {s} < -1 THEN 'Negative' ELSE 'Neutral' END)"


def sentiment_lexicon(t: str) -> str:
    toks = f"string_split({clean(t)}, ' ')"
    pos = f"len(list_intersect({toks}, {sql_list(L.SENTIMENT_POSITIVE_SET)}))"
    neg = f"len(list_intersect({toks}, {sql_list(L.SENTIMENT_NEGATIVE_SET)}))"
    return f"(CASE WHEN {pos} > {neg} THEN 'Positive' WHEN {neg} > {pos} THEN 'Negative' ELSE 'Neutral' END)"


def priority_from_keywords(t: str) -> str:
    lo = low(t)
    return (f"(CASE WHEN {any_contained(lo, L.HIGH_PRIORITY_KEYWORDS)} THEN 'High' "
            f"WHEN {any_contained(lo, L.MEDIUM_PRIORITY_KEYWORDS)} THEN 'Medium' ELSE 'Low' END)")


def risk_tier_level(c: str) -> str:
    return f"(CASE WHEN {c} >= 0.8 THEN 'Low' WHEN {c} < 0.6 THEN 'High' ELSE 'Medium' END)"


def risk_tier_score(c: str) -> str:
    return f"(CASE WHEN {c} >= 0.8 THEN 0.2::DOUBLE WHEN {c} < 0.6 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END)"


def dept_hits_cols(t: str) -> list[str]:
    lo = low(t)
    return [f"{count_contained(lo, kws)} AS hits_{i}" for i, (_, kws) in enumerate(L.ROUTING_RULES)]


def router_sql(t: str) -> str:
    """Department router over columns hits_0..hits_11 and text ``t``."""
    names = [d for d, _ in L.ROUTING_RULES]
    hits = [f"hits_{i}" for i in range(len(names))]
    label, best = first_max(names, hits)
    ti = names.index(L.TECHNICAL_DEPARTMENT)
    rivals = ", ".join(h for i, h in enumerate(hits) if i != ti)
    signal = any_contained(low(t), L.TECH_PRIORITY_KEYWORDS)
    return (f"(CASE WHEN {best} = 0 THEN {q(L.DEFAULT_DEPARTMENT)} "
            f"WHEN hits_{ti} > 0 AND {signal} AND hits_{ti} >= greatest({rivals}) THEN {q(L.TECHNICAL_DEPARTMENT)} "
            f"ELSE {label} END)")


def routed_hits(dept: str) -> str:
    return ("(CASE " + " ".join(f"WHEN {dept} = {q(d)} THEN hits_{i}" for i, (d, _) in enumerate(L.ROUTING_RULES))
            + " ELSE 0 END)")


def override_sql(t: str, category: str) -> str:
    lo = low(t)
    by = {n: count_contained(lo, kws) for n, kws in L.OVERRIDE_ROUTES}
    order = L.OVERRIDE_TIE_ORDER
    label, best = first_max(order, [by[n] for n in order])
    return f"(CASE WHEN {best} > 0 THEN {label} ELSE {category} END)"


def intent_sql(dept: str) -> str:
    cases = " ".join(f"WHEN {dept} = {q(a)} THEN {q(b)}" for a, b in L.DEPARTMENT_INTENT)
    snake = f"regexp_replace(regexp_replace(lower({dept}), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(CASE {cases} ELSE {snake} || '_request' END)"


def fallback_sql(t: str) -> tuple[str, str, str]:
    """(score columns sql, category expr, confidence expr) over f_0..f_9."""
    lo = low(t)
    cols = ", ".join(f"{count_contained(lo, kws)} AS f_{i}" for i, (_, kws) in enumerate(L.FALLBACK_CATEGORIES))
    names = [c for c, _ in L.FALLBACK_CATEGORIES]
    label, best = first_max(names, [f"f_{i}" for i in range(len(names))])
    cat = f"(CASE WHEN {best} > 0 THEN {label} ELSE 'CONTACT' END)"
    conf = f"(CASE WHEN {best} > 0 THEN least(CAST({best} AS DOUBLE) / 3.0, 0.9::DOUBLE) ELSE 0.3::DOUBLE END)"
    return cols, cat, conf


def percent_1dp(x: str) -> str:
    return f"printf('%.1f%%', ({x}) * 100.0)"


def py_round(x: str, digits: int = 4) -> str:
    """DuckDB text of Python's round(x, digits) on doubles (exact, ties to even)."""
    s = float(10 ** digits)
    a = f"abs(CAST({x} AS DOUBLE))"
    t0 = f"floor({a} * {s} + 0.5)"

    def side(m: str) -> str:
        b = 2 * s
        p = f"({a} * {b})"
        c = f"({a} * 134217729.0)"
        vh = f"({c} - ({c} - {a}))"
        vl = f"({a} - {vh})"
        e = f"(({vh} * {b} - {p}) + {vl} * {b})"
        d = f"({p} - ({m}))"
        return f"(CASE WHEN {d} <> 0 THEN sign({d}) ELSE sign({e}) END)"

    lo, hi = side(f"2.0 * {t0} - 1.0"), side(f"2.0 * {t0} + 1.0")
    t = (f"(CASE WHEN {lo} < 0 THEN {t0} - 1.0 WHEN {hi} > 0 THEN {t0} + 1.0 "
         f"WHEN {lo} = 0 THEN (CASE WHEN ({t0} - 1.0) % 2.0 = 0 THEN {t0} - 1.0 ELSE {t0} END) "
         f"WHEN {hi} = 0 THEN (CASE WHEN {t0} % 2.0 = 0 THEN {t0} ELSE {t0} + 1.0 END) ELSE {t0} END)")
    return f"(sign(CAST({x} AS DOUBLE)) * ({t} / {s}) + 0.0)"
