"""Number-to-text formatting that matches Python's float formatting exactly.

Java's ``%.1f`` rounds the shortest decimal form half-up, while Python rounds the
exact binary value half-to-even (51.25 -> '51.2', 45.65 -> '45.6'). Percentages
shown to people are produced here with Python's rule, using only arithmetic
expressions (error-free sums), so they stay JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _side_of_midpoint(v: Column, m: Column) -> Column:
    """sign(v - m/20) computed exactly for a double v and an odd integer m.

    20 v = 16 v + 4 v; both products are exact, the sum is split into s + e
    with an error-free two-sum, so the comparison never rounds.
    """
    a = v * 16.0
    b = v * 4.0
    s = a + b
    bb = s - a
    e = (a - (s - bb)) + (b - bb)
    d = s - m
    return F.when(d != 0, F.signum(d)).otherwise(F.signum(e))


def tenths_half_even(v: Column) -> Column:
    """round(v, 1) * 10 as a long, ties to even on the exact binary value (v >= 0)."""
    t0 = F.floor(v * 10.0 + 0.5).cast("double")
    lo = _side_of_midpoint(v, 2.0 * t0 - 1.0)
    hi = _side_of_midpoint(v, 2.0 * t0 + 1.0)
    even_lo = F.when((t0 - 1.0) % 2.0 == 0.0, t0 - 1.0).otherwise(t0)
    even_hi = F.when(t0 % 2.0 == 0.0, t0).otherwise(t0 + 1.0)
    t = (F.when(lo < 0, t0 - 1.0).when(hi > 0, t0 + 1.0)
         .when(lo == 0, even_lo).when(hi == 0, even_hi).otherwise(t0))
    return t.cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a bound variable.

    The exact-rounding expressions below use their input dozens of times. Bound
    through a one-element ``transform``, an input that Catalyst later inlines
    (for example when a filter is pushed below the projection defining it) is
    still copied only once instead of dozens of times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def percent_1dp(fraction: Column) -> Column:
    """Python's f"{x:.1%}" for 0 <= x: e.g. 0.3333 -> '33.3%'."""
    def body(v):
        t = tenths_half_even(v * 100.0)
        return F.concat((t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%"))
    return let(fraction.cast("double"), body)


# 2**27 + 1: splits a double into two halves whose products are exact (Dekker).
_SPLITTER = 134217729.0


def _sign_of_product_minus(v: Column, b: float, m: Column) -> Column:
    """sign(v * b - m) computed exactly; ``b`` a small integer (< 2**26)."""
    p = v * b
    c = v * _SPLITTER
    vh = c - (c - v)
    vl = v - vh
    e = (vh * b - p) + vl * b  # v * b == p + e exactly
    d = p - m
    return F.when(d != 0, F.signum(d)).otherwise(F.signum(e))


def py_round(x: Column, digits: int = 4) -> Column:
    """Python's ``round(x, digits)`` for doubles: the exact binary value is
    rounded half-to-even. Spark's ``round`` rounds the shortest decimal text
    half-up instead (0.01075 -> 0.0108, Python gives 0.0107).

    Calls a SQL function registered once per session (see ``_SQL_FUNCTIONS``);
    Spark inlines its body, so it runs as generated code with no Python.
    """
    _ensure_functions()
    return F.call_function(f"deskflow_py_round{digits}", x.cast("double"))


def py_round_columns(x: Column, digits: int = 4) -> Column:
    """The same rule built from Column operations (reference implementation)."""
    s = float(10 ** digits)
    v = x.cast("double")
    t = F.abs(v) * s
    near_mid = F.abs(t - F.floor(t) - 0.5) <= 1e-6
    fast = F.signum(v) * (F.rint(t) / s) + 0.0
    return F.when(near_mid, let(v, lambda w: _py_round_body(w, digits))).otherwise(fast)


def _sql_exact_round(v: str, digits: int) -> str:
    s = f"{float(10 ** digits)!r}D"
    b = f"{float(2 * 10 ** digits)!r}D"
    a = f"abs({v})"
    t0 = f"CAST(floor({a} * {s} + 0.5D) AS DOUBLE)"

    def side(m: str) -> str:
        p = f"({a} * {b})"
        c = f"({a} * 134217729.0D)"
        vh = f"({c} - ({c} - {a}))"
        vl = f"({a} - {vh})"
        e = f"(({vh} * {b} - {p}) + {vl} * {b})"
        d = f"({p} - ({m}))"
        return f"(CASE WHEN {d} <> 0 THEN signum({d}) ELSE signum({e}) END)"

    lo, hi = side(f"2.0D * {t0} - 1.0D"), side(f"2.0D * {t0} + 1.0D")
    t = (f"(CASE WHEN {lo} < 0 THEN {t0} - 1.0D WHEN {hi} > 0 THEN {t0} + 1.0D "
         f"WHEN {lo} = 0 THEN (CASE WHEN ({t0} - 1.0D) % 2.0D = 0 THEN {t0} - 1.0D ELSE {t0} END) "
         f"WHEN {hi} = 0 THEN (CASE WHEN {t0} % 2.0D = 0 THEN {t0} ELSE {t0} + 1.0D END) ELSE {t0} END)")
    return f"(signum({v}) * ({t} / {s}) + 0.0D)"


def _sql_py_round(digits: int) -> str:
    s = f"{float(10 ** digits)!r}D"
    near = f"abs(abs(x) * {s} - floor(abs(x) * {s}) - 0.5D) <= 1e-6D"
    exact = f"element_at(transform(array(x), v -> {_sql_exact_round('v', digits)}), 1)"
    fast = f"signum(x) * (rint(abs(x) * {s}) / {s}) + 0.0D"
    return f"CASE WHEN x IS NULL THEN CAST(NULL AS DOUBLE) WHEN {near} THEN {exact} ELSE {fast} END"


# SQL functions registered in every session that uses them (name -> signature, body).
_SQL_FUNCTIONS = {
    **{f"deskflow_py_round{d}": ("x DOUBLE", "DOUBLE", _sql_py_round(d)) for d in (1, 2, 4, 6)},
}
_REGISTERED = "deskflow.functions.registered"


def _ensure_functions() -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    if spark.conf.get(_REGISTERED, None) == "true":  # a new session starts without settings and without functions
        return
    for name, (args, ret, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    spark.conf.set(_REGISTERED, "true")


def _py_round_body(x: Column, digits: int) -> Column:
    s = float(10 ** digits)
    a = F.abs(x)
    t0 = F.floor(a * s + 0.5).cast("double")
    lo = _sign_of_product_minus(a, 2 * s, 2.0 * t0 - 1.0)
    hi = _sign_of_product_minus(a, 2 * s, 2.0 * t0 + 1.0)
    even_lo = F.when((t0 - 1.0) % 2.0 == 0.0, t0 - 1.0).otherwise(t0)
    even_hi = F.when(t0 % 2.0 == 0.0, t0).otherwise(t0 + 1.0)
    t = (F.when(lo < 0, t0 - 1.0).when(hi > 0, t0 + 1.0)
         .when(lo == 0, even_lo).when(hi == 0, even_hi).otherwise(t0))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.signum(x) * (t / s) + 0.0)
