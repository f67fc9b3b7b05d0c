"""Dashboard and analytics reports over the ticket and triage tables (#62-#75).

Every report is one aggregation pass (partial aggregation before the shuffle)
or a per-row projection. Distributions for several dimensions are computed in
a single pass by unpivoting each row into (dimension, value) pairs; top-k uses
``orderBy().limit()`` which Spark runs as a per-partition top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import py_round

DIMENSIONS = {
    "status": "status",
    "category": "predicted_category",
    "priority": "predicted_priority",
    "risk": "risk_level",
    "channel": "channel",
}


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(x + 0.5)


def distributions(t: DataFrame, dims: dict[str, str] | None = None) -> DataFrame:
    """#62: (dimension, value, count) for several columns in one pass."""
    dims = dims or DIMENSIONS
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("value"))
                      for name, col in dims.items()])
    return t.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))


def distribution(t: DataFrame, col: str) -> DataFrame:
    """#62 for one column: value and count."""
    return t.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def avg_confidence(t: DataFrame) -> DataFrame:
    """#63: mean confidence, NULL -> 0, rounded to 4 decimals."""
    return t.agg(F.avg("confidence_score").alias("_a")).select(
        py_round(F.coalesce(F.col("_a"), F.lit(0.0)), 4).alias("avg_confidence"))


def triage_stats(t: DataFrame, triage: DataFrame) -> DataFrame:
    """#64: pending, resolved, total and misrouting rate in one pass.

    Ticket and queue rows are unioned and counted by one aggregate instead of
    joining two one-row aggregates.
    """
    rows = t.select(F.lit(1).alias("_is_ticket"), F.lit(None).cast("string").alias("_q")) \
        .unionByName(triage.select(F.lit(0).alias("_is_ticket"), F.col("status").alias("_q")))
    g = rows.agg(
        F.count_if(F.col("_q") == "Pending").alias("pending_triage"),
        F.count_if(F.col("_q") == "Resolved").alias("resolved_triage"),
        F.sum("_is_ticket").cast("long").alias("total_tickets"),
    )
    rate = F.when(F.col("total_tickets") > 0,
                  (F.col("pending_triage") + F.col("resolved_triage")) / F.col("total_tickets") * 100)
    return g.select("pending_triage", "resolved_triage", F.coalesce(F.col("total_tickets"), F.lit(0)).alias("total_tickets"),
                    py_round(F.coalesce(rate, F.lit(0.0)), 2).alias("misrouting_rate"))


def recent_tickets(t: DataFrame, n: int = 10) -> DataFrame:
    """#65: the ``n`` newest tickets (top-k, no global sort)."""
    return t.orderBy(F.desc("created_at"), F.desc("ticket_id")).limit(n)


def analytics_summary(t: DataFrame, triage: DataFrame) -> DataFrame:
    """#66: one report row: totals, the five distributions as maps, average
    confidence, triage counts, misrouting rate and the ten newest tickets.

    The five distributions come from one grouped pass; each map holds one
    entry per distinct label, so the final one-row fold is bounded by the label
    counts, not by the table size.
    """
    d = distributions(t)
    maps = d.groupBy().agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("dimension") == name, F.struct(
            F.coalesce(F.col("value"), F.lit("null")), F.col("count"))))).alias(f"{name}_distribution")
        for name in DIMENSIONS])
    stats = triage_stats(t, triage)
    st = stats.select(F.struct(*stats.columns)).scalar()
    avg = avg_confidence(t).select("avg_confidence").scalar()
    newest = F.struct("created_at", "ticket_id", F.struct(*t.columns).alias("row"))
    recent = recent_tickets(t).select(  # whole rows, at most ten, newest first
        F.transform(F.sort_array(F.collect_list(newest), asc=False), lambda r: r["row"])).scalar()
    # One-row results enter as scalar subqueries: no join between the parts.
    return maps.select(
        st["total_tickets"].alias("total_tickets"), "*", avg.alias("avg_confidence"),
        st["pending_triage"].alias("pending_triage"), st["resolved_triage"].alias("resolved_triage"),
        st["misrouting_rate"].alias("misrouting_rate"), recent.alias("recent_tickets"))


def kpi_cards(t: DataFrame) -> DataFrame:
    """#67: dashboard KPI cards over the (filtered) ticket table, one pass."""
    human = F.coalesce(F.col("requires_human"), F.lit(0)) if "requires_human" in t.columns else F.lit(0)
    resolved = (F.col("status") == "Resolved") & F.col("created_at").isNotNull() & F.col("resolved_at").isNotNull()
    ms = F.timestamp_diff("MILLISECOND", F.col("created_at"), F.col("resolved_at"))
    g = t.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(F.col("status") == "Open").alias("open_tickets"),
        F.count_if((human != 0) | (F.coalesce(F.col("is_triage"), F.lit(0)) != 0)).alias("triage_tickets"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_tickets"),
        F.sum(F.coalesce(F.col("confidence_score"), F.lit(0.0))).alias("_conf_sum"),
        F.sum(F.when(resolved, ms)).alias("_ms"),
        F.count_if(resolved).alias("_n_resolved"),
    )
    return g.select(
        "total_tickets", "open_tickets", "triage_tickets", "high_risk_tickets",
        F.when(F.col("total_tickets") > 0, js_round(F.col("_conf_sum") / F.col("total_tickets") * 100))
         .otherwise(0).cast("long").alias("avg_confidence_pct"),
        F.when(F.col("_n_resolved") > 0, js_round(F.col("_ms") / F.col("_n_resolved") / 3600000.0))
         .otherwise(0).cast("long").alias("avg_resolution_hours"),
    )


def _or(column: str, default: str) -> Column:
    """The value, or ``default`` where it is NULL or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def top_departments(t: DataFrame, k: int = 6) -> DataFrame:
    """#68: the k largest departments (NULL or '' -> Unknown). Ties keep first-seen
    order of a newest-first listing: the label seen most recently comes first."""
    g = t.groupBy(_or("predicted_category", "Unknown").alias("department")).agg(
        F.count(F.lit(1)).alias("count"), F.max(F.struct("created_at", "ticket_id")).alias("_seen"))
    return g.orderBy(F.desc("count"), F.desc("_seen")).limit(k).drop("_seen")


def status_share(t: DataFrame) -> DataFrame:
    """#69: count per status (NULL or '' -> Unknown) and its rounded percent share."""
    g = t.groupBy(_or("status", "Unknown").alias("status")).agg(
        F.count(F.lit(1)).alias("count"))
    total = t.select(F.count(F.lit(1))).scalar()
    return g.select("status", "count", js_round(F.col("count") / total * 100).cast("long").alias("pct"))


RISK_ORDER = ["High", "Medium", "Low"]


def risk_zero_filled(t: DataFrame) -> DataFrame:
    """#70: counts for High, Medium, Low, all three always present; NULL and ''
    count as Low, other labels are dropped. One conditional aggregate, then unpivot."""
    r = _or("risk_level", "Low")
    g = t.agg(*[F.count_if(r == lvl).alias(lvl) for lvl in RISK_ORDER])
    rows = F.array(*[F.struct(F.lit(lvl).alias("risk_level"), F.col(lvl).alias("count"), F.lit(i).alias("ord"))
                     for i, lvl in enumerate(RISK_ORDER)])
    return g.select(F.inline(rows))


def confidence_band(conf: Column) -> tuple[Column, Column]:
    """#71: (rounded percent, band): >= 70 success, >= 45 warning, else danger."""
    pct = js_round(F.coalesce(conf, F.lit(0.0)) * 100).cast("long")
    band = F.when(pct >= 70, "success").when(pct >= 45, "warning").otherwise("danger")
    return pct, band


def distinct_departments(t: DataFrame) -> DataFrame:
    """#72: distinct department labels, neither NULL nor empty."""
    return t.where(F.coalesce("predicted_category", F.lit("")) != "").select("predicted_category").distinct()


def ticket_timeline(t: DataFrame) -> DataFrame:
    """#73: 1-3 events per ticket: created; updated when it differs; resolved when set."""
    ev = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("Ticket Created").alias("event"), F.col("created_at").alias("at")),
        F.struct(F.lit(2).alias("step"), F.lit("Last Updated").alias("event"),
                 F.when(F.col("updated_at") != F.col("created_at"), F.col("updated_at")).alias("at")),
        F.struct(F.lit(3).alias("step"), F.lit("Resolved").alias("event"), F.col("resolved_at").alias("at")),
    )
    return t.select("ticket_id", F.inline(ev)).where((F.col("step") == 1) | F.col("at").isNotNull())


def format_date(ts: Column) -> Column:
    """Display date like '05 Jan 2024, 03:07 pm'; '-' when missing."""
    return F.when(ts.isNull(), F.lit("-")).otherwise(
        F.concat(F.date_format(ts, "dd MMM yyyy, hh:mm "), F.lower(F.date_format(ts, "a"))))


def ticket_display(t: DataFrame) -> DataFrame:
    """#74: table row as shown: TN-0001 code, 50-character description with
    '...', Yes/No triage flag, resolution fallback chain, formatted date."""
    sid = F.col("ticket_id").cast("string")
    code = F.concat(F.lit("TN-"), F.when(F.length(sid) < 4, F.lpad(sid, 4, "0")).otherwise(sid))
    d = F.col("description")
    desc = (F.when(d.isNull() | (d == ""), F.lit("-"))
            .when(F.length(d) > 50, F.concat(F.substring(d, 1, 50), F.lit("..."))).otherwise(d))
    human = F.coalesce(F.col("requires_human"), F.lit(0)) if "requires_human" in t.columns else F.lit(0)
    flag = F.when((human != 0) | (F.coalesce(F.col("is_triage"), F.lit(0)) != 0), "Yes").otherwise("No")
    res = F.coalesce(F.nullif(F.col("resolution"), F.lit("")), F.nullif(F.col("resolution_notes"), F.lit("")),
                     F.lit("-"))
    return t.select("ticket_id", code.alias("code"), desc.alias("description_short"), flag.alias("human_triage"),
                    res.alias("resolution_shown"), format_date(F.col("created_at")).alias("created_shown"))


def gauge_values(t: DataFrame) -> DataFrame:
    """#75: confidence and risk gauges (0-100, missing/zero risk -> 50) and progress."""
    def clamp(x):
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    conf = clamp(F.coalesce(F.col("confidence_score"), F.lit(0.0)) * 100)
    rs = F.col("risk_score")
    risk = clamp(F.when(rs.isNull() | (rs == 0), F.lit(50.0)).otherwise(rs * 100))
    return t.select("ticket_id", js_round(conf).cast("long").alias("confidence_gauge"),
                    js_round(risk).cast("long").alias("risk_gauge"),
                    F.when(F.col("status") == "Resolved", 100).otherwise(45).alias("progress"))
