"""Ticket, triage and chat tables: build, store, list, patch and replay (#4-#8, #52-#61).

Tables are DataFrames keyed by ``ticket_id``. Updates are expressed as
relational last-writer-wins folds (group by key, take the newest value per
column) followed by one join, so a batch of any size is applied in a fixed
number of shuffles and a ticket with very many updates is still folded by
partial aggregation rather than collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..session import checkpoint_dir, scratch_path

ADDED_COLUMNS = [  # (name, type, default) added to older ticket tables
    ("misrouting_risk", "string", None),
    ("route", "string", None),
    ("requires_human", "int", 0),
    ("resolution", "string", None),
]
UPDATED_COLUMNS = [  # what patches and triage actions write to a ticket
    ("status", "string", None), ("assigned_department", "string", None), ("assigned_to", "string", None),
    ("resolution_notes", "string", None), ("resolution", "string", None), ("predicted_priority", "string", None),
    ("is_triage", "int", 0), ("updated_at", "timestamp_ntz", None), ("resolved_at", "timestamp_ntz", None),
]
QUEUE_COLUMNS = [  # what triage actions write to a queue row
    ("status", "string", None), ("action_taken", "string", None), ("new_department", "string", None),
    ("assigned_to", "string", None), ("resolved_at", "timestamp_ntz", None),
]
PATCH_FIELDS = ("status", "assigned_department", "assigned_to", "resolution_notes", "resolution", "predicted_priority")


def probabilities_json(m: Column) -> Column:
    """A label -> probability map as the JSON text stored in the ticket row
    (``{"A": 0.5, "B": 0.25}``, Python's separators)."""
    entries = F.transform(F.map_entries(m), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def parse_probabilities(js: Column) -> Column:
    """#55: stored JSON text back to ``map<string,double>``."""
    return F.from_json(js, "map<string,double>")


def ticket_rows(scored: DataFrame, key: str = "ticket_id", channel: Column | None = None) -> DataFrame:
    """#4: ticket-table rows from predictions that carry their request columns
    (description, customer_name, channel, created_at -- pass them as scoring
    keys, so no join is needed); status and flags follow from the risk level.
    """
    high = F.col("risk_level") == "High"
    return scored.select(
        F.col(key).alias("ticket_id"),
        "description",
        F.coalesce(F.col("customer_name"), F.lit("Anonymous")).alias("customer_name"),
        (F.coalesce(F.col("customer_email"), F.lit("")) if "customer_email" in scored.columns else F.lit(""))
        .alias("customer_email"),
        (channel if channel is not None else F.coalesce(F.col("channel"), F.lit("Chatbot"))).alias("channel"),
        F.col("category").alias("predicted_category"),
        F.col("intent").alias("predicted_intent"),
        F.col("priority").alias("predicted_priority"),
        F.col("confidence").alias("confidence_score"),
        "intent_confidence", "risk_level", "risk_score", "sentiment_score",
        probabilities_json(F.col("category_probabilities")).alias("category_probabilities"),
        probabilities_json(F.col("intent_probabilities")).alias("intent_probabilities"),
        F.when(high, "Triage").otherwise("Open").alias("status"),
        F.col("category").alias("assigned_department"),
        F.when(high, 1).otherwise(0).alias("is_triage"),
        F.col("risk_level").alias("misrouting_risk"),
        F.col("category").alias("route"),
        F.when(high, 1).otherwise(0).alias("requires_human"),
        F.lit(None).cast("string").alias("resolution"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.col("created_at"),
        F.col("created_at").alias("updated_at"),
        F.lit(None).cast(scored.schema["created_at"].dataType).alias("resolved_at"),
    )


def append_tickets(rows: DataFrame, path: str) -> None:
    """#4 sink: append rows to the parquet ticket table, partitioned by status."""
    rows.write.mode("append").partitionBy("status").parquet(path)


def write_then_read(rows: DataFrame, name: str) -> DataFrame:
    """Append ``rows`` to a fresh table under the shared checkpoint folder and
    read it back (the round trip a later job would see)."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    append_tickets(rows, path)
    return spark.read.parquet(path)


def assign_ids(df: DataFrame, order_cols: list[str], start_after: Column | int = 0,
               id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """#5: dense ids ``start_after + 1, + 2, ...`` in the order of ``order_cols``.

    A single global ``row_number()`` would pull every row into one task. Instead
    rows are range-partitioned on the order key and sorted inside each
    partition; one small job counts rows per partition, a window over those
    (one row per partition) gives each partition its offset, and each row adds
    its position inside the partition. ``order_cols`` must be a total order.
    The partitioned frame is checkpointed so the counts and the numbering read
    the same partitions even if an executor is lost in between.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    # without a count, adaptive execution sizes the partitions
    ordered = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    ordered = ordered.sortWithinPartitions(*order_cols)
    ordered = ordered.withColumn("_pid", F.spark_partition_id()) \
                     .withColumn("_mono", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    base = start_after if isinstance(start_after, Column) else F.lit(start_after)
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    # offsets has one row per partition: bounded by the partition count.
    return ordered.join(F.broadcast(offsets), "_pid") \
        .withColumn(id_col, (base + F.col("_off") + local + 1).cast("long")) \
        .drop("_pid", "_mono", "_off")


def evolve_schema(df: DataFrame, columns=ADDED_COLUMNS) -> DataFrame:
    """#6: add missing columns with their defaults; present columns are kept."""
    out = df
    for name, typ, default in columns:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default).cast(typ))
    return out


def union_evolving(old: DataFrame, new: DataFrame) -> DataFrame:
    """#6: union tables of different schema versions by name, filling defaults."""
    u = evolve_schema(old).unionByName(evolve_schema(new), allowMissingColumns=True)
    return u.fillna({n: d for n, _, d in ADDED_COLUMNS if d is not None})


def validate_input(df: DataFrame, text: str = "description") -> tuple[DataFrame, DataFrame]:
    """#7: (accepted, rejected). Accepted texts have 5..2000 characters and get
    default customer name, e-mail and channel; rejected rows carry a reason."""
    n = F.length(F.col(text))
    reason = (F.when(F.col(text).isNull(), "missing")
              .when(n < L.TEXT_MIN_CHARS, "too_short")
              .when(n > L.TEXT_MAX_CHARS, "too_long"))
    checked = df.withColumn("_reason", reason)
    fills = {"customer_name": "Anonymous", "customer_email": "", "channel": "Chatbot"}
    accepted = checked.where(F.col("_reason").isNull()).drop("_reason")
    for c, v in fills.items():
        accepted = accepted.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    rejected = checked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return accepted, rejected


def prediction_history(scored: DataFrame, key: str = "ticket_id", time_col: str = "created_at") -> DataFrame:
    """#8: the 9-column history table, newest first (``scored`` carries the
    description and time columns as scoring keys)."""
    return scored.select(
        F.col(key).alias("ticket_id"),
        F.col("description").alias("complaint_text"),
        F.col("category").alias("predicted_department"),
        "intent", "priority",
        F.col("confidence").alias("confidence_score"),
        F.col("sentiment_label").alias("sentiment"),
        "risk_level",
        F.col(time_col).alias("prediction_timestamp"),
    ).orderBy(F.desc("prediction_timestamp"), F.desc("ticket_id"))


def ticket_filter(status: str = "", department: str = "", priority: str = "", risk_level: str = "") -> Column:
    """#52/#53 shared predicate: empty string means 'no filter'."""
    cond = F.lit(True)
    for col, val in (("status", status), ("predicted_category", department),
                     ("predicted_priority", priority), ("risk_level", risk_level)):
        if val:
            cond = cond & (F.col(col) == val)
    return cond


def list_tickets(t: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """#52: filtered, newest first, one page (limit/offset)."""
    ordered = t.where(ticket_filter(**filters)).orderBy(F.desc("created_at"), F.desc("ticket_id"))
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def count_tickets(t: DataFrame, **filters) -> DataFrame:
    """#53: total under the same filters, as a one-row frame."""
    return t.where(ticket_filter(**filters)).agg(F.count(F.lit(1)).alias("total"))


def get_tickets(t: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """#54: (found rows, missing ids) for a frame of requested ids."""
    want = ids.select(F.col(id_col).alias("ticket_id")).distinct()
    found = t.join(want, "ticket_id", "left_semi")
    missing = want.join(t.select("ticket_id"), "ticket_id", "left_anti")
    return found, missing


def _nonempty(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _last(value: Column, order: Column, touched: Column) -> Column:
    """Newest ``value`` among rows where ``touched`` (struct max ignores NULL rows)."""
    return F.max(F.when(touched, F.struct(order.alias("o"), value.alias("v"))))["v"]


def patch_tickets(t: DataFrame, patches: DataFrame, time_col: str = "patched_at") -> DataFrame:
    """#56: apply a table of patches in time order.

    Only non-empty fields overwrite; a 'Resolved' status also sets
    ``resolved_at``; every patch sets ``updated_at``. Patches are folded per
    ticket (newest non-empty value per column) and joined once. A ticket table
    without one of the written columns gets it.
    """
    fields = [c for c in PATCH_FIELDS if c in patches.columns]
    written = [*fields, "resolved_at", "updated_at"]
    t = evolve_schema(t, [c for c in UPDATED_COLUMNS if c[0] in written])
    ts = F.col(time_col)
    resolved = (F.col("status") == "Resolved") if "status" in fields else F.lit(False)
    folded = patches.groupBy("ticket_id").agg(
        *[_last(F.col(c), ts, _nonempty(c)).alias(f"_p_{c}") for c in fields],
        F.max(F.when(resolved, ts)).alias("_p_resolved_at"),
        F.max(ts).alias("_p_updated_at"),
    )
    j = t.join(folded, "ticket_id", "left")
    return j.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in written else F.col(c) for c in t.columns])


def triage_queue(triage: DataFrame, t: DataFrame) -> DataFrame:
    """#57: triage rows joined to their tickets, renamed, newest first."""
    a = triage.select(
        F.col("ticket_id"),
        F.col("triage_id"),
        F.col("reason").alias("triage_reason"),
        F.col("status").alias("triage_status"),
        (F.col("assigned_to") if "assigned_to" in triage.columns else F.lit(None).cast("string"))
        .alias("triage_assigned_to"),
        (F.col("action_taken") if "action_taken" in triage.columns else F.lit(None).cast("string"))
        .alias("action_taken"),
        F.col("created_at").alias("_queued_at"),
    )
    return t.join(a, "ticket_id").orderBy(F.desc("_queued_at"), F.desc("triage_id")).drop("_queued_at")


# One action's effect, per column: (column, value expression, kinds that write it)
def _action_effects() -> tuple[list, list]:
    kind = F.col("action")
    queue = [
        ("queue_status", F.when(kind == "escalate", "Escalated").otherwise("Resolved"),
         ("accept", "reassign", "escalate")),
        ("action_taken", F.when(kind == "accept", "Accepted AI prediction")
         .when(kind == "reassign", F.concat(F.lit("Reassigned to "), F.coalesce(F.col("new_department"), F.lit("None"))))
         .otherwise("Escalated"), ("accept", "reassign", "escalate")),
        ("new_department", F.col("new_department"), ("reassign",)),
        ("queue_assigned_to", F.col("assigned_to"), ("reassign", "escalate")),
        ("queue_resolved_at", F.col("acted_at"), ("accept", "reassign")),
    ]
    ticket = [
        ("ticket_status", F.when(kind == "escalate", "Escalated").otherwise("Open"),
         ("accept", "reassign", "escalate")),
        ("is_triage", F.lit(0), ("accept", "reassign")),
        ("assigned_department", F.col("new_department"), ("reassign",)),
        ("assigned_to", F.col("assigned_to"), ("reassign",)),
        ("predicted_priority", F.lit("Critical"), ("escalate",)),
        ("updated_at", F.col("acted_at"), ("accept", "reassign", "escalate")),
    ]
    return queue, ticket


def replay_actions(actions: DataFrame, kinds: tuple[str, ...] = ("accept", "reassign", "escalate")) -> DataFrame:
    """#58-#61: fold an ordered action log into per-ticket column updates.

    For every column, the value written by the last action (by ``seq``) that
    writes that column -- exactly what running the actions one by one leaves.
    Columns no action touched stay NULL here and keep their old value on merge.
    """
    acts = actions.where(F.col("action").isin(*kinds))
    queue, ticket = _action_effects()
    order = F.col("seq")
    aggs = [_last(v, order, F.col("action").isin(*w)).alias(n) for n, v, w in queue + ticket]
    touched = [F.max(F.col("action").isin(*w).cast("int")).alias(f"_t_{n}") for n, _, w in queue + ticket]
    return acts.groupBy("ticket_id").agg(*aggs, *touched)


QUEUE_TARGETS = {"status": "queue_status", "action_taken": "action_taken", "new_department": "new_department",
                 "assigned_to": "queue_assigned_to", "resolved_at": "queue_resolved_at"}
TICKET_TARGETS = {"status": "ticket_status", "is_triage": "is_triage", "assigned_department": "assigned_department",
                  "assigned_to": "assigned_to", "predicted_priority": "predicted_priority", "updated_at": "updated_at"}


def _folded(actions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``replay_actions`` with its columns named ``_n_`` (new value) and ``_t_`` (written at all)."""
    names = [n for part in _action_effects() for n, _, _ in part]
    return replay_actions(actions, kinds).select("ticket_id", *[F.col(n).alias(f"_n_{n}") for n in names], *[f"_t_{n}" for n in names])


def _written(column: str, target: str) -> Column:
    """A stored column, overwritten where an action wrote its folded one."""
    return F.when(F.col(f"_t_{target}") == 1, F.col(f"_n_{target}")).otherwise(F.col(column))


def _merge(base: DataFrame, folded: DataFrame, targets: dict[str, str]) -> DataFrame:
    """``base`` with each target column overwritten where an action wrote its folded column."""
    j = base.join(folded, "ticket_id", "left")
    return j.select(*[_written(c, targets[c]).alias(c) if c in targets else F.col(c) for c in base.columns])


ALL_KINDS = ("accept", "reassign", "escalate")


def with_update_columns(t: DataFrame) -> DataFrame:
    """A ticket table with the columns that updates write; a ticket's department starts as its prediction."""
    if "assigned_department" not in t.columns:
        t = t.withColumn("assigned_department", F.col("predicted_category"))
    return evolve_schema(t, UPDATED_COLUMNS)


def replay_queue(triage: DataFrame, actions: DataFrame, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """The queue after the action log."""
    return _merge(evolve_schema(triage, QUEUE_COLUMNS), _folded(actions, kinds), QUEUE_TARGETS)


def replay_tickets(t: DataFrame, actions: DataFrame, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """The ticket table after the action log."""
    return _merge(with_update_columns(t), _folded(actions, kinds), TICKET_TARGETS)


def replay_tables(triage: DataFrame, t: DataFrame, actions: DataFrame,
                  kinds: tuple[str, ...] = ALL_KINDS) -> tuple[DataFrame, DataFrame]:
    """(queue, tickets) after the action log: only the columns an action names change.

    Everything else keeps the stored value, so batches can follow each other:
    two in a row leave what one combined batch would. Tables without one of
    the written columns get it.
    """
    return replay_queue(triage, actions, kinds), replay_tickets(t, actions, kinds)


def queue_state(queue: DataFrame, t: DataFrame) -> DataFrame:
    """Queue rows next to the ticket columns that actions write."""
    q = queue.select("ticket_id", *[F.col(c).alias(f"_q_{c}") for c in QUEUE_TARGETS])
    j = q.join(t.select("ticket_id", *TICKET_TARGETS), "ticket_id")
    return j.select("ticket_id", *[F.col(f"_q_{c}").alias(n) for c, n in QUEUE_TARGETS.items()],
                    *[F.col(c).alias(n) for c, n in TICKET_TARGETS.items()])


def apply_triage_actions(triage: DataFrame, t: DataFrame, actions: DataFrame,
                         kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """#58-#61: the state of each triage ticket after the action log.

    The log is folded once, and queue rows, tickets and the folded log meet on
    the ticket id, so each is shuffled once.
    """
    q = evolve_schema(triage, QUEUE_COLUMNS).select("ticket_id", *[F.col(c).alias(f"_q_{c}") for c in QUEUE_TARGETS])
    j = q.join(with_update_columns(t).select("ticket_id", *TICKET_TARGETS), "ticket_id").join(_folded(actions, kinds), "ticket_id", "left")
    return j.select("ticket_id", *[_written(f"_q_{c}", n).alias(n) for c, n in QUEUE_TARGETS.items()],
                    *[_written(c, n).alias(n) for c, n in TICKET_TARGETS.items()])
