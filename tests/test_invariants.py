"""Invariants for operators without a SQL oracle, and brute-force checks."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskflow.functions.formatting import percent_1dp, py_round
from deskflow.operators import evaluate as EV
from deskflow.operators import tickets as TK
from deskflow.plans import queries
from deskflow.sources import fixtures as FX


def test_probabilities_sum_to_one(spark, sf_dir):
    p = FX.probabilities(spark, sf_dir).groupBy("ticket_id").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    bad = p.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("n") != 11)).count()
    assert bad == 0


def test_py_round_matches_python(spark):
    random.seed(7)
    vals = [0.01075, 0.03125, 2.5e-5, 0.99995, -0.01075, 0.0] + [random.random() for _ in range(500)] \
        + [k / 20000 for k in range(0, 20000, 37)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(py_round(F.col("x"), 4)).collect()]
    assert got == [round(v, 4) for v in vals]
    pos = [v for v in vals if v >= 0]
    pct = [r[0] for r in spark.createDataFrame([(v,) for v in pos], "x double").select(percent_1dp(F.col("x"))).collect()]
    assert pct == [f"{v:.1%}" for v in pos]


def test_assign_ids_dense_and_ordered(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = TK.assign_ids(conv, ["conv_id", "turn"], start_after=100, id_col="new_id", partitions=5).toPandas()
    out = out.sort_values(["conv_id", "turn"]).reset_index(drop=True)
    assert list(out.new_id) == list(range(101, 101 + len(out)))


def test_split_sizes_and_folds(spark, sf_dir):
    c = FX.corpus(spark, sf_dir)
    s = EV.stratified_split(c, "category", "id").groupBy("category").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).toPandas()
    for r in s.itertuples():
        assert r.t == math.ceil(r.n * 0.2)
    f = EV.kfold_assign(c, "category", "id").groupBy("category", "fold").count().toPandas()
    for cat, g in f.groupby("category"):
        assert g["count"].max() - g["count"].min() <= 1


def test_replay_equals_sequential_application(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    a = FX.triage(spark, sf_dir, t)
    acts = FX.actions(spark, sf_dir, a)
    got = TK.apply_triage_actions(a, t, acts).toPandas().set_index("ticket_id")
    tp = t.toPandas().set_index("ticket_id")
    ap = a.toPandas().set_index("ticket_id")
    lp = acts.toPandas().sort_values(["ticket_id", "seq"])
    for tid in ap.index:
        q = {"queue_status": ap.at[tid, "status"], "action_taken": None, "new_department": None,
             "queue_assigned_to": None, "queue_resolved_at": None}
        k = {"ticket_status": tp.at[tid, "status"], "is_triage": tp.at[tid, "is_triage"],
             "assigned_department": tp.at[tid, "predicted_category"], "assigned_to": None,
             "predicted_priority": tp.at[tid, "predicted_priority"], "updated_at": tp.at[tid, "updated_at"]}
        for r in lp[lp.ticket_id == tid].itertuples():
            now = r.acted_at
            if r.action == "accept":
                q.update(queue_status="Resolved", action_taken="Accepted AI prediction", queue_resolved_at=now)
                k.update(ticket_status="Open", is_triage=0, updated_at=now)
            elif r.action == "reassign":
                q.update(queue_status="Resolved", action_taken=f"Reassigned to {r.new_department}",
                         new_department=r.new_department, queue_assigned_to=r.assigned_to, queue_resolved_at=now)
                k.update(ticket_status="Open", is_triage=0, assigned_department=r.new_department,
                         assigned_to=r.assigned_to, updated_at=now)
            else:
                q.update(queue_status="Escalated", action_taken="Escalated", queue_assigned_to=r.assigned_to)
                k.update(ticket_status="Escalated", predicted_priority="Critical", updated_at=now)
        row = got.loc[tid]
        for key, want in {**q, **k}.items():
            have = row[key]
            if want is None or (isinstance(want, float) and math.isnan(want)):
                assert have is None or pd.isna(have), (tid, key)
            else:
                assert have == want, (tid, key, have, want)


def test_patches_fold_multiple_updates(spark):
    t = spark.createDataFrame([(1, "Open", "A", None, None, "2024-01-01 00:00:00")],
                              "ticket_id long, status string, assigned_department string, resolved_at timestamp_ntz, "
                              "x string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    p = spark.createDataFrame([(1, "Resolved", "", "2024-01-02 00:00:00"), (1, "", "B", "2024-01-03 00:00:00")],
                              "ticket_id long, status string, assigned_department string, patched_at string") \
        .withColumn("patched_at", F.col("patched_at").cast("timestamp_ntz"))
    r = TK.patch_tickets(t, p).first()
    assert (r.status, r.assigned_department) == ("Resolved", "B")
    assert str(r.resolved_at) == "2024-01-02 00:00:00" and str(r.updated_at) == "2024-01-03 00:00:00"


def test_stream_equals_batch(spark, sf_dir):
    qs = queries()
    s = qs["stream_score"](spark, sf_dir).orderBy("ticket_id").toPandas()
    b = qs["score_tickets"](spark, sf_dir).orderBy("ticket_id").toPandas()
    pd.testing.assert_frame_equal(s[sorted(s.columns)].reset_index(drop=True), b[sorted(b.columns)].reset_index(drop=True),
                                  check_dtype=False)


def test_stream_fanout_idempotent_sinks(spark, sf_dir):
    r = queries()["stream_fanout"](spark, sf_dir).toPandas()
    assert set(r.sink) == {"tickets", "triage", "chat"}
    tickets = r[r.sink == "tickets"].rows.sum()
    assert r[r.sink == "chat"].rows.sum() == 2 * tickets


def test_detect_columns(spark, sf_dir):
    qs = queries()
    found = qs["detect_columns"](spark, sf_dir).first().asDict()
    assert found.pop("texts") > 0
    assert found == {"text_column": "instruction", "intent_column": "intent", "category_column": "category"}
    assert qs["detect_columns_fallback"](spark, sf_dir).first().text_column == "html"


@pytest.mark.slow
def test_training_and_reload(spark, sf_dir):
    qs = queries()
    m = qs["train_logistic"](spark, sf_dir).first()
    assert m.accuracy >= 0.996 and m.f1 >= 0.996  # the published logistic baseline
    assert all(r.same for r in qs["save_load_model"](spark, sf_dir).collect())


@pytest.mark.slow
def test_no_class_without_rows(spark, sf_dir):
    from deskflow.operators import train as TR
    fit = TR.fit_and_score(TR.training_frame(FX.corpus(spark, sf_dir), TR.TrainConfig()), "lr_baseline", TR.TrainConfig())
    n = FX.corpus(spark, sf_dir).select("category").distinct().count()
    assert len(TR.labels_of(fit["model"])) == n and len(fit["predictions"].first().probability) == n


@pytest.mark.slow
def test_boosted_models_reach_the_published_accuracies(spark, sf_dir):
    from deskflow.operators import train as TR
    tf = TR.training_frame(FX.corpus(spark, sf_dir), TR.TrainConfig())
    got = TR.train_models(tf, TR.TrainConfig(), ("gbt_category", "gbt_intent", "gbt_priority"))
    for name, accuracy, f1 in (("gbt_category", 0.992372, 0.992353), ("gbt_intent", 0.981581, 0.981554), ("gbt_priority", 0.999814, 0.999723)):
        assert got[name]["accuracy"] >= accuracy and got[name]["f1"] >= f1, name
        assert all(abs(sum(r.probability) - 1) < 1e-9 for r in got[name]["predictions"].collect())


def test_default_training_settings_are_the_references():
    from deskflow.operators.train import BOOSTED, TrainConfig
    assert (TrainConfig().max_terms, TrainConfig().max_iter) == (5000, 1000)
    got = {n: (b.rounds, b.depth, b.step, b.min_child, b.gamma, b.alpha) for n, b in BOOSTED.items()}
    assert got == {"gbt_category": (300, 8, 0.1, 3, 0.1, 0.1), "gbt_intent": (400, 10, 0.08, 2, 0.05, 0.1), "gbt_priority": (200, 6, 0.1, 1, 0, 0)}
    assert all((b.subsample, b.colsample, b.lam) == (0.8, 0.8, 1.0) for b in BOOSTED.values())


@pytest.mark.parametrize("name", ["train_category", "train_intent", "train_priority", "train_logistic", "algorithm_comparison",
                                  "cross_validate", "model_report"])
def test_registered_training_uses_the_full_settings(spark, sf_dir, monkeypatch, name):
    from deskflow.operators import train as TR

    class Fitted(Exception):
        pass

    def record(tf, cfg, *args, **kwargs):
        raise Fitted(cfg)

    monkeypatch.setattr(TR, "training_frame", lambda corpus, cfg: spark.range(1))
    for fit in ("train_models", "algorithm_comparison", "cross_validate"):
        monkeypatch.setattr(TR, fit, record)
    with pytest.raises(Fitted) as fitted:
        queries()[name](spark, sf_dir)
    assert fitted.value.args == (TR.TrainConfig(),)


def test_patch_columns_a_table_lacks(spark):
    t = spark.createDataFrame([(1, "Open")], "ticket_id long, status string")
    p = spark.createDataFrame([(1, "bob", "done", "2024-01-02 00:00:00")],
                              "ticket_id long, assigned_to string, resolution string, patched_at string") \
        .withColumn("patched_at", F.col("patched_at").cast("timestamp_ntz"))
    r = TK.patch_tickets(t, p).first()
    assert (r.status, r.assigned_to, r.resolution, r.resolved_at) == ("Open", "bob", "done", None)
    assert str(r.updated_at) == "2024-01-02 00:00:00"


def test_escalation_keeps_an_earlier_reassignment(spark):
    q = spark.createDataFrame([(1, 1, "Pending")], "triage_id long, ticket_id long, status string")
    t = spark.createDataFrame([(1, "Open", "ORDER", "Low")], "ticket_id long, status string, predicted_category string, "
                                                            "predicted_priority string")
    schema = "ticket_id long, seq int, action string, new_department string, assigned_to string, acted_at string"
    act = lambda *r: spark.createDataFrame([r], schema).withColumn("acted_at", F.col("acted_at").cast("timestamp_ntz"))
    q, t = TK.replay_tables(q, t, act(1, 1, "reassign", "ACCOUNT", "bob", "2024-01-01 00:00:00"))
    q, t = TK.replay_tables(q, t, act(1, 2, "escalate", None, "eve", "2024-01-02 00:00:00"))
    r = TK.queue_state(q, t).first()
    assert (r.queue_status, r.new_department, r.queue_assigned_to) == ("Escalated", "ACCOUNT", "eve")
    assert (r.assigned_department, r.assigned_to, r.predicted_priority) == ("ACCOUNT", "bob", "Critical")
    assert str(r.queue_resolved_at) == "2024-01-01 00:00:00"


def test_union_evolving_fills_defaults(spark):
    old = spark.createDataFrame([(1, "Open")], "ticket_id long, status string")
    new = spark.createDataFrame([(2, "Triage", "High", "ACCOUNT", 1, None)],
                                "ticket_id long, status string, misrouting_risk string, route string, "
                                "requires_human int, resolution string")
    u = {r.ticket_id: r for r in TK.union_evolving(old, new).collect()}
    assert u[1].requires_human == 0 and u[1].route is None and u[1].misrouting_risk is None
    assert u[2].requires_human == 1 and u[2].route == "ACCOUNT"
    # present columns are kept as they are
    assert TK.evolve_schema(new).columns == new.columns
