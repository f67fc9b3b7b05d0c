"""Plan checks: no Python in scoring, pruning/pushdown reach the scan, no
shuffle in the rule path."""

from pyspark.sql import functions as F

from deskflow.plans import queries
from deskflow.sources.tables import read_table

SCORING = ["clean_text", "text_features", "lexicon_counts", "sentiment_lexicon", "sentiment_score_label",
           "priority_urgency", "priority_keywords", "greeting_filter", "keyword_hits", "department_router",
           "fallback_category", "keyword_override", "arbitrate_model_rules", "intent_from_department",
           "score_tickets", "score_tickets_model", "ambiguity_gap", "risk_tiers", "risk_formula",
           "intent_confidence", "triage_reasons", "routing_outcome", "chat_reply", "chat_log"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_scoring(spark, sf_dir):
    qs = queries()
    for name in SCORING:
        p = _plan(qs[name](spark, sf_dir))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def test_rule_scoring_has_no_hash_shuffle(spark, sf_dir):
    p = _plan(queries()["score_tickets"](spark, sf_dir))
    assert "hashpartitioning" not in p.lower()


def test_column_pruning_and_pushdown(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id")
    p = _plan(d)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def test_tickets_view_reads_only_needed_event_columns(spark, sf_dir):
    p = _plan(queries()["risk_tiers"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint>" in p


def test_rule_scoring_has_no_exchange(spark, sf_dir):
    assert "Exchange" not in _plan(queries()["score_tickets"](spark, sf_dir))


def test_read_partitions_is_the_callers_choice(spark, sf_dir):
    from deskflow.sources.tables import READ_PARTITIONS
    plain = read_table(spark, sf_dir, "events")
    assert "Exchange" not in _plan(plain)
    assert read_table(spark, sf_dir, "events", partitions=5).rdd.getNumPartitions() == 5
    spark.conf.set(READ_PARTITIONS, "3")
    try:
        assert read_table(spark, sf_dir, "events").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(READ_PARTITIONS)
