"""What must not run in one task, or more than once."""

from deskflow.plans import queries
from deskflow.sources import fixtures as FX
from deskflow.streaming import stream as ST


def test_arriving_files_grow_with_the_rows(spark, sf_dir, monkeypatch, tmp_path):
    source = FX.tickets(spark, sf_dir).limit(900)
    assert ST.stage_files(source, f"{tmp_path}/few", 4) == 1
    want = sorted(ST.stream_assigned_ids(spark, source).collect())
    monkeypatch.setattr(ST, "FILE_ROWS", 100)
    assert ST.stage_files(source, f"{tmp_path}/many", 4) == 3
    assert len(list((tmp_path / "many").glob("*.parquet"))) == 12
    assert spark.read.parquet(f"{tmp_path}/many").count() == 900
    assert sorted(ST.stream_assigned_ids(spark, source).collect()) == want


def test_the_chain_scores_its_tickets_once(spark, sf_dir):
    plan = queries()["ticket_chain"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.lower() and "chain-scored" in plan


def test_texts_of_one_row_group_are_routed_and_scored_in_all_cores(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in usual:
            spark.conf.set(k, "4096")  # many byte ranges, of which one has the rows
        for name in ("route_documents", "score_documents", "route_conversations", "score_conversations"):
            rows = queries()[name](spark, sf_dir).rdd.glom().map(len).collect()
            assert sum(map(bool, rows)) >= cores > 1 and max(rows) < sum(rows) / 2, name
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
