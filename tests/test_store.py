"""Stored tables: what a batch rewrites, repeated and overlapping batches, ids of arriving rows."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from deskflow.operators import store as ST
from deskflow.operators import tickets as TK
from deskflow.session import scratch_path
from deskflow.sources import fixtures as FX
from deskflow.streaming import stream as S


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.fixture
def tickets(spark, sf_dir):
    return FX.tickets(spark, sf_dir)


def test_only_touched_buckets_are_rewritten(spark, sf_dir, tickets):
    table = ST.create_tickets(spark, scratch_path(spark, "t"), tickets, "timestamp_ntz", buckets=16)
    patches = FX.patches(spark, sf_dir, tickets)
    before = files(table.path)
    assert len(before) == 16
    one = patches.where("ticket_id = (SELECT 1) * 10")
    touched = ST.apply_patches(table, one)
    after = files(table.path)
    assert len(touched) == 1 and {f.split("/")[0] for f in before ^ after} == {f"_bucket={touched[0]}"}
    assert ST.apply_patches(table, one) == [] and files(table.path) == after  # the same batch again
    want = TK.patch_tickets(TK.with_update_columns(tickets), one)
    assert rows(table.read(), *want.columns) == rows(want, *want.columns)


def test_a_batch_replayed_after_a_later_one_changes_nothing(spark, tickets):
    table = ST.create_tickets(spark, scratch_path(spark, "t"), tickets, "timestamp_ntz", buckets=4)
    key = tickets.select(F.min("ticket_id")).first()[0]
    at = [dt.datetime(2030, 1, d) for d in (1, 2)]
    first, later = (spark.createDataFrame([(key, s, t)], "ticket_id long, status string, patched_at timestamp_ntz")
                    for s, t in zip(("Resolved", "Closed"), at))
    for batch in (first, later, first, first.union(later)):
        ST.apply_patches(table, batch)
    r = table.read().where(F.col("ticket_id") == key).first()
    assert (r.status, r.updated_at, r.resolved_at) == ("Closed", at[1], at[0])
    assert table.read().count() == tickets.count()


def test_unknown_keys_and_empty_batches(spark, tickets):
    table = ST.create_tickets(spark, scratch_path(spark, "t"), tickets, "timestamp_ntz", buckets=4)
    before = files(table.path)
    nobody = spark.createDataFrame([(-5, "Closed", dt.datetime(2030, 1, 1))], "ticket_id long, status string, patched_at timestamp_ntz")
    assert ST.apply_patches(table, nobody) == [] and ST.apply_patches(table, nobody.limit(0)) == []
    assert files(table.path) == before


def test_actions_in_batches_leave_what_one_log_leaves(spark, sf_dir, tickets):
    triage = FX.triage(spark, sf_dir, tickets)
    acts = FX.actions(spark, sf_dir, triage)
    queue, table = ST.create_queue(spark, scratch_path(spark, "q"), triage, 8), ST.create_tickets(spark, scratch_path(spark, "t"), tickets, "bigint", 8)
    for batch in (acts.where("seq = 1"), acts.where("seq = 1"), acts.where("seq = 2"), acts, acts.where("seq = 1")):
        ST.apply_actions(queue, table, batch)
    assert ST.apply_actions(queue, table, acts) == ([], [])
    want = TK.apply_triage_actions(triage, tickets, acts)
    assert rows(TK.queue_state(queue.read(), table.read()), *want.columns) == rows(want, *want.columns)


def test_a_replayed_batch_gets_its_ids_again(spark, sf_dir, tickets):
    arriving = S.score_stream(tickets.withColumnRenamed("ticket_id", "request_id"),
                              keys=["request_id", "description", "customer_name", "channel", "created_at"])
    parts = [arriving.where(f"request_id % 3 = {i}") for i in range(3)]
    base = scratch_path(spark, "sinks")
    S.open_ledger(spark, f"{base}/ledger", after=100)
    write = S.fanout_batch(base, ["created_at", "request_id"])
    write(parts[0], 0)
    write(parts[1], 1)
    first = spark.read.parquet(f"{base}/tickets")
    ids = {(r.ticket_id, r.description) for r in first.collect()}
    write(parts[1], 1)  # replayed
    write(parts[0], 0)  # replayed after a later batch
    assert {(r.ticket_id, r.description) for r in spark.read.parquet(f"{base}/tickets").collect()} == ids
    write(parts[2], 2)
    S.open_ledger(spark, f"{base}/ledger", after=7)  # one that exists stays
    got = sorted(r.ticket_id for r in spark.read.parquet(f"{base}/tickets").collect())
    assert got == list(range(101, 101 + tickets.count()))
    with pytest.raises(ValueError):
        write(parts[0].limit(1), 2)
