"""Structured Streaming over ticket files (#98-#100).

The scoring expressions are the batch ones (#42): stateless projections, so a
stream gives the same rows as a batch run over the same files. Files are read
incrementally (``maxFilesPerTrigger``); ``availableNow`` processes everything
present and stops, which is how the tests and the registered queries run it.
Checkpoints live under the shared checkpoint folder, so a restarted query
resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import score as S
from ..operators import tickets as TK
from ..session import scratch_path


def ticket_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded ticket source: parquet files dropped into ``path``; a micro-batch
    takes all new files unless the caller sets a number."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drop_greetings(stream: DataFrame, text: str = "description") -> DataFrame:
    """#100: stateless filter removing greetings before scoring."""
    return stream.where(~X.is_greeting(text))


def score_stream(stream: DataFrame, text: str = "description", keys: list[str] | None = None) -> DataFrame:
    """#98: rule-path scoring of every arriving ticket."""
    return S.score_tickets(stream, text, keys)


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append the stream to ``sink_path`` until all present input is consumed."""
    q = (df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


LEDGER = "start long, rows long, batch long"


def reserve_ids(spark: SparkSession, ledger: str, batch_id: int, rows: int) -> int:
    """The number before a micro-batch's first id.

    The range is written to the ledger once; a batch that is replayed finds it
    there and gets the same one, whatever came after. Batches reserve in order,
    so ids are dense across them.
    """
    seen = spark.read.schema(LEDGER).parquet(ledger)
    mine = seen.where(F.col("batch") == batch_id).first()
    if mine:
        if mine["rows"] != rows:
            raise ValueError(f"batch {batch_id} reserved {mine['rows']} ids and now has {rows} rows")
        return mine["start"]
    start = seen.where(F.col("batch") < batch_id).agg(F.coalesce(F.max(F.col("start") + F.col("rows")), F.lit(0))).first()[0]
    spark.createDataFrame([(start, rows)], "start long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
    return start


def open_ledger(spark: SparkSession, ledger: str, after: int = 0) -> None:
    """A ledger whose first id follows ``after``; one that exists stays."""
    spark.createDataFrame([(after, 0)], "start long, rows long").coalesce(1).write.mode("ignore").parquet(f"{ledger}/batch=-1")


def fanout_batch(base: str, arrival: list[str] | None = None):
    """#99: ``foreachBatch`` writer for three sinks -- tickets, triage rows and
    chat rows. Each micro-batch overwrites its own ``batch=<id>`` folder, so a
    batch replayed after a failure rewrites the same files (idempotent).

    With ``arrival`` (columns that order the arriving rows totally) the rows
    have no ``ticket_id`` yet and get one here, dense and in this order (#5).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if arrival:
            spark = batch.sparkSession
            batch = batch.persist()
            try:
                start = reserve_ids(spark, f"{base}/ledger", batch_id, batch.count())
                rows = TK.assign_ids(batch, arrival, start_after=start, id_col="ticket_id")  # checkpointed
            finally:
                batch.unpersist()
        else:
            rows = batch.persist()
        try:
            TK.ticket_rows(rows, channel=F.lit(L.CHAT_CHANNEL)).write.mode("overwrite").parquet(f"{base}/tickets/batch={batch_id}")
            S.queue_rows(rows, chat=True).write.mode("overwrite").parquet(f"{base}/triage/batch={batch_id}")
            S.chat_log(rows).write.mode("overwrite").parquet(f"{base}/chat/batch={batch_id}")
        finally:
            rows.unpersist()
    return write


def run_fanout(scored_stream: DataFrame, base: str, checkpoint: str, arrival: list[str] | None = None) -> None:
    if arrival:
        open_ledger(scored_stream.sparkSession, f"{base}/ledger")
    q = (scored_stream.writeStream.foreachBatch(fanout_batch(base, arrival)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


FILE_ROWS = 50_000  # rows of an arriving file, about


def stage_files(df: DataFrame, path: str, arrivals: int) -> int:
    """Write ``df`` as the parquet files of ``arrivals`` arrivals; the number of files of each, which grows with the rows.

    A file is written, and later read and scored, by one task.
    """
    each = max(1, -(-df.count() // (arrivals * FILE_ROWS)))
    df.repartition(arrivals * each).write.mode("overwrite").parquet(path)
    return each


def stream_roundtrip(spark: SparkSession, source: DataFrame, build, name: str, files: int = 4) -> DataFrame:
    """Stage ``source`` as files, run ``build(stream)`` as a stream into a
    parquet sink, and return the sink contents."""
    src = scratch_path(spark, f"{name}-in")
    stage_files(source, src, files)
    sink, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    run_available_now(build(ticket_stream(spark, src, source.schema)), sink, ckpt)
    return spark.read.parquet(sink)


def stream_fanout(spark: SparkSession, source: DataFrame, name: str = "fanout", files: int = 4) -> DataFrame:
    """Run #99 end to end; returns (sink, channel, rows) counts of what was written."""
    src = scratch_path(spark, f"{name}-in")
    stage_files(source, src, files)
    base, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    keys = ["ticket_id", "description", "customer_name", "channel", "created_at"]
    scored = score_stream(drop_greetings(ticket_stream(spark, src, source.schema)), keys=keys)
    run_fanout(scored, base, ckpt)
    parts = [spark.read.parquet(f"{base}/{s}").select(
        F.lit(s).alias("sink"), (F.col("channel") if s == "tickets" else F.lit(None).cast("string")).alias("channel"))
        for s in ("tickets", "triage", "chat")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("sink", "channel").agg(F.count(F.lit(1)).alias("rows"))


def stream_assigned_ids(spark: SparkSession, source: DataFrame, name: str = "arrivals", files: int = 4) -> DataFrame:
    """#5 inside #99: arriving tickets without an id, one arrival a micro-batch, get theirs on the way to the sinks.

    Per sink: rows, tickets named, the first and last id (of tickets), and rows whose ticket is not in the ticket sink.
    """
    src = scratch_path(spark, f"{name}-in")
    arriving = source.withColumnRenamed("ticket_id", "request_id")
    each = stage_files(arriving, src, files)
    base, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    keys = ["request_id", "description", "customer_name", "channel", "created_at"]
    stream = ticket_stream(spark, src, arriving.schema, files_per_trigger=each)
    run_fanout(score_stream(drop_greetings(stream), keys=keys), base, ckpt, arrival=["created_at", "request_id"])
    sinks = {s: spark.read.parquet(f"{base}/{s}").select("ticket_id") for s in ("tickets", "triage", "chat")}
    out = None
    for s, rows in sinks.items():
        lost = rows.join(sinks["tickets"], "ticket_id", "left_anti").agg(F.count(F.lit(1))).scalar()
        ends = [f("ticket_id") if s == "tickets" else F.lit(None).cast("long") for f in (F.min, F.max)]
        part = rows.agg(F.lit(s).alias("sink"), F.count(F.lit(1)).alias("rows"), F.count_distinct("ticket_id").alias("tickets"),
                        ends[0].alias("first_id"), ends[1].alias("last_id")).withColumn("unknown", lost)
        out = part if out is None else out.unionByName(part)
    return out
