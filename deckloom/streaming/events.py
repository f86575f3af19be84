"""The job event log as a stream.

Every sink below writes one folder per micro-batch and overwrites it when the batch is replayed,
so a lost executor or a restarted query leaves each event counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from deckloom.operators.gates import micro_usd
from deckloom.operators.skew import first_by
from deckloom.sources.sinks import folders, remove

c = F.col

# Statuses that end a job.
TERMINAL = ["succeeded", "failed", "failed_quality", "cancelled"]


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Append-only event files as a stream; the schema comes from the files already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now and stop."""
    query = (stream.writeStream.foreachBatch(each_batch).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


# ---- tail ------------------------------------------------------------------------------------


def tail_events(events: DataFrame, after: int = 0, status: Column | None = None) -> DataFrame:
    """Events of each job after an offset, up to and including its first terminal one.

    A repeated sequence number counts once. Rows come in (job, sequence) order by a range sort.
    """
    status = status if status is not None else c("status")
    unique = first_by(events.withColumn("_end", status.isin(TERMINAL)), ["job_id", "sequence"], ["created_at"])
    ends = unique.filter("_end").groupBy("job_id").agg(F.min("sequence").alias("_last"))
    kept = unique.join(ends, "job_id", "left").filter(
        (c("sequence") > after) & (c("_last").isNull() | (c("sequence") <= c("_last"))))
    return kept.drop("_end", "_last").orderBy("job_id", "sequence")


def tail_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the event log at ``path``; read it with ``tail_events``."""
    return run_to_end(stream, lambda df, n: _write_batch(df, path, n), checkpoint)


# ---- job state -------------------------------------------------------------------------------


def _latest(value: Column, name: str) -> Column:
    """The last non-null value by sequence, as a combining maximum."""
    return F.max(F.when(value.isNotNull(), F.struct("sequence", value.alias("v")))).alias(name)


def _state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(
        F.max("sequence").alias("last_sequence"), _latest(c("status"), "_s"), _latest(c("progress"), "_p"),
        _latest(c("stage"), "_g"), F.min(F.when(c("status") == "running", c("created_at"))).alias("started_at"),
        F.max(F.when(c("status").isin(TERMINAL), F.struct("sequence", c("created_at").alias("v")))).alias("_f"))


def _shown(state: DataFrame) -> DataFrame:
    done = c("_s.v") == "succeeded"
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("_p.v")))
    return state.select(
        "job_id", "last_sequence", c("_s.v").alias("status"),
        F.when(done, 1.0).otherwise(F.coalesce(clamped, F.lit(0.0))).alias("progress"), c("_g.v").alias("stage"),
        "started_at", c("_f.v").alias("finished_at"))


def job_state(events: DataFrame) -> DataFrame:
    """Latest status, progress and stage of every job, with its start and finish.

    Columns: job_id, sequence, created_at and nullable status, progress, stage. Progress stays in
    0..1 and is 1 after success.
    """
    return _shown(_state(events))


#: Batches of changes that are merged into one table of all jobs.
MERGE_EVERY = 8


def job_state_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same over a stream: partial sums per task, one small state row per job, changed jobs out.

    A batch writes the jobs that it changed to ``path``/changes. Every ``MERGE_EVERY`` batches they are merged with the last table of all jobs into a
    new one in ``path``/merged; what the table before it was made of goes then, so that any batch can be replayed and the number of folders
    stays bounded.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _write_batch(batch, f"{path}/changes", number)
        if (number + 1) % MERGE_EVERY:
            return
        _newest_rows(spark, path, number).write.mode("overwrite").parquet(f"{path}/merged/batch={number}")
        kept = max((m for m in folders(spark, f"{path}/merged") if m < number), default=-1)
        for part in ("changes", "merged"):
            for old in folders(spark, f"{path}/{part}"):
                if old < kept or (old == kept and part == "changes"):
                    remove(spark, f"{path}/{part}/batch={old}")

    return run_to_end(_state(stream), each, checkpoint, "update")


def _newest_rows(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """Newest state row of each job up to a batch: of the last merged table before it and the changes since."""
    merged = max((m for m in folders(spark, f"{path}/merged") if m < upto), default=-1)
    parts = [(n, f"{path}/changes/batch={n}") for n in folders(spark, f"{path}/changes") if merged < n <= upto]
    parts += [(merged, f"{path}/merged/batch={merged}")] if merged >= 0 else []
    rows = None
    for number, folder in parts:
        part = spark.read.parquet(folder).withColumn("_batch", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    body = [n for n in rows.columns if n not in ("job_id", "_batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*body), "_batch").alias("_r")).select("job_id", "_r.*")


def read_job_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest state row of each job from the batches written so far: one merged table and a few batches of changes."""
    return _shown(_newest_rows(spark, path, max(folders(spark, f"{path}/changes") + folders(spark, f"{path}/merged")) + 1))


# ---- spend -------------------------------------------------------------------------------------


class _Spend(StatefulProcessor):
    """Running cost of one job: its last sequence, cost in millionths and whether the budget was passed before."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spend = handle.getValueState("spend", "last_sequence long, micro long, breached boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        # Most jobs bring a handful of rows: plain numbers, as a frame for each job would cost more than its rows.
        given: dict[int, int] = {}
        for row in rows:
            if row.sequence is not None:
                given[row.sequence] = min(given.get(row.sequence, row.micro), row.micro)
        known = self.spend.get()
        last, spent, breached = known if known is not None else (None, 0, False)
        newest = last
        for sequence in sorted(given):
            if last is not None and sequence <= last:
                yield Row(job_id=key[0], kind="late", sequence=sequence, micro=None)
                continue
            spent, newest = spent + given[sequence], sequence
            if spent > self.limit and not breached:
                breached = True
                yield Row(job_id=key[0], kind="breach", sequence=sequence, micro=spent)
        if newest != last:
            self.spend.update((newest, spent, breached))

    def close(self) -> None:
        pass


def spend_monitor(stream: DataFrame, max_usd: float, path: str, checkpoint: str) -> StreamingQuery:
    """Emit each job once, at the row where its running cost passes the budget.

    Each job has one value in the state store (last sequence, cost, breached), so a batch costs what the jobs that it changes cost, however many
    there are. A repeated sequence number counts once. Rows that come after a later sequence of their job was already counted break the order: they
    change nothing and are kept for ``read_late``. State that outlives a job is what tells its late rows from new ones, so it stays.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("job_id", c("sequence").cast("bigint").alias("sequence"),
                         F.coalesce(micro_usd().cast("bigint"), F.lit(0)).alias("micro"))
    job_type = rows.schema["job_id"].dataType.simpleString()
    found = rows.groupBy("job_id").transformWithState(
        _Spend(round(max_usd * 1_000_000)), f"job_id {job_type}, kind string, sequence long, micro long", "append", "none")
    return run_to_end(found, lambda df, n: _write_batch(df, path, n), checkpoint)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came too late to count: (job_id, sequence)."""
    return spark.read.parquet(path).filter("kind = 'late'").select("job_id", "sequence")


def read_breaches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("kind = 'breach'").select(
        "job_id", c("sequence").alias("breach_at"), (c("micro") / 1_000_000).alias("spent_usd"))
