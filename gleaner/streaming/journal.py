"""The journal and event counts over streams. Batch and stream give the same rows for the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of Parquet files of a folder; time stamps with a zone, as watermarks need."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; windows close when the watermark has passed them."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def write_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to a folder of its number, replaced if it is run again: rows come exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "status string, attempts long, done_seq long, result string, last_seq long, last_event string, error string, lease long"
OUTPUT = "key string, status string, attempts long, result string, error string"


class JobStates(StatefulProcessor):
    """A job's state, kept by key: the fold of its events in any order of arrival. A claim of which nothing is heard until
    the watermark is `lease_ms` past it is pending again."""

    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues):
        was = self.job.get() if self.job.exists() else (None, 0, None, None, None, None, None, None)
        _, attempts, done_seq, result, last_seq, last_event, error, lease = was
        for row in rows:
            attempts += row.event == "start"
            if row.event == "succeed" and (done_seq is None or row.seq < done_seq):
                done_seq, result = row.seq, row.result
            if last_seq is None or (row.seq, row.event, row.error or "") > (last_seq, last_event, error or ""):
                last_seq, last_event, error = row.seq, row.event, row.error
                if row.event == "start":
                    lease = int(row.ts.timestamp() * 1000) + self.lease_ms
        status = _status(done_seq, last_event)
        if status == "running":
            self.handle.registerTimer(lease)
        self.job.update((status, attempts, done_seq, result, last_seq, last_event, error, lease))
        yield Row(key=key[0], status=status, attempts=attempts, result=result, error=error if status == "failed" else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, attempts, done_seq, result, last_seq, last_event, error, lease = self.job.get()
        if status == "running" and expiredTimerInfo.getExpiryTimeInMs() >= lease:
            self.job.update(("pending", attempts, done_seq, result, last_seq, "recover", error, lease))
            yield Row(key=key[0], status="pending", attempts=attempts, result=result, error=None)

    def close(self) -> None:
        pass


def _status(done_seq, last_event: str) -> str:
    return "succeeded" if done_seq is not None else {"start": "running", "fail": "failed"}.get(last_event, "pending")


def job_states(events: DataFrame, lease: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The changed states of jobs in each batch (key, status, attempts, result, error). events: key, seq, event, result,
    error and ts, a stream; events that come `late` after newer ones are dropped. Needs the RocksDB state store."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lease_ms = spark.range(1).select((F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {lease})"))).first()[0]
    return events.withWatermark("ts", late).groupBy("key").transformWithState(JobStates(lease_ms), OUTPUT, "Update", "EventTime")


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job that `write_batches` has written."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    newest = F.max_by(F.struct("status", "attempts", "result", "error"), F.col("batch").cast("long")).alias("s")
    return rows.groupBy("key").agg(newest).select("key", "s.*")
