"""A job journal as an event log: states are a fold of it, so any number of writers may append, and a replay of the
same events changes nothing. A job has at most one committed result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The states of a job.
STATES = ("pending", "running", "succeeded", "failed")


def fold(log: DataFrame) -> DataFrame:
    """log: key, seq, event (enqueue, start, succeed, fail, recover), result, error. By key: the state, the number of
    starts, the first result, and the error of the last attempt. Success is final."""
    w = F.struct("seq", "event", "error")
    sums = log.groupBy("key").agg(
        F.count(F.when(F.col("event") == "start", 1)).alias("attempts"),
        F.min(F.when(F.col("event") == "succeed", F.struct("seq", "result"))).alias("done"),
        F.max(w).alias("last"),
    )
    state = (
        F.when(F.col("done").isNotNull(), "succeeded").when(F.col("last.event") == "start", "running")
        .when(F.col("last.event") == "fail", "failed").otherwise("pending")
    )
    error = F.when(state == "failed", F.col("last.error"))
    return sums.select("key", state.alias("status"), "attempts", F.col("done.result").alias("result"), error.alias("error"))


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs that a stopped runner left running are pending again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def enqueue(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """jobs and a pending one for each new key."""
    new = keys.select("key").distinct().join(jobs, "key", "left_anti")
    return jobs.unionByName(new.withColumns({"status": F.lit("pending"), "attempts": F.lit(0).cast("long")}), allowMissingColumns=True)


def todo(jobs: DataFrame, attempts: int = 2) -> DataFrame:
    """Jobs to run: not succeeded, and with attempts left."""
    return jobs.where((F.col("status") != "succeeded") & (F.col("attempts") < attempts))


def attempts_in_order(log: DataFrame) -> DataFrame:
    """Each start with its number."""
    w = W.partitionBy("key").orderBy("seq")
    return log.where("event = 'start'").withColumn("attempt", F.row_number().over(w))
