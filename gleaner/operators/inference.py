"""A function run over the rows of a manifest, with a journal that survives an interruption at any point.

A row's key is the digest of its id, its content's digest and the configuration, so that a change of any of them is new
work and all else is a hit. Keys without a result are dealt into waves of `wave_rows` rows. A wave is claimed (its starts
are written), computed where its rows are, and its events written as one commit: whoever stops in between leaves claims,
which the next run finds and takes up. Computation is at least once; the first committed result of a key is the one that
counts (`journal.fold`), so that a wave which is written twice changes nothing. Nothing but counts reaches the driver.

The journal is a folder of Parquet files, one folder for each commit. A run's results become a table that is written once,
under the identity of data, configuration and splits; another identity is refused before anything is computed."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest
from ..sources.scratch import written
from ..sources.tables import exists, write_once
from . import journal
from .contracts import ContractError
from .running import cuts_of, running

EVENTS = "key string, seq long, event string, result string, error string"
#: Attempts that a run gives a key.
ATTEMPTS = 2


class Interrupted(RuntimeError):
    """The run stopped between a claim and its results, as told."""


class Failed(RuntimeError):
    """Keys have no attempts left."""


@dataclass
class Receipt:
    """What a run did. computed, hits and recovered are numbers of keys."""

    run_id: str
    rows: int
    computed: int
    hits: int
    recovered: int
    states: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0


@contextmanager
def single_runner(spark: SparkSession, folder: str, stale_after: float = 24 * 3600.0) -> Iterator[None]:
    """Hold a folder's lock; an error if another one holds it. The file is made only if it isn't there, which file systems
    with atomic creation decide for all. A lock older than stale_after seconds, of a run that was killed, is taken over."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runner.lock")
    place = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if place.exists(path) and time.time() - place.getFileStatus(path).getModificationTime() / 1000 > stale_after:
        place.delete(path, False)
    try:
        place.create(path, False).close()
    except Exception as e:
        raise RuntimeError(f"Another run holds {folder}") from e
    try:
        yield
    finally:
        place.delete(path, False)


def keys_of(rows: DataFrame, config: dict) -> DataFrame:
    """rows (sample_id, sha256 and more) with the key of each."""
    return rows.withColumn("key", digest(F.col("sample_id"), F.col("sha256"), F.lit(json.dumps(config, sort_keys=True))))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a journal; none if there isn't one yet."""
    if not exists(spark, f"{folder}/events"):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{folder}/events")


def _append(df: DataFrame, folder: str, step: int) -> None:
    columns = [F.col(name).cast(kind).alias(name) for name, kind in (f.split() for f in EVENTS.split(", "))]
    df.select(*columns).write.parquet(f"{folder}/events/step={step:09d}-{uuid.uuid4().hex[:8]}")


def _next_step(log: DataFrame) -> int:
    return (log.agg(F.max("seq")).first()[0] or 0) // 1000 + 1


def _run(rows: DataFrame, function: Callable[[dict], dict], check: Callable[[dict, dict], None], attempts: int, step: int) -> DataFrame:
    """The events of claimed rows: the result, or the errors of all attempts and the claims in between."""

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key, seq = row.pop("key"), step * 1000
                for attempt in range(1, attempts + 1):
                    if attempt > 1:
                        out.append((key, seq := seq + 1, "start", None, None))
                    try:
                        result = function(dict(row))
                        check(row, result)
                        text = json.dumps(result, allow_nan=False)
                    except Exception as e:  # noqa: BLE001  any error is the attempt's
                        out.append((key, seq := seq + 1, "fail", None, type(e).__name__))
                    else:
                        out.append((key, seq := seq + 1, "succeed", text, None))
                        break
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    names = [f.split()[0] for f in EVENTS.split(", ")]
    return rows.mapInArrow(work, EVENTS)


def _refuse_invalid(rows: DataFrame, done: DataFrame, check: Callable[[dict, dict], None]) -> None:
    """An error if a result of the journal isn't one of its row."""

    def faults(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                result = row.pop("result")
                try:
                    check(row, json.loads(result))
                except Exception as e:  # noqa: BLE001
                    found.append((str(row["sample_id"]), f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["sample_id", "error"])

    bad = rows.join(done.select("key", "result"), "key").drop("key").mapInArrow(faults, "sample_id string, error string").take(5)
    if bad:
        raise ContractError("Cached result: " + "; ".join(f"{r.sample_id}: {r.error}" for r in bad))


def infer(
    rows: DataFrame,
    function: Callable[[dict], dict],
    config: dict,
    root: str,
    name: str,
    result_schema: str,
    check: Callable[[dict, dict], None] = lambda row, result: None,
    version: str = "1",
    wave_rows: int = 100_000,
    order: str | None = None,
    attempts: int = ATTEMPTS,
    interrupt_after: int | None = None,
    strict: bool = True,
) -> Receipt:
    """Results of function(row) for all rows (sample_id, sha256, more), published as `{root}/{name}/predictions`.

    check raises if a result isn't valid for its row, and is asked for new results and for those of the journal. Where rows
    have a column `content`, its digest must be sha256. order: a number by which rows are dealt into waves, else the key.
    interrupt_after: stop when so many waves are done and the next one is claimed. With strict, a key without a result and
    attempts is an error once all waves are done, and nothing is published."""
    spark, began = rows.sparkSession, time.time()
    ids = rows.agg(F.count("*").alias("n"), F.count_distinct("sample_id", "sha256").alias("ids")).first()
    if not ids.n or ids.n != ids.ids:
        raise ContractError("Rows must be there and unique")
    if "content" in rows.columns and rows.where(~F.sha2(F.col("content").cast("binary"), 256).eqNullSafe(F.col("sha256"))).take(1):
        raise ContractError("A row's content isn't that of its digest")
    run_id = spark.range(1).select(digest(F.lit(version), F.lit(json.dumps(config, sort_keys=True)))).first()[0]
    identity = spark.createDataFrame([(run_id, version, json.dumps(config, sort_keys=True))], "run_id string, version string, config string")
    write_once(identity.coalesce(1), f"{root}/{name}/identity")  # another one is refused here
    folder = f"{root}/journal/{run_id}"
    keyed = written(keys_of(rows, config))
    with single_runner(spark, folder):
        log = events(spark, folder)
        step = _next_step(log)
        before = journal.fold(log).join(keyed.select("key"), "key", "left_semi")
        _refuse_invalid(keyed, before.where("status = 'succeeded'"), check)
        recovered = before.where("status = 'running'").select("key")
        stale = recovered.count()
        if stale:
            _append(recovered.selectExpr("key", f"{step * 1000}L AS seq", "'recover' AS event", "NULL AS result", "NULL AS error"), folder, step)
            step += 1
        done = before.where("status = 'succeeded'").select("key")
        hits = done.count()
        todo = keyed.join(done, "key", "left_anti").withColumn("at", F.col(order).cast("double") if order else F.conv(F.substring("key", 1, 13), 16, 10).cast("double"))
        total = {"nth": F.lit(1)}
        dealt = running(todo, [], "at", [F.asc("at"), F.asc("key")], total, cuts_of(todo, "at")) if hits < ids.n else todo.withColumn("nth", F.lit(0))
        waves = written(dealt.withColumn("wave", F.floor((F.col("nth") - 1) / wave_rows)).drop("nth", "at"), "wave")
        for wave in range(-(-(ids.n - hits) // wave_rows)):
            own = waves.where(F.col("wave") == wave).drop("wave")
            _append(own.selectExpr("key", f"{step * 1000}L AS seq", "'start' AS event", "NULL AS result", "NULL AS error"), folder, step)
            if interrupt_after is not None and wave == interrupt_after:
                raise Interrupted("after a claim, before its results")
            _append(_run(own, function, check, attempts, step), folder, step)
            step += 1
        after = journal.fold(events(spark, folder)).join(keyed.select("key"), "key", "left_semi")
        states = {r.status: r.n for r in after.groupBy("status").agg(F.count("*").alias("n")).collect()}
    good = states.get("succeeded", 0)
    if good < ids.n:
        if strict:
            raise Failed(f"{ids.n - good} of {ids.n} rows have no result")
    else:
        results = keyed.select("key", "sample_id", "sha256").join(after.select("key", "result"), "key")
        write_once(results.select("sample_id", "sha256", F.from_json("result", result_schema).alias("result")), f"{root}/{name}/predictions")
    return Receipt(run_id, ids.n, good - hits, hits, stale, states, time.time() - began)


def jobs(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The states of a run's keys."""
    return journal.fold(events(spark, f"{root}/journal/{run_id}"))
