"""The inference flow: hits, interruptions, failures, refusals; and the journal as a state store."""

import datetime
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import inference, journal
from gleaner.operators.contracts import ContractError
from gleaner.streaming import journal as streams

RESULT = "sample_id string, sha256 string, embedding array<double>, latency_seconds double"


def rows_of(spark, ids="abc"):
    data = [(i, hashlib.sha256(i.encode()).hexdigest(), bytearray(i.encode()), n) for n, i in enumerate(ids)]
    return spark.createDataFrame(data, "sample_id string, sha256 string, content binary, position int")


def predict(row):
    return {"sample_id": row["sample_id"], "sha256": row["sha256"], "embedding": [1.0, 0.0], "latency_seconds": 0.001}


def check(row, result):
    if (result.get("sample_id"), result.get("sha256")) != (row["sample_id"], row["sha256"]):
        raise ValueError("identity mismatch")
    if not all(isinstance(x, float) and abs(x) < float("inf") for x in result["embedding"]) or not result["latency_seconds"] >= 0:
        raise ValueError("not finite")


def run(rows, root, function=predict, config=None, name="baseline", **more):
    more = {"wave_rows": 1, "order": "position", **more}
    return inference.infer(rows, function, config or {"weights": "first"}, str(root), name, RESULT, check, **more)


def states(spark, root, receipt_or_id):
    run_id = getattr(receipt_or_id, "run_id", receipt_or_id)
    ids = {hashlib.sha256(f"{i}:{hashlib.sha256(i.encode()).hexdigest()}:{json.dumps({'weights': 'first'})}".encode()).hexdigest(): i for i in "abc"}
    return {ids[r.key]: (r.status, r.attempts) for r in inference.jobs(spark, str(root), run_id).collect()}


def test_interrupted_run_is_taken_up(spark, tmp_path):
    """Attempts 1, 2, 1: the second row was claimed when the first run stopped."""
    rows = rows_of(spark)
    with pytest.raises(inference.Interrupted):
        run(rows, tmp_path, interrupt_after=1)
    assert not (tmp_path / "baseline/predictions").exists()
    run_id = os.listdir(tmp_path / "journal")[0]
    assert states(spark, tmp_path, run_id) == {"a": ("succeeded", 1), "b": ("running", 1)}
    second = run(rows, tmp_path)
    assert (second.recovered, second.computed, second.hits) == (1, 2, 1)
    after = {"a": ("succeeded", 1), "b": ("succeeded", 2), "c": ("succeeded", 1)}
    assert states(spark, tmp_path, second) == after
    published = spark.read.parquet(str(tmp_path / "baseline/predictions"))
    assert sorted(r.sample_id for r in published.collect()) == ["a", "b", "c"]
    files = sorted(os.listdir(tmp_path / "baseline/predictions"))
    third = run(rows, tmp_path)
    assert (third.recovered, third.computed, third.hits) == (0, 0, 3)
    assert states(spark, tmp_path, third) == after and sorted(os.listdir(tmp_path / "baseline/predictions")) == files


def test_a_wave_written_twice_counts_once(spark, tmp_path):
    """A driver that stopped after its commit but before it knew: the first committed result stays."""
    rows = rows_of(spark)
    first = run(rows, tmp_path)
    folder = f"{tmp_path}/journal/{first.run_id}"
    again = inference.events(spark, folder).where("event = 'succeed'").withColumns({"seq": F.col("seq") + 10**6, "result": F.lit("{}")})
    inference._append(again, folder, 99)
    assert run(rows, tmp_path).hits == 3


def test_other_model_or_content_is_refused(spark, tmp_path):
    rows = rows_of(spark)
    run(rows, tmp_path)
    with pytest.raises(ValueError, match="differs"):
        run(rows, tmp_path, config={"weights": "second"})
    assert run(rows, tmp_path, config={"weights": "second"}, name="other").computed == 3
    bent = rows.withColumn("content", F.lit("other bytes").cast("binary"))
    with pytest.raises(ContractError, match="content"):
        run(bent, tmp_path)
    with pytest.raises(ContractError, match="unique"):
        run(rows.union(rows), tmp_path)
    with pytest.raises(ContractError, match="there"):
        run(rows.limit(0), tmp_path)


@pytest.mark.parametrize("field,value", [("sample_id", "other"), ("sha256", "other"), ("embedding", [float("inf")]), ("latency_seconds", -1)])
def test_corrupt_cached_result_is_refused(spark, tmp_path, field, value):
    rows = rows_of(spark)
    first = run(rows, tmp_path)
    folder = f"{tmp_path}/journal/{first.run_id}"
    log = inference.events(spark, folder).collect()
    bent = [(r.key, r.seq - 10**6, r.event, json.dumps(json.loads(r.result) | {field: value}), r.error) for r in log if r.event == "succeed"][:1]
    inference._append(spark.createDataFrame(bent, inference.EVENTS), folder, 98)
    with pytest.raises(ContractError, match="Cached result"):
        run(rows, tmp_path)


def test_failures_are_tried_twice_and_never_published(spark, tmp_path):
    def wrong(row):
        return predict(row) | {"sha256": "wrong"} if row["sample_id"] == "b" else predict(row)

    rows = rows_of(spark)
    with pytest.raises(inference.Failed, match="1 of 3"):
        run(rows, tmp_path, wrong, wave_rows=2)
    run_id = os.listdir(tmp_path / "journal")[0]
    assert states(spark, tmp_path, run_id) == {"a": ("succeeded", 1), "b": ("failed", 2), "c": ("succeeded", 1)}
    assert [r.error for r in inference.jobs(spark, str(tmp_path), run_id).where("status = 'failed'").collect()] == ["ValueError"]
    assert not (tmp_path / "baseline/predictions").exists()
    assert run(rows, tmp_path, wrong, strict=False).states == {"succeeded": 2, "failed": 1}
    assert run(rows, tmp_path).computed == 1  # a later run may mend it


def test_one_runner(spark, tmp_path):
    with inference.single_runner(spark, str(tmp_path)):
        with pytest.raises(RuntimeError, match="Another run"), inference.single_runner(spark, str(tmp_path)):
            pass
        with inference.single_runner(spark, str(tmp_path), stale_after=-1.0):
            pass
    with inference.single_runner(spark, str(tmp_path)):
        pass


def test_stream_of_jobs_equals_the_fold(spark, tmp_path):
    """States kept by the stream over three starts are those of all events folded at once."""
    draw, start = random.Random(8), datetime.datetime(2026, 1, 1)
    schema = "key string, seq long, event string, result string, error string, ts timestamp"
    log = []
    for seq in range(300):
        event = draw.choice(["enqueue", "start", "succeed", "fail", "recover", "start"])
        log.append((f"k{draw.randrange(40)}", seq, event, f"r{seq}" if event == "succeed" else None, "E" if event == "fail" else None, start + datetime.timedelta(seconds=seq)))
    draw.shuffle(log)
    for part in range(3):
        spark.createDataFrame(log[100 * part : 100 * part + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.write_batches(streams.job_states(stream, "10 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in streams.latest_states(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in journal.fold(spark.createDataFrame(log, schema)).collect()} and len(got) == 40


def test_stale_claims_expire(spark, tmp_path):
    schema = "key string, seq long, event string, result string, error string, ts timestamp"
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    steps = [
        [("a", 1, "start", None, None, at(0)), ("b", 2, "start", None, None, at(0)), ("c", 3, "start", None, None, at(50))],
        [("b", 4, "succeed", "r", None, at(55)), ("d", 5, "enqueue", None, None, at(75))],
        [("d", 6, "start", None, None, at(76))],
    ]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.write_batches(streams.job_states(stream, "1 hour", "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.key: (r.status, r.attempts) for r in streams.latest_states(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": ("pending", 1), "b": ("succeeded", 1), "c": ("running", 1), "d": ("running", 1)}
