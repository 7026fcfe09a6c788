"""Diagnosis of misses, the pool's ranking and review, and what they refuse; frozen roots and reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import diagnosis
from gleaner.operators.contracts import ContractError
from gleaner.sources import tables

BOX, FAR = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
GOLD = "image string, cls int, j int, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.createDataFrame([("a", "g", "dev", "1"), ("b", "h", "dev", "2"), ("c", "i", "dev", "3"), ("p", "j", "pool", "4"), ("q", "k", "pool", "5")], "image string, group string, split string, sha256 string")
    gold = spark.createDataFrame([("a", 0, 1, *BOX), ("a", 0, 2, *FAR), ("b", 0, 1, *BOX), ("p", 0, 1, *BOX)], GOLD)
    scores = [("a", 0, 1, *BOX, 0.9), ("a", 0, 2, *FAR, 0.2), ("b", 0, 1, *BOX, 0.3), ("b", 1, 2, *BOX, 0.4), ("c", 0, 1, *BOX, 0.04), ("p", 0, 1, *BOX, 0.25)]
    predictions = spark.createDataFrame(scores, GOLD + ", score double")
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.6, 0.8], "p": [0.6, 0.8], "q": [-1.0, 0.0]}
    predicted = rows.select("image", "sha256").join(spark.createDataFrame(list(vectors.items()), "image string, embedding array<double>"), "image")
    return {"rows": rows, "gold": gold, "predictions": predictions, "predicted": predicted}


def dev(data):
    return diagnosis.records(data["rows"].where("split = 'dev'"), data["gold"], data["predictions"], data["predicted"])


def pool(data):
    return data["rows"].where("split = 'pool'").select(F.col("image").alias("sample_id"), F.col("group").alias("group_id"), "split", F.lit("x").alias("image_path"), "sha256")


def test_records_and_leave_group_out(data):
    got = {r.image: r for r in diagnosis.leave_group_out(dev(data)).collect()}
    assert {k: (r.objects, r.tp_high, r.tp_low, r.fp_high, r.fp_low, r.recoverable, r.unrecovered, r.low_count) for k, r in got.items()} == {
        "a": (2, 1, 2, 0, 0, 1, 0, 1), "b": (1, 0, 1, 0, 1, 1, 0, 2), "c": (0, 0, 0, 0, 0, 0, 0, 0),
    }
    assert got["a"].mass == pytest.approx(0.16) and got["b"].mass == pytest.approx(0.21 + 0.24)
    assert (got["a"].similarity, got["b"].similarity) == (0.0, 0.0) and got["c"].similarity == pytest.approx(1.4 / math.sqrt(2))
    only = dev(data).where("image <> 'b'")
    with pytest.raises(ContractError, match="No other failing groups: \\['g'\\]"):
        diagnosis.leave_group_out(only)


def test_rank_of_the_pool(data):
    proto = diagnosis.prototype(dev(data))
    assert proto.first().prototype == pytest.approx([math.sqrt(0.5)] * 2)
    got = {r.sample_id: r for r in diagnosis.rank_pool(pool(data), data["predicted"], data["predictions"], proto).collect()}
    similar = float(np.dot([0.6, 0.8], [math.sqrt(0.5)] * 2))
    assert got["p"].score == pytest.approx(similar * math.log1p(0.1875)) and (got["q"].similarity, got["q"].score, got["q"].mass) == (0.0, 0.0, 0.0)


def test_what_diagnosis_refuses(data):
    rows = data["rows"].where("split = 'dev'")
    with pytest.raises(ContractError, match="development only"):
        diagnosis.records(data["rows"], data["gold"], data["predictions"], data["predicted"])
    with pytest.raises(ContractError, match="stale"):
        diagnosis.records(rows.withColumn("sha256", F.lit("9")), data["gold"], data["predictions"], data["predicted"])
    with pytest.raises(ContractError, match="missing: c"):
        diagnosis.records(rows, data["gold"], data["predictions"], data["predicted"].where("image <> 'c'"))
    with pytest.raises(ContractError, match="No failures"):
        diagnosis.prototype(dev(data).where("image = 'c'"))
    proto = diagnosis.prototype(dev(data))
    with pytest.raises(ContractError, match="Pool columns"):
        diagnosis.rank_pool(pool(data).withColumn("label", F.lit(1)), data["predicted"], data["predictions"], proto)
    with pytest.raises(ContractError, match="stale"):
        diagnosis.rank_pool(pool(data).withColumn("sha256", F.lit("9")), data["predicted"], data["predictions"], proto)


def test_review_queue(spark, data):
    plans = spark.createDataFrame([("a", "random-1"), ("a", "diverse-1"), ("a", "random-1"), ("c", "diverse-1")], "sample_id string, plan string")
    got = {r.sample_id: (r.status, r.selected_by, [(p.box, p.score, p.label) for p in r.proposed_boxes]) for r in diagnosis.review_queue(plans, data["predictions"]).collect()}
    assert got == {"a": ("unreviewed", ["diverse-1", "random-1"], [(list(BOX), 0.9, 0)]), "c": ("unreviewed", ["diverse-1"], [])}


def test_frozen_roots(spark, tmp_path):
    df, root = spark.range(3), str(tmp_path / "root")
    assert tables.write_once(df, f"{root}/a/table")
    tables.freeze(spark, root)
    for write in (
        lambda: tables.write_once(df, f"{root}/b"), lambda: tables.write_once(df, f"{root}/a/table"), lambda: tables.write_json({}, f"{root}/a/r.json", spark),
        lambda: tables.write_all_or_nothing(df.withColumn("error", F.lit(None).cast("string")), f"{root}/c", f"{root}/errors"),
    ):
        with pytest.raises(ValueError, match="Frozen"):
            write()
    assert tables.write_once(df, str(tmp_path / "beside"))


def test_reports_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/reports/report.json"
    for value in ({"a": [1, "é"]}, {"a": 2.5}):
        tables.write_json(value, path, spark)
        assert tables.read_json(spark, path) == value
    assert [p.name for p in (tmp_path / "reports").iterdir() if not p.name.endswith(".crc")] == ["report.json"]
    with pytest.raises(ValueError):
        tables.write_json({"a": float("nan")}, path, spark)


def test_images_and_groups_are_not_broadcast(data):
    plan = dev(data)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" in line]
    last = diagnosis.leave_group_out(dev(data))._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")
    assert not any(part.startswith(" [group") for part in last[1:])
