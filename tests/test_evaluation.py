"""The evaluation raises on what would drop an image or count a changed one, and counts images without a box."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluation
from gleaner.operators.contracts import ContractError

GOLD = "image string, cls int, j int, x1 double, y1 double, x2 double, y2 double, occluded boolean"
PREDICTIONS = "image string, cls int, j int, x1 double, y1 double, x2 double, y2 double, score double"
BOX = (0.0, 0.0, 10.0, 10.0)


@pytest.fixture(scope="module")
def tables(spark):
    gold = spark.createDataFrame([("a", 0, 1, *BOX, True), ("a", 1, 2, *BOX, False), ("b", 0, 1, 0.0, 0.0, 90.0, 90.0, False)], GOLD)
    digests = {r.image: r.labels_sha256 for r in evaluation.labels_digests(gold).collect()}
    none = spark.range(1).select(evaluation.no_labels_digest(gold)).first()[0]
    rows = [("a", "dev", "1", digests["a"], "night"), ("b", "dev", "2", digests["b"], "day"), ("c", "dev", "3", none, "day"), ("d", "test", "4", none, None), ("e", "pool", "5", none, "day")]
    manifest = spark.createDataFrame(rows, "image string, split string, sha256 string, labels_sha256 string, timeofday string")
    predicted = manifest.where("split <> 'pool'").select("image", "sha256", F.lit("v1").alias("version"))
    predictions = spark.createDataFrame([("a", 0, 1, *BOX, 0.9), ("b", 1, 1, *BOX, 0.8), ("c", 0, 1, *BOX, 0.7), ("c", 0, 2, *BOX, 0.2)], PREDICTIONS)
    return {"manifest": manifest, "gold": gold, "predicted": predicted, "predictions": predictions}


def run(tables, splits=("dev", "test"), version="v1", **more):
    return evaluation.evaluate(**tables, splits=list(splits), version=version, tags=["timeofday"], objects={"small": F.col("x2") < 32, "occluded": F.col("occluded")}, **more)


def test_every_image_counts(tables, tmp_path):
    found = run(tables)
    got = {(r.split, r.tag): (r.images, r.objects, r.tp, r.fp, r.fn, r.recall, r.precision) for r in found.slices.collect()}
    assert got == {
        ("dev", "all"): (3, 3, 1, 2, 2, 1 / 3, 1 / 3), ("dev", "timeofday:night"): (1, 2, 1, 0, 1, 0.5, 1.0), ("dev", "timeofday:day"): (2, 1, 0, 2, 1, 0.0, 0.0),
        ("test", "all"): (1, 0, 0, 0, 0, None, None), ("test", "timeofday:unknown"): (1, 0, 0, 0, 0, None, None),
        ("dev", "object:small"): (1, 2, 1, None, 1, 0.5, None), ("dev", "object:occluded"): (1, 1, 1, None, 0, 1.0, None),
    }
    samples = {r.image: (r.objects, r.tp, r.fp, r.fn, r.recall) for r in found.samples.collect()}
    assert samples["c"] == (0, 0, 1, 0, None) and samples["d"] == (0, 0, 0, 0, None) and len(samples) == 4
    metrics = {r.split: r.AP for r in found.metrics.collect()}
    assert metrics["test"] is None and 0 < metrics["dev"] < 1
    folder = str(tmp_path / "out")
    assert all(found.publish(folder).values()) and not any(run(tables).publish(folder).values())
    with pytest.raises(ValueError, match="differs"):
        run(tables | {"predictions": tables["predictions"].where("image <> 'a'")}).publish(folder)


@pytest.mark.parametrize(
    "name,change,message",
    [
        ("predicted", lambda d: d.where("image <> 'd'"), "missing: d"),
        ("predicted", lambda d: d.withColumn("sha256", F.lit("9")), "stale"),
        ("predicted", lambda d: d.union(d.where("image = 'a'")), "unique image: a"),
        ("predicted", lambda d: d.withColumn("version", F.when(F.col("image") == "b", "v0").otherwise(F.col("version"))), "one version: b"),
        ("manifest", lambda d: d.where("split <> 'test'"), "empty split: test"),
        ("manifest", lambda d: d.union(d.where("image = 'a'")), "unique image: a"),
        ("gold", lambda d: d.withColumn("x2", F.col("x2") + 1), "labels changed"),
        ("gold", lambda d: d.where("image <> 'b'"), "labels changed: b"),
        ("predictions", lambda d: d.withColumn("score", F.lit(float("nan"))), "score is out of range"),
        ("predictions", lambda d: d.withColumn("x2", F.col("x1")), "box is empty"),
        ("predictions", lambda d: d.withColumn("cls", F.lit(70)), "unknown label"),
    ],
)
def test_what_stops_an_evaluation(tables, name, change, message):
    with pytest.raises(ContractError, match=message):
        run(tables | {name: change(tables[name])}, with_metrics=False)


def test_other_splits_do_not_matter(tables):
    bent = tables["predictions"].union(tables["predictions"].where("image = 'a'").withColumns({"image": F.lit("e"), "score": F.lit(9.0)}))
    assert run(tables | {"predictions": bent}, with_metrics=False).slices.where("tag = 'all'").count() == 2


def test_boxes_are_made_once(spark, tables):
    made = spark.sparkContext.accumulator(0)
    schema = tables["gold"].schema
    rows = [tuple(r) for r in tables["gold"].collect()]

    def counted(r):
        made.add(1)
        return r

    gold = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(counted), schema, verifySchema=False)
    assert run(tables | {"gold": gold}, with_metrics=False).slices.where("tag = 'all'").count() == 2 and made.value == len(rows)
