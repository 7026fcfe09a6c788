"""Which misses a lower score would recover, the prototype of the images that have them, and the pool ranked by it.

One matching at the low score holds that at the high one, so an image's recoverable misses are the matches in between.
Rows are checked before they count: only development images, each with the prediction of its own content.

Tables of images and groups grow with the input, so they are joined by sorting: files of few columns look small enough to be
broadcast, and would pass through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..sources.scratch import written
from . import contracts, matching, selection
from .contracts import ContractError

LOW, HIGH = selection.LOW, selection.HIGH


def same_content(rows: DataFrame, predicted: DataFrame, key: str) -> None:
    """An error if a row has no prediction, or one of other content (sha256)."""
    contracts.enforce(contracts.complete(rows, predicted.join(rows.select(key).hint("merge"), key, "left_semi"), key, "sha256"))


def records(rows: DataFrame, gold: DataFrame, predictions: DataFrame, predicted: DataFrame) -> DataFrame:
    """image, group, objects, tp_high, tp_low, fp_high, fp_low, recoverable, unrecovered, low_count, mass, embedding of each
    row. rows: image, group, split, sha256, development only; predicted: image, sha256, embedding."""
    bad = contracts.violations(rows.where("split is distinct from 'dev'"), "development only", F.col("image"), F.col("split"))
    contracts.enforce(bad, contracts.unique(rows, "image"))
    same_content(rows, predicted, "image")
    own = lambda df: df.join(rows.select("image").hint("merge"), "image", "left_semi")
    gold, predictions = own(gold), own(predictions)
    matched = matching.match(gold, predictions, LOW)
    high = F.col("score") >= HIGH
    parts = (
        gold.select("image", *_sums(objects=F.lit(1)))
        .union(matched.select("image", *_sums(tp_low=F.lit(1), tp_high=high.cast("int"))))
        .union(predictions.where(F.col("score") >= LOW).select("image", *_sums(n_low=F.lit(1), n_high=high.cast("int"), mass=F.when(~high, F.col("score") * (1 - F.col("score"))))))
    )
    sums = parts.groupBy("image").agg(*[F.sum(c).alias(c) for c in _SUMS])
    whole = rows.select("image", "group").join(predicted.select("image", "embedding").hint("merge"), "image").join(sums.hint("merge"), "image", "left").na.fill(0, list(_SUMS))
    n = lambda c: F.col(c).cast("long")
    return whole.select(
        "image", "group", n("objects").alias("objects"), n("tp_high").alias("tp_high"), n("tp_low").alias("tp_low"), (n("n_high") - n("tp_high")).alias("fp_high"),
        (n("n_low") - n("tp_low")).alias("fp_low"), (n("tp_low") - n("tp_high")).alias("recoverable"), (n("objects") - n("tp_low")).alias("unrecovered"),
        (n("n_low") - n("n_high")).alias("low_count"), "mass", "embedding",
    )


_SUMS = ("objects", "tp_low", "tp_high", "n_low", "n_high", "mass")


def _sums(**given: Column) -> list[Column]:
    return [F.coalesce(given.get(c, F.lit(0)), F.lit(0)).cast("double").alias(c) for c in _SUMS]


def prototype(diagnosed: DataFrame) -> DataFrame:
    """One row: the centroid of the embeddings of images with recoverable misses. An error if there are none."""
    failed = written(diagnosed.where("recoverable > 0").select("embedding"))
    if not failed.take(1):
        raise ContractError("No failures to make a prototype of")
    return selection.centroid(failed, "embedding")


def rank_pool(pool: DataFrame, predicted: DataFrame, predictions: DataFrame, proto: DataFrame) -> DataFrame:
    """sample_id, group_id, mass, similarity, score of the pool, the score being similarity x ln(1 + mass). pool: its own
    columns only, rows of the pool only; predicted: image, sha256, embedding."""
    contracts.enforce(contracts.pool(pool))
    own = predicted.select(F.col("image").alias("sample_id"), "sha256", "embedding")
    same_content(pool, own, "sample_id")
    mass = selection.low_confidence_mass(predictions.withColumnRenamed("image", "sample_id"), "sample_id").select("sample_id", "mass")
    rows = pool.select("sample_id", "group_id").join(own.select("sample_id", "embedding"), "sample_id").join(mass, "sample_id", "left").na.fill(0.0, ["mass"])
    similar = rows.join(F.broadcast(proto)).withColumn("similarity", F.greatest(F.lit(0.0), dot(F.col("embedding"), F.col("prototype"))))
    return similar.select("sample_id", "group_id", "mass", "similarity", (F.col("similarity") * F.log1p("mass")).alias("score"))


def leave_group_out(diagnosed: DataFrame) -> DataFrame:
    """diagnosed with similarity and score by the prototype of the failures of all other groups. An error if a group has no
    other one that fails."""
    diagnosed = written(diagnosed)
    marked = diagnosed.withColumn("failed", F.col("recoverable") > 0)
    own = selection.leave_group_out(marked, "embedding", "group", "failed")
    alone = diagnosed.join(own.select("group").hint("merge"), "group", "left_anti").select("group").distinct().take(5)
    if alone:
        raise ContractError(f"No other failing groups: {sorted(str(r[0]) for r in alone)}")
    similarity = F.greatest(F.lit(0.0), dot(F.col("embedding"), F.col("prototype")))
    scored = diagnosed.join(own.hint("merge"), "group").withColumn("similarity", similarity)
    return scored.withColumn("score", F.col("similarity") * F.log1p("mass")).drop("prototype")


def review_queue(plans: DataFrame, predictions: DataFrame, least: float = HIGH) -> DataFrame:
    """sample_id, status, selected_by (the plans that chose it, sorted), proposed_boxes (what was predicted at the least
    score or above, best first). plans: sample_id, plan. Proposals are the model's, not labels."""
    chosen = plans.groupBy("sample_id").agg(F.array_sort(F.collect_set("plan")).alias("selected_by"))
    box = F.struct(-F.col("score"), "j", F.struct(F.array(*matching.BOX).alias("box"), "score", F.col("cls").alias("label")).alias("proposal"))
    proposed = predictions.where(F.col("score") >= least).join(chosen.select(F.col("sample_id").alias("image")), "image", "left_semi")
    proposed = proposed.groupBy(F.col("image").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(box)), lambda b: b["proposal"]).alias("proposed_boxes"))
    none = F.expr("cast(array() as array<struct<box:array<double>,score:double,label:int>>)")
    return chosen.join(proposed, "sample_id", "left").select("sample_id", F.lit("unreviewed").alias("status"), "selected_by", F.coalesce("proposed_boxes", none).alias("proposed_boxes"))
