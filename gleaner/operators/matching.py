"""One-to-one matching of predicted and gold boxes, and metrics over slices.

gold: image, cls, j, x1, y1, x2, y2. predictions: the same and score. Labels never interact, so matching runs by image
and class: pairs are joined on both, and a fold over the predictions, best score first, takes for each the free gold
box with the greatest overlap, the later one on ties. Matching at a low threshold holds the matching at a higher one:
predictions above it come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iou, ratio
from ..sources.scratch import written
from .curves import Lanes, interpolated

OVERLAP = 0.5
BOX = ("x1", "y1", "x2", "y2")


def overlaps(gold: DataFrame, predictions: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Pairs of one image and class with at least that overlap: image, cls, j, p, score, iou."""
    g = gold.select("image", "cls", "j", *BOX)
    p = predictions.select("image", "cls", F.col("j").alias("p"), "score", *[F.col(c).alias(f"p{c}") for c in BOX])
    pairs = g.join(p, ["image", "cls"])
    overlap = iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"p{c}") for c in BOX))
    return pairs.select("image", "cls", "j", "p", "score", overlap.alias("iou")).where(F.col("iou") >= least)


def match(gold: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The matched pairs: image, cls, p, j, score; predictions below the threshold take no part."""
    pairs = overlaps(gold, predictions.where(F.col("score") >= threshold))
    wanted = pairs.groupBy("image", "cls", "p", "score").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("i"), (-F.col("j")).alias("n")))), lambda x: -x["n"]).alias("free")
    )
    ordered = wanted.groupBy("image", "cls").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "p", "free"))).alias("all")
    )
    start = F.expr("named_struct('used', cast(array() as array<bigint>), 'pairs', cast(array() as array<struct<p:bigint,j:bigint,score:double>>))")

    def take(acc: Column, x: Column) -> Column:
        free = F.array_except(x["free"].cast("array<bigint>"), acc["used"])
        got = F.slice(free, 1, 1)
        pair = F.transform(got, lambda j: F.struct(x["p"].cast("long").alias("p"), j.alias("j"), (-x["s"]).alias("score")))
        return F.struct(F.concat(acc["used"], got).alias("used"), F.concat(acc["pairs"], pair).alias("pairs"))

    return ordered.select("image", "cls", F.inline(F.aggregate("all", start, take)["pairs"]))


def counts(gold: DataFrame, predictions: DataFrame, matched: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By image: objects, tp, fp, fn. Images without any counted box are left out."""
    parts = (
        gold.select("image", F.lit(1).alias("o"), F.lit(0).alias("p"), F.lit(0).alias("t"))
        .union(predictions.where(F.col("score") >= threshold).select("image", F.lit(0), F.lit(1), F.lit(0)))
        .union(matched.where(F.col("score") >= threshold).select("image", F.lit(0), F.lit(0), F.lit(1)))
    )
    sums = parts.groupBy("image").agg(F.sum("o").alias("objects"), F.sum("p").alias("n"), F.sum("t").alias("tp"))
    return sums.select("image", "objects", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("objects") - F.col("tp")).alias("fn"))


def with_manifest(manifest: DataFrame, samples: DataFrame) -> DataFrame:
    """The counts of all images of the manifest (image); those without any counted box have zeros."""
    return manifest.select("image").distinct().join(samples, "image", "left").na.fill(0, ["objects", "tp", "fp", "fn"])


def sliced(samples: DataFrame, tags: list[Column]) -> DataFrame:
    """Sums by tag; a sample counts for each of its tags and for `all`. samples: objects, tp, fp, fn."""
    spread = samples.select(F.explode(F.array(F.lit("all"), *tags)).alias("tag"), "objects", "tp", "fp", "fn")
    sums = spread.groupBy("tag").agg(
        F.count("*").alias("images"), *[F.sum(c).alias(c) for c in ("objects", "tp", "fp", "fn")]
    )
    return sums.withColumns(
        {"recall": ratio(F.col("tp"), F.col("objects")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))}
    )


def object_slices(gold: DataFrame, matched: DataFrame, tags: list[Column]) -> DataFrame:
    """Sums over gold boxes by tag; tags may be null. There is no fp, so no precision."""
    hit = gold.join(matched.select("image", "cls", "j", F.lit(1).alias("hit")), ["image", "cls", "j"], "left")
    spread = hit.select("image", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(F.array_compact(F.array(*tags))).alias("tag"))
    sums = spread.groupBy("tag").agg(F.count_distinct("image").alias("images"), F.count("*").alias("objects"), F.sum("hit").alias("tp"))
    return sums.withColumns({"fn": F.col("objects") - F.col("tp"), "recall": ratio(F.col("tp"), F.col("objects"))})


def average_precision(scored: DataFrame, group: list[str], tie: list[Column]) -> DataFrame:
    """scored: rows of group with score, hit (0/1) and positives (of the group). Precision interpolated at 101 levels of
    recall, best score first."""
    scored = written(scored)  # for the ranges, the blocks and the positives
    positives = scored.groupBy(*group).agg(F.max("positives").alias("positives")).withColumn("lane", F.lit(0))
    rows = scored.withColumns({"hit": F.col("hit").cast("long"), "skip": F.lit(0).cast("long"), "rank": F.lit(0).cast("long")})
    return interpolated(rows, group, [F.desc("score"), *tie], positives, Lanes()).select(*group, "ap")
