"""One evaluation of predictions over the splits of a manifest, that raises rather than leave an image out.

manifest: image, split, sha256, labels_sha256 and tag columns. gold: image, cls, j, the box, and what object slices need.
predicted: image, sha256, version, one row for each image that was predicted, also if nothing was found. predictions:
image, cls, j, the box, score. All checks are made before anything is computed; every image of a split counts in its
slices, with zeros if it has no box."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.scratch import written
from ..sources.tables import write_all_once
from . import coco, contracts, matching
from .digests import digest
from .matching import BOX


@dataclass
class Evaluation:
    """samples: image, split, tags, objects, tp, fp, fn, recall. slices: split, tag, images, objects, tp, fp, fn, recall,
    precision. metrics: split and the twelve metrics."""

    samples: DataFrame
    slices: DataFrame
    metrics: DataFrame | None

    def publish(self, folder: str) -> dict[str, bool]:
        """Write both tables once; all are compared with what is there before one is written."""
        tables = {"samples": self.samples, "slices": self.slices} | ({"metrics": self.metrics} if self.metrics is not None else {})
        return write_all_once({f"{folder}/{name}": df for name, df in tables.items()})


def labels_digests(gold: DataFrame) -> DataFrame:
    """image, labels_sha256: the digest of an image's boxes, in the order of j, by their canonical JSON."""
    boxes = F.array_sort(F.collect_list(F.struct("j", F.struct(*[F.col(c) for c in gold.columns if c not in ("image", "j")]).alias("box"))))
    return gold.groupBy("image").agg(boxes.alias("b")).select("image", digest(F.transform("b", lambda b: b["box"])).alias("labels_sha256"))


def no_labels_digest(gold: DataFrame) -> Column:
    """The digest of an image without a box."""
    return digest(F.array().cast("array<string>"))


def check(manifest: DataFrame, gold: DataFrame, predicted: DataFrame, predictions: DataFrame, splits: list[str], version: str, labels: int = 7) -> None:
    """All contracts of an evaluation; the first broken ones are named."""
    rows = manifest.where(F.col("split").isin(splits))
    contracts.enforce(
        contracts.version(predicted, "image", "version", version), contracts.unique(predicted, "image"), contracts.unique(manifest, "image"),
        contracts.nonempty(manifest, "split", splits),
    )
    there = predicted.join(rows.select("image"), "image", "left_semi")
    now = rows.select("image", F.col("labels_sha256").alias("was")).join(labels_digests(gold), "image", "left")
    changed = now.where(~F.col("was").eqNullSafe(F.coalesce("labels_sha256", no_labels_digest(gold))))
    bad = [
        contracts.complete(rows, there, "image", "sha256"),
        changed.select(F.lit("labels changed").alias("rule"), F.col("image").cast("string").alias("key"), F.col("labels_sha256").alias("detail")),
    ]
    for name, boxes, score in (("gold box", gold, None), ("prediction", predictions, F.col("score"))):
        error = contracts.box_errors(*[F.col(c) for c in BOX], F.col("cls"), score, labels)
        broken = boxes.join(rows.select("image"), "image", "left_semi").withColumn("error", error).where("error is not null")
        bad.append(broken.select(F.lit(name).alias("rule"), F.col("image").cast("string").alias("key"), F.col("error").alias("detail")))
    contracts.enforce(*bad)


def evaluate(
    manifest: DataFrame, gold: DataFrame, predicted: DataFrame, predictions: DataFrame, splits: list[str], version: str, tags: list[str],
    objects: dict[str, Column], with_metrics: bool = True, labels: int = 7,
) -> Evaluation:
    """The evaluation of some splits. tags: columns of the manifest whose values are slices. objects: slices of gold boxes
    by a condition; they have no false positives and so no precision."""
    # Digests, splits and boxes are read many times and made once; boxes of other splits take no part.
    manifest, predicted = written(manifest), written(predicted)
    rows = manifest.where(F.col("split").isin(splits)).select("image", "split", *tags)
    own = lambda df: written(df.join(rows.select("image", "split").distinct(), "image"))
    boxes, predictions = own(gold), own(predictions)
    check(manifest, boxes.select(gold.columns), predicted, predictions, splits, version, labels)
    gold = boxes
    matched = written(matching.match(gold.drop("split"), predictions.drop("split")))
    counted = matching.counts(gold, predictions, matched)
    samples = rows.join(counted, "image", "left").na.fill(0, ["objects", "tp", "fp", "fn"])
    samples = written(samples.withColumn("recall", ratio(F.col("tp"), F.col("objects"))))
    spread = samples.select("split", F.explode(F.array(F.lit("all"), *[F.concat_ws(":", F.lit(t), F.coalesce(F.col(t).cast("string"), F.lit("unknown"))) for t in tags])).alias("tag"), "objects", "tp", "fp", "fn")
    sums = spread.groupBy("split", "tag").agg(F.count("*").alias("images"), *[F.sum(c).alias(c) for c in ("objects", "tp", "fp", "fn")])
    wanted = {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    got = {r.split: r.images for r in sums.where("tag = 'all'").collect()}
    if got != wanted:
        raise contracts.ContractError(f"Images of splits: {got} instead of {wanted}")
    slices = sums.withColumns({"recall": ratio(F.col("tp"), F.col("objects")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})
    if objects:
        hit = gold.join(matched.select("image", "cls", "j", F.lit(1).alias("hit")), ["image", "cls", "j"], "left")
        kinds = F.array_compact(F.array(*[F.when(c, F.lit(f"object:{n}")) for n, c in objects.items()]))
        kinds = hit.select("split", "image", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(kinds).alias("tag")).groupBy("split", "tag", "image").agg(F.count("*").alias("o"), F.sum("hit").alias("t"))
        boxes = kinds.groupBy("split", "tag").agg(F.count("*").alias("images"), F.sum("o").alias("objects"), F.sum("t").alias("tp"))
        boxes = boxes.withColumns({"fn": F.col("objects") - F.col("tp"), "recall": ratio(F.col("tp"), F.col("objects"))})
        slices = slices.unionByName(boxes, allowMissingColumns=True)
    metrics = None
    if with_metrics:
        for split in splits:
            one = coco.summary(gold.where(F.col("split") == split), predictions.where(F.col("split") == split)).withColumn("split", F.lit(split))
            metrics = one if metrics is None else metrics.union(one)
    return Evaluation(samples, slices, metrics)
