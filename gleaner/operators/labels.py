"""Gold boxes from nested annotations: labels mapped, boxes from shares of the image to its pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clipped, finite
from . import contracts
from .matching import BOX

# The source's labels and the classes that they are; others are left out.
CLASSES = {
    "pedestrian": 1, "person": 1, "rider": 1, "bicycle": 2, "bike": 2, "car": 3, "motorcycle": 4, "motor": 4, "bus": 6, "truck": 8,
    "traffic light": 10,
}


def box_error(box: tuple[Column, ...], width: Column, height: Column) -> Column:
    """Why a box (x, y, w, h, as shares of the image) can't be one, or null: it must be finite, have an extent, and lie in
    the image with some of it."""
    x, y, w, h = box
    known = finite(x) & finite(y) & finite(w) & finite(h)
    x1, y1, x2, y2 = clipped(x, y, w, h, width, height)
    return F.when(~F.coalesce(known, F.lit(False)) | (w <= 0) | (h <= 0), "invalid box").when((x2 <= x1) | (y2 <= y1), "outside of the image")


def converted(samples: DataFrame, classes: dict[str, int] = CLASSES) -> DataFrame:
    """image, cls, j, the box in pixels, occluded, truncated, error of the objects with a known label; j counts them from 1
    in the order of the annotation. samples: filepath, metadata, detections, as `sources.tables.annotations` reads them.
    Missing flags are false; an image without detections has no rows."""
    mapping = F.create_map(*[F.lit(v) for pair in classes.items() for v in pair])
    name = F.regexp_extract("filepath", r"([^/]+?)(?:\.[^./]*)?$", 1)
    known = F.filter("detections.detections", lambda d: F.try_element_at(mapping, d["label"]).isNotNull())
    each = samples.select(name.alias("image"), F.col("metadata.width").cast("double").alias("width"), F.col("metadata.height").cast("double").alias("height"), F.posexplode(known).alias("at", "d"))
    box = tuple(F.try_element_at("d.bounding_box", F.lit(i)) for i in range(1, 5))
    pixels = clipped(*box, F.col("width"), F.col("height"))
    return each.select(
        "image", F.try_element_at(mapping, F.col("d.label")).alias("cls"), (F.col("at") + 1).alias("j"), *[c.alias(n) for c, n in zip(pixels, BOX, strict=True)],
        *[F.coalesce(F.col(f"d.{c}"), F.lit(False)).alias(c) for c in ("occluded", "truncated")], box_error(box, F.col("width"), F.col("height")).alias("error"),
    )


def gold(samples: DataFrame, classes: dict[str, int] = CLASSES) -> DataFrame:
    """`converted`, and an error that names the first images with a box that can't be one."""
    rows = converted(samples, classes)
    contracts.enforce(contracts.violations(rows.where("error is not null"), "annotation", F.col("image"), F.col("error")))
    return rows.drop("error")
