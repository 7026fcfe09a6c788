"""Column functions: identity, boxes, scores, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the splits in per cent, in the order of their buckets; names of the two times of day.
SPLITS = (("seed", 15), ("pool", 40), ("dev", 20), ("test", 25))
TIMES = ("daytime", "night")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by a colon."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def bucket_of(name: Column, salt: str = "split-v1", buckets: int = 100) -> Column:
    """The bucket that a name's hash falls in."""
    return F.conv(F.substring(digest(F.lit(salt), name), 1, 8), 16, 10).cast("long") % buckets


def split_of(name: Column) -> Column:
    """The split of a group: all its rows share it."""
    out, upper, bucket = None, 0, bucket_of(name)
    for split, share in SPLITS:
        upper += share
        out = F.when(bucket < upper, split) if out is None else out.when(bucket < upper, split)
    return out


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap over union of two boxes (x1, y1, x2, y2); 0 for an empty union."""
    common = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def clipped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Pixel corners of a relative box, clipped to the image."""
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return [inside(x * width, width), inside(y * height, height), inside((x + w) * width, width), inside((y + h) * height, height)]


def entropy(p: Column) -> Column:
    """Binary entropy in bits; logarithms of at least 1e-12."""
    floor = F.lit(1e-12)
    return -(p * F.ln(F.greatest(p, floor)) + (1 - p) * F.ln(F.greatest(1 - p, floor))) / F.ln(F.lit(2.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null without support."""
    return F.when(b != 0, a / b)


def tag(text: Column) -> Column:
    """A one-word answer, cleaned; null if it isn't a time of day."""
    word = F.regexp_replace(F.lower(F.trim(text)), "^[.\"' ]+|[.\"' ]+$", "")
    return F.when(word.isin(*TIMES), word)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length, of at least 1e-12."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)
