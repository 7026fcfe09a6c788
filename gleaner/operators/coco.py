"""Average precision and recall over ten overlap thresholds, four ranges of area and three limits of detections.

Per image, class, area and threshold the detections, best score first and at most 100, take the free gold box with the
greatest overlap, the later one on ties; boxes outside of the area are ignored and taken last. What matches an ignored
box is ignored, and so is an unmatched detection outside of the area. An image and class is gone through once for all 40
cells of threshold and area: what is taken, ignored or hit is a bit for each cell. Curves are those of `curves`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import iou
from ..sources.scratch import written
from .curves import LEVELS, Lanes, interpolated  # noqa: F401
from .matching import BOX
from .statistics import multiplicity

# Fixed values of the metric.
THRESHOLDS = [float(t) for t in np.linspace(0.5, 0.95, 10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
LIMITS = (1, 10, 100)
#: Cells are numbered by area, then threshold.
CELLS = len(AREAS) * len(THRESHOLDS)
_ALL_THRESHOLDS = (1 << len(THRESHOLDS)) - 1


def _outside() -> Column:
    """The cells whose area a box is outside of, as bits."""
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    size, out = (x2 - x1) * (y2 - y1), F.lit(0).cast("long")
    for i, (lo, hi) in enumerate(AREAS.values()):
        out = out + F.when((size < lo) | (size > hi), F.lit(_ALL_THRESHOLDS << i * len(THRESHOLDS)).cast("long")).otherwise(0)
    return out


#: By the number of thresholds that an overlap reaches, their cells as bits.
_REACHED = np.array([sum(((1 << n) - 1) << a * len(THRESHOLDS) for a in range(len(AREAS))) for n in range(len(THRESHOLDS) + 1)])


def _reached(overlap: np.ndarray) -> np.ndarray:
    """The cells whose threshold an overlap reaches, as bits."""
    return _REACHED[np.searchsorted([min(t, 1 - 1e-10) for t in THRESHOLDS], overlap, "right")]


def _take(starts: np.ndarray, ranks: np.ndarray, golds: np.ndarray, reached: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of many images and classes, those of one from starts[i] up to starts[i + 1], by rank and then preference: for
    each image and class and rank its number, the rank, the cells that are hit, and those where the hit is an ignored box.
    All images and classes take a pair at once, the first one of each, then the second."""
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if not len(group):
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(ranks) != 0)])
    taker = np.cumsum(new) - 1
    names, box = np.unique(golds, return_inverse=True)
    box = np.unique(group * len(names) + box, return_inverse=True)[1]
    pair = np.arange(len(group))
    inner, outer = pair[reached & ~outs != 0], pair[reached & outs != 0]
    at, last = np.concatenate([inner, outer]), np.repeat([False, True], [len(inner), len(outer)])
    order = np.lexsort((at, last, taker[at]))  # boxes outside of an area come last
    at, last = at[order], last[order]
    cells = np.where(last, reached[at] & outs[at], reached[at] & ~outs[at])
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[at]) != 0])) if len(at) else at
    stop = np.concatenate([first[1:], [len(at)]]) if len(at) else at
    used = np.zeros(box.max() + 1, np.int64)
    hit, ignored = np.zeros(taker[-1] + 1, np.int64), np.zeros(taker[-1] + 1, np.int64)
    while len(first):
        now = at[first]
        got = cells[first] & ~used[box[now]] & ~hit[taker[now]]
        used[box[now]] |= got
        hit[taker[now]] |= got
        ignored[taker[now]] |= np.where(last[first], got, 0)
        first, stop = first[first + 1 < stop] + 1, stop[first + 1 < stop]
    return group[new], ranks[new], hit, ignored


def judged(gold: DataFrame, predictions: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """runs, image, cls, rank, score, hit, skip: the best 100 detections of each image and class, with the cells as bits
    where each hits or is ignored. predictions may be of several runs over the same gold boxes."""
    runs = runs or []
    key = [*runs, "image", "cls"]
    best = W.partitionBy(*key).orderBy(F.desc("score"), "j")
    top = predictions.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= max(LIMITS))
    boxes = gold.select("image", "cls", F.col("j").cast("long").alias("g"), _outside().alias("out"), *[F.col(c).alias(f"g{c}") for c in BOX])
    overlap = iou(tuple(F.col(f"g{c}") for c in BOX), tuple(F.col(c) for c in BOX))
    near = top.join(boxes, ["image", "cls"]).where(overlap >= min(THRESHOLDS))
    pairs = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", (-overlap).alias("i"), (-F.col("g")).alias("n"), "out"))).alias("pairs"))
    pairs = pairs.select(*key, *[F.col(f"pairs.{c}").alias(f"p_{c}") for c in ("rank", "n", "i", "out")])
    kinds = ", ".join(f"`{c}` {(predictions if c in runs else gold).schema[c].dataType.simpleString()}" for c in key)

    def take(batches):
        for batch in batches:
            starts = np.concatenate([[0], np.cumsum(batch.column("p_rank").value_lengths().to_numpy())])
            ranks, golds, overlaps, outs = (batch.column(c).flatten().to_numpy() for c in ("p_rank", "p_n", "p_i", "p_out"))
            at, *found = _take(starts, ranks, golds, _reached(-overlaps), outs)
            columns = [batch.column(c).take(pa.array(at)) for c in key] + [pa.array(v) for v in found]
            yield pa.RecordBatch.from_arrays(columns, [*key, "rank", "hit", "ignored"])

    taken = pairs.mapInArrow(take, f"{kinds}, rank long, hit long, ignored long")
    both = top.select(*key, "rank", "score", _outside().alias("far")).join(taken, [*key, "rank"], "left")
    zero = F.lit(0).cast("long")
    hit, ignored = F.coalesce("hit", zero), F.coalesce("ignored", zero)
    return both.select(*key, "rank", "score", hit.alias("hit"), ignored.bitwiseOR(F.col("far").bitwiseAND(F.bitwise_not(hit))).alias("skip"))


def curves(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """cls, area, thr, lim, positives, ap, recall of each defined cell."""
    lanes = Lanes(CELLS, LIMITS)
    rows = written(judged(gold, predictions))
    inside = gold.select("cls", _outside().alias("out")).groupBy("cls").agg(
        *[F.count(F.when(F.col("out").bitwiseAND(F.lit(1 << i * len(THRESHOLDS))) == 0, 1)).alias(f"a{i}") for i in range(len(AREAS))]
    )
    per_area = inside.select("cls", F.posexplode(F.array(*[f"a{i}" for i in range(len(AREAS))])).alias("a", "positives")).where("positives > 0")
    each = len(THRESHOLDS) * len(LIMITS)
    positives = per_area.select("cls", F.explode(F.sequence(F.col("a") * each, F.col("a") * each + each - 1)).alias("lane"), "positives")
    found = interpolated(rows, ["cls"], [F.desc("score"), F.asc("image"), F.asc("rank")], positives, lanes)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    cell, limit = F.floor(F.col("lane") / len(LIMITS)), F.col("lane") % len(LIMITS)
    return found.select(
        "cls", pick(AREAS, F.floor(cell / len(THRESHOLDS))).alias("area"), pick(THRESHOLDS, cell % len(THRESHOLDS)).alias("thr"),
        pick(LIMITS, limit).alias("lim"), "positives", "ap", "recall",
    )


def summary(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """The twelve metrics as one row; null where no cell is defined."""
    c = curves(gold, predictions)
    top, all_ = F.col("lim") == 100, F.col("area") == "all"

    def mean(value: str, where: Column) -> Column:
        return F.avg(F.when(where, F.col(value)))

    out = {
        "AP": mean("ap", top & all_),
        "AP50": mean("ap", top & all_ & (F.col("thr") == THRESHOLDS[0])),
        "AP75": mean("ap", top & all_ & (F.col("thr") == THRESHOLDS[5])),
    }
    out |= {f"AP_{a}": mean("ap", top & (F.col("area") == a)) for a in ("small", "medium", "large")}
    out |= {f"AR{n}": mean("recall", (F.col("lim") == n) & all_) for n in LIMITS}
    out |= {f"AR_{a}": mean("recall", top & (F.col("area") == a)) for a in ("small", "medium", "large")}
    return c.agg(*[v.alias(k) for k, v in out.items()])


def bootstrap(
    gold: DataFrame, predictions: DataFrame, images: DataFrame, arm: str, seed: str, replicates: int, salt: str
) -> DataFrame:
    """arm, seed, replicate, ap: the average precision of each run when groups of images are drawn anew. images: image,
    group. A replicate draws the same groups for all runs; all replicates are one pass, with a weight for each row. A class
    counts in a replicate if a gold box of it is drawn; a replicate without any has no rows. An image drawn twice is two
    images; its detections of one score and class are in the order of their rank first."""
    gold, predictions = written(gold), written(predictions)  # each is read several times
    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: multiplicity(F.col("group"), r, salt).cast("tinyint"))
    by_group = written(images.select("group").distinct().select("group", drawn.alias("weights")))
    by_image = images.select("image", "group").join(by_group, "group").select("image", "weights")
    first = F.lit(_ALL_THRESHOLDS).cast("long")  # the cells of the area of all boxes
    rows = judged(gold, predictions, [arm, seed]).join(by_image, "image")
    rows = written(rows.withColumns({c: F.col(c).bitwiseAND(first) for c in ("hit", "skip")}))
    lanes = Lanes(len(THRESHOLDS), (), replicates)
    by_class = gold.where(_outside().bitwiseAND(first) == 0).select("image", "cls").join(images.select("image", "group"), "image").groupBy("group", "cls").agg(F.count("*").alias("boxes"))
    inside = by_class.join(by_group, "group").select("cls", "boxes", F.posexplode("weights").alias("replicate", "w"))
    inside = written(inside.groupBy("cls", "replicate").agg(F.sum(F.col("w") * F.col("boxes")).cast("long").alias("positives")).where("positives > 0"))
    every = F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1))
    positives = inside.select("cls", "positives", F.explode(F.transform(every, lambda t: lanes.number(t, F.lit(0), F.col("replicate")))).alias("lane"))
    found = interpolated(rows, [arm, seed, "cls"], [F.desc("score"), F.asc("image"), F.asc("rank")], positives, lanes)
    sums = found.groupBy(arm, seed, (F.col("lane") % replicates).alias("replicate")).agg(F.sum("ap").alias("ap"))
    cells = inside.groupBy("replicate").agg((F.count("*") * len(THRESHOLDS)).alias("cells"))
    runs = predictions.select(arm, seed).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    whole = runs.join(cells, "replicate").join(sums, [arm, seed, "replicate"], "left")
    return whole.select(arm, seed, (F.col("replicate") + 1).alias("replicate"), (F.coalesce("ap", F.lit(0.0)) / F.col("cells")).alias("ap"))


def paired_bootstrap(
    gold: DataFrame, predictions: DataFrame, images: DataFrame, arm: str, seed: str, arms: tuple[str, str], replicates: int, salt: str
) -> DataFrame:
    """One row: mean, lo and hi (2.5 and 97.5 per cent) over replicates of the mean over seeds of the first arm's average
    precision less the second's."""
    each = bootstrap(gold, predictions.where(F.col(arm).isin(*arms)), images, arm, seed, replicates, salt)
    of = lambda a: F.max(F.when(F.col(arm) == a, F.col("ap")))
    deltas = each.groupBy("replicate", seed).agg((of(arms[0]) - of(arms[1])).alias("d")).groupBy("replicate").agg(F.avg("d").alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return deltas.agg(F.avg("d").alias("mean"), q.alias("q"), F.count("*").alias("replicates")).select("mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "replicates")
