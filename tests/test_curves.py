"""Precision curves by ranges of the whole order, and the bootstrap of average precision, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import coco, curves, matching, statistics

from test_queries import GOLD, twin

LEVELS = curves.LEVELS


def ap_of(rows, positives):
    """rows: (hit, weight) in order; a row of weight 2 is two rows."""
    tp = n = 0
    points = []
    for hit, weight in rows:
        for _ in range(weight):
            tp, n = tp + hit, n + 1
            points.append((tp / positives, tp / n))
    return sum(max((p for r, p in points if r >= level), default=0) for level in LEVELS) / 101, max((r for r, _ in points), default=0)


@pytest.mark.parametrize("batch", [3, 1000])
def test_lanes_against_loops(spark, batch):
    """Cells, limits and weights at once, one score for many rows, a null group; blocks of a few rows."""
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([0.5, 0.5, 0.9]), i, draw.randrange(4), draw.randrange(4), draw.randrange(1, 4), [draw.randrange(3) for _ in range(2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, score double, i int, hit long, skip long, rank long, weights array<tinyint>")
    lanes = curves.Lanes(2, (1, 3), 2)
    positives = [(g, lane, 40 + lane if g != "b" or lane else 0) for g in ("a", "b", "z", None) for lane in range(lanes.count)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = curves.interpolated(df, ["g"], [F.desc("score"), F.asc("i")], spark.createDataFrame(positives, "g string, lane int, positives long"), lanes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {(r.g, r.lane) for r in got} == {(g, lane) for g, lane, p in positives if p}
    for r in got:
        cell, limit, replicate = r.lane // 4, (1, 3)[r.lane // 2 % 2], r.lane % 2
        own = sorted((x for x in rows if x[0] == r.g and not x[4] >> cell & 1 and x[5] <= limit), key=lambda x: (-x[1], x[2]))
        assert (r.ap, r.recall) == pytest.approx(ap_of([(x[3] >> cell & 1, x[6][replicate]) for x in own], 40 + r.lane), abs=1e-12)


def test_average_precision_without_rows_or_groups(spark):
    empty = spark.createDataFrame([], "cls int, image int, score double, hit int, positives long")
    assert matching.average_precision(empty, ["cls"], [F.asc("image")]).collect() == []
    rows = spark.createDataFrame([(0, i, 0.5, i % 2, 5) for i in range(10)], "cls int, image int, score double, hit int, positives long")
    want = ap_of([(i % 2, 1) for i in range(10)], 5)[0]
    assert matching.average_precision(rows, ["cls"], [F.asc("image")]).first().ap == pytest.approx(want)
    assert matching.average_precision(rows, [], [F.asc("image")]).first().ap == pytest.approx(want)


def test_bootstrap_of_average_precision(spark):
    """Each replicate is the metric of the drawn images, an image drawn twice being two images."""
    draw, replicates = random.Random(2), 6
    gold, preds = [], []
    for image in range(9):
        scores = {run: draw.sample(range(1, 20), 6) for run in ("new1", "new2", "old1", "old2")}  # ties between images only
        for j in range(6):
            x, y, w = draw.randrange(40), draw.randrange(40), draw.choice([20, 40, 90])
            cls = draw.randrange(2)
            gold.append((image, cls, j, float(x), float(y), float(x + w), float(y + w)))
            for arm in ("new", "old"):
                for seed in (1, 2):
                    if draw.random() < 0.8:
                        d = draw.randrange(4)
                        preds.append((image, cls, len(preds), float(x + d), float(y), float(x + w), float(y + w + d), scores[f"{arm}{seed}"][j] / 20, arm, seed))
    preds = [p for p in preds if p[8:] != ("old", 2)] + [p for p in preds if p[8:] == ("old", 2)][:1]
    images = [(i, f"g{i // 2}") for i in range(9)]
    table = spark.createDataFrame(images, "image int, group string")
    drawn = table.select("group").distinct().withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    times = {(r.group, r.r): r.m for r in drawn.select("group", "r", statistics.multiplicity(F.col("group"), F.col("r"), "s").alias("m")).collect()}
    assert len(set(times.values())) > 2
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(preds, GOLD + ", score double, arm string, seed int")
    got = {(r.arm, r.seed, r.replicate): r.ap for r in coco.bootstrap(g, p, table, "arm", "seed", replicates, "s").collect()}
    want = {}
    for arm, seed, r in [(a, s, r) for a in ("new", "old") for s in (1, 2) for r in range(1, replicates + 1)]:
        copies = [(image, 100 * image + c) for image, group in images for c in range(times[group, r])]
        again = lambda boxes: [(new, *b[1:]) for old, new in copies for b in boxes if b[0] == old]
        cells = twin(again(gold), again([x[:8] for x in preds if x[8:] == (arm, seed)]))
        aps = [v[0] for (_, area, _, lim), v in cells.items() if area == "all" and lim == 100]
        if aps:
            want[arm, seed, r] = sum(aps) / len(aps)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k
    import numpy as np

    deltas = [np.mean([want["new", s, r] - want["old", s, r] for s in (1, 2)]) for r in range(1, replicates + 1)]
    one = coco.paired_bootstrap(g, p, table, "arm", "seed", ("new", "old"), replicates, "s").first()
    assert (one["mean"], one.lo, one.hi) == pytest.approx((np.mean(deltas), *np.quantile(deltas, [0.025, 0.975])), abs=1e-12)


def test_totals_of_equal_cells_are_made_once():
    """Cells that count the same rows share their totals, and matching takes many images at once, as one by one."""
    import numpy as np

    n = 50
    columns = {"hit": np.arange(n) % 1024, "skip": np.zeros(n, np.int64), "rank": np.ones(n, np.int64), "weights": np.ones(n * 20, np.int64)}
    assert len({id(total) for _, _, total in curves.Lanes(10, (), 20).parts(columns)}) == 1

    draw = random.Random(7)
    groups, want = [], []
    for number in range(40):
        pairs = sorted((draw.randrange(4), draw.randrange(5), draw.randrange(16), draw.randrange(16)) for _ in range(draw.randrange(9)))
        groups.append(pairs)
        used = {}
        for rank in sorted({p[0] for p in pairs}):
            hit = ignored = 0
            for last in (False, True):
                for _, gold, reached, out in (p for p in pairs if p[0] == rank):
                    cells = reached & (out if last else ~out) & ~used.get(gold, 0) & ~hit
                    used[gold] = used.get(gold, 0) | cells
                    hit |= cells
                    ignored |= cells if last else 0
            want.append((number, rank, hit, ignored))
    starts = np.cumsum([0, *map(len, groups)])
    flat = np.array([p for g in groups for p in g], np.int64).T
    assert [tuple(map(int, t)) for t in zip(*coco._take(starts, *flat), strict=True)] == want
