"""Interpolated precision over rows in an order, for many cells, limits and replicates in one pass.

The rows of each group are partitioned by ranges of the whole order, ties of the score included, and packed into blocks of
at most a batch, a written table. A block knows its sums; the sums of the blocks before it, a few numbers a block, are its
start. So no task holds a group, nor all rows of one score. A second pass over the blocks finds, for each lane, the
greatest precision at each level of recall.

A lane is a cell (a bit of `hit` and of `skip`), a limit (rows up to that `rank`) and a replicate (a column of weights): a
row that isn't skipped counts `weight` times, and as a hit or a miss. Lanes are numbered with replicates running fastest,
then limits, then cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Levels of recall.
LEVELS = [float(r) for r in np.linspace(0.0, 1.0, 101)]


@dataclass(frozen=True)
class Lanes:
    """cells: bits that count. limits: greatest ranks, none for all rows. replicates: 0 if rows have no weights."""

    cells: int = 1
    limits: tuple[int, ...] = ()
    replicates: int = 0

    @property
    def count(self) -> int:
        return self.cells * max(1, len(self.limits)) * max(1, self.replicates)

    def number(self, cell: Column, limit: Column, replicate: Column) -> Column:
        """The lane of a cell, the place of a limit, and a replicate, all from 0."""
        return (cell * max(1, len(self.limits)) + limit) * max(1, self.replicates) + replicate

    def parts(self, columns: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each cell and limit: the rows that are hits, the weights of all rows (row, replicate), and running totals of
        the weights that count. Totals of cells that count the same rows are made once."""
        n = len(columns["hit"])
        by = columns["weights"].reshape(n, self.replicates) if self.replicates else np.ones((n, 1), np.int64)
        limits = [columns["rank"] <= m for m in self.limits] or [np.ones(n, bool)]
        known: dict[bytes, np.ndarray] = {}
        for cell in range(self.cells):
            hit = (columns["hit"] >> cell & 1).astype(bool)
            counted = (columns["skip"] >> cell & 1) == 0
            for within in limits:
                some = counted & within
                name = some.tobytes()
                if name not in known:
                    known[name] = np.cumsum(np.where(some[:, None], by, 0), axis=0)
                yield np.flatnonzero(hit & some), by, known[name]

    def read(self, batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
        names = ["hit", "skip", "rank"] + ["weights"] * bool(self.replicates)
        return {n: np.frombuffer(batch.column(n)[row].as_py(), "<i8" if n != "weights" else np.uint8).astype(np.int64) for n in names}


def _stretches(columns: list[pa.Array]) -> np.ndarray:
    """Where rows begin whose key differs from that of the row before, and the end."""
    n = len(columns[0]) if columns else 0
    change = np.zeros(max(0, n - 1), bool)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def blocks_of(rows: DataFrame, groups: list[str], order: list[Column], lanes: Lanes) -> DataFrame:
    """groups, block, hit, skip, rank, weights (packed), tp, n (sums by lane). Blocks of a group are numbered in the order.
    rows: groups, hit, skip, rank, and with replicates weights, an array of bytes. A written table."""
    kept = [*groups, "hit", "skip", "rank", *["weights"] * bool(lanes.replicates)]
    kinds = [f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups]
    schema = ", ".join([*kinds, "block long, hit binary, skip binary, rank binary, weights binary, tp array<long>, n array<long>"])

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hit", "skip", "rank")}
            if lanes.replicates:
                own["weights"] = batch.column("weights").flatten().to_numpy().astype(np.uint8).reshape(batch.num_rows, lanes.replicates)
            at = _stretches([batch.column(g) for g in groups]) if groups else np.array([0, batch.num_rows])
            made = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = {c: v[a:b] for c, v in own.items()}
                found = [(by[hits].sum(axis=0), total[-1]) for hits, by, total in lanes.parts({c: v.astype(np.int64) for c, v in part.items()})]
                sums = [np.concatenate(c).tolist() for c in zip(*found, strict=True)]
                raw = [part[c].astype("<i8").tobytes() for c in ("hit", "skip", "rank")]
                made.append((number, *raw, part["weights"].tobytes() if lanes.replicates else None, *sums))
                number += 1
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            first = pa.array(at[:-1])
            columns = [batch.column(g).take(first) for g in groups] + [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*groups, "block", "hit", "skip", "rank", "weights", "tp", "n"])

    by = [*[F.asc(g) for g in groups], *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(dealt.select(kept).mapInArrow(pack, schema))


def _starts(blocks: DataFrame, groups: list[str]) -> DataFrame:
    """groups, block, b_tp, b_n: the sums by lane of the blocks before each."""
    each = blocks.select(*groups, "block", F.posexplode(F.arrays_zip("tp", "n")).alias("lane", "t"))
    before = W.partitionBy(*groups, "lane").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(f"t.{c}").over(before), F.lit(0))
    run = each.select(*groups, "block", "lane", so_far("tp").alias("tp"), so_far("n").alias("n"))
    lists = run.groupBy(*groups, "block").agg(F.array_sort(F.collect_list(F.struct("lane", "tp", "n"))).alias("s"))
    return lists.select(*groups, "block", F.col("s.tp").alias("b_tp"), F.col("s.n").alias("b_n"))


def interpolated(rows: DataFrame, groups: list[str], order: list[Column], positives: DataFrame, lanes: Lanes) -> DataFrame:
    """groups, lane, positives, ap, recall: the mean over 101 levels of recall of the greatest precision at that level or
    beyond, and the last recall. positives: groups, lane, positives; cells without any are left out, and those without
    rows have 0. Where positives has some of the groups only, its numbers hold for all others, and groups without rows are
    left out."""
    keys, shared = [*groups, "lane"], [g for g in groups if g in positives.columns]
    blocks = blocks_of(rows, groups, order, lanes)
    wanted = positives.groupBy(*shared).agg(F.map_from_entries(F.collect_list(F.struct("lane", "positives"))).alias("p"))
    wanted = wanted.select(*shared, F.transform(F.sequence(F.lit(0), F.lit(lanes.count - 1)), lambda i: F.coalesce(F.try_element_at("p", i), F.lit(0)).cast("long")).alias("positives"))
    starts = _starts(blocks, groups).select("block", "b_tp", "b_n")
    whole = blocks.select(*groups, "block", "hit", "skip", "rank", "weights").join(starts, "block")  # a block has its own number
    whole = _with(whole, wanted, shared, shared, "inner").drop("block")
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)

    def best(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                tp0, n0, wanted_ = (np.array(batch.column(c)[row].as_py()).reshape(-1, max(1, lanes.replicates)) for c in ("b_tp", "b_n", "positives"))
                found, width = [], max(1, lanes.replicates)
                for part, (hits, by, total) in enumerate(lanes.parts(lanes.read(batch, row))):
                    some = np.flatnonzero(wanted_[part])
                    if not len(hits) or not len(some):
                        continue
                    # Precision is greatest at hits: from one to the next, recall stays and precision falls.
                    tp = tp0[part, some] + np.cumsum(by[hits][:, some], axis=0)
                    reached = (np.searchsorted(LEVELS, tp / wanted_[part, some], "right") - 1).T.ravel()
                    precision = (tp / np.maximum(n0[part, some] + total[hits][:, some], 1)).T.ravel()
                    lane = np.repeat(part * width + some, len(hits))
                    first = np.concatenate([[0], np.flatnonzero((np.diff(reached) != 0) | (np.diff(lane) != 0)) + 1])
                    found.append((lane[first], reached[first], np.maximum.reduceat(precision, first)))
                if found:
                    lane, level, value = (np.concatenate(c) for c in zip(*found, strict=True))
                    own = [batch.column(g).take(pa.array(np.full(len(lane), row))) for g in groups]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(lane), pa.array(level), pa.array(value)], [*keys, "level", "best"])

    peaks = whole.mapInArrow(best, f"{kinds}{', ' if groups else ''}lane long, level long, best double").groupBy(*keys, "level").agg(F.max("best").alias("best"))
    down = W.partitionBy(*keys).orderBy(F.desc("level"))
    steps = peaks.select(*keys, F.max("best").over(down).alias("best"), (F.col("level") - F.coalesce(F.lead("level").over(down), F.lit(-1))).alias("levels"))
    ap = steps.groupBy(*keys).agg((F.sum(F.col("best") * F.col("levels")) / len(LEVELS)).alias("ap"))
    hits = blocks.select(*groups, F.posexplode("tp").alias("lane", "tp")).groupBy(*keys).agg(F.sum("tp").alias("tp"))
    some = positives.where("positives > 0").select(*shared, "lane", "positives")
    done = _with(hits, ap, keys, keys, "left")
    both = _with(some, done, keys, keys, "left") if shared == groups else _with(done, some, keys, [*shared, "lane"], "inner")
    return both.select(*keys, "positives", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce(F.col("tp") / F.col("positives"), F.lit(0.0)).alias("recall"))


def _with(a: DataFrame, b: DataFrame, keys: list[str], on: list[str], how: str) -> DataFrame:
    """a and the columns of b that aren't keys; null keys meet null ones."""
    other = b.select(*[F.col(c).alias(f"__{c}") for c in b.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], F.lit(True))
    return a.join(other, same, how).select(*a.columns, *[F.col(f"__{c}").alias(c) for c in b.columns if c not in keys])
