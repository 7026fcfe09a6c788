"""Scores of samples, and the choice of a budget of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import digest, dot, entropy, finite, unit
from ..sources.scratch import written
from .contracts import ContractError, budget as check_budget, enforce, unique, violations
from .running import cuts_of, running

TOP_SCORES = 20
#: Rows that a diverse selection brings to the driver at once.
POOL = 2048
LOW, HIGH = 0.05, 0.5


def uncertainty(scores: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """key, uncertainty: the mean entropy of a sample's 20 best scores; 1 for a sample without any."""
    w = W.partitionBy(key).orderBy(F.desc("score"))
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP_SCORES)
    means = best.groupBy(key).agg(F.avg(entropy(F.col("score"))).alias("uncertainty"))
    return samples.select(key).join(means, key, "left").na.fill(1.0, ["uncertainty"])


def low_confidence_mass(scores: DataFrame, key: str) -> DataFrame:
    """key, mass, low_count: sum of s (1 - s) and number of the scores from 0.05 up to below 0.5."""
    s = F.col("score")
    low = (s >= LOW) & (s < HIGH)
    return scores.groupBy(key).agg(
        F.coalesce(F.sum(F.when(low, s * (1 - s))), F.lit(0.0)).alias("mass"), F.count(F.when(low, 1)).alias("low_count")
    )


def centroid(vectors: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """The mean vector by group, over its length. Partial sums by dimension; no vectors are gathered."""
    group = group or []
    parts = vectors.select(*group, F.posexplode(column).alias("i", "x"))
    means = parts.groupBy(*group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"])
    return means.groupBy(*group).agg(ordered.alias("v")).select(*group, unit(F.col("v")).alias("prototype"))


def similarity(vectors: DataFrame, prototype: DataFrame, column: str) -> DataFrame:
    """vectors and their cosine with the one prototype, at least 0."""
    return vectors.join(F.broadcast(prototype)).withColumn(
        "similarity", F.greatest(F.lit(0.0), dot(unit(F.col(column)), F.col("prototype")))
    ).drop("prototype")


def leave_group_out(vectors: DataFrame, column: str, group: str, failed: str) -> DataFrame:
    """For each group the prototype of the failures of all others: totals less the group's own, not a join of groups
    with each other. Groups without any other failure are missing."""
    parts = vectors.where(failed).select(group, F.posexplode(column).alias("i", "x"))
    own = parts.groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    total = own.groupBy("i").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    grid = vectors.select(group).distinct().join(F.broadcast(total))
    rest = grid.join(own.hint("merge"), [group, "i"], "left").select(
        group, "i", ((F.col("ts") - F.coalesce("s", F.lit(0.0))) / F.nullif(F.col("tn") - F.coalesce("n", F.lit(0)), F.lit(0))).alias("x")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"])
    return rest.where("x is not null").groupBy(group).agg(ordered.alias("v")).select(group, unit(F.col("v")).alias("prototype"))


def rows_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of chosen ids, once each. An error if an id has no row, or several."""
    chosen = ids.select(key).distinct()
    found = rows.join(chosen, key, "left_semi")
    enforce(violations(chosen.join(rows, key, "left_anti"), "unknown", F.col(key), F.lit("no row")), unique(found, key))
    return found


def hash_order(key: Column, seed: str) -> Column:
    """A reproducible shuffle that does not depend on partitions."""
    return digest(F.lit(seed), key)


def hash_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return rows.orderBy(hash_order(F.col(key), seed)).limit(n)


def one_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first row of each group, and of these the first n."""
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("__r = 1").drop("__r")
    return first.orderBy(*order).limit(n)


def select(rows: DataFrame, strategy: str, n: int, seed: str, key: str = "sample_id") -> DataFrame:
    """random, or uncertainty with ties in shuffled order; with their rank."""
    check_budget(n, rows.count())
    shuffled = hash_order(F.col(key), seed)
    order = {"random": [shuffled], "uncertainty": [F.desc("uncertainty"), shuffled]}[strategy]
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def diverse(rows: DataFrame, n: int, key: str, group: str, factor: str, vector: str, pool: int = POOL) -> DataFrame:
    """n rows, one to a group: each next one has the greatest mean of its factor and half the distance to the nearest
    chosen one; the first goes by its factor, ties by key. rank, key, score.

    A row's distance can only fall, so an old score is an upper bound. A table keeps the rows with their distances to what
    was chosen before it was written; the `pool` best by score come to the driver, and are chosen from as long as the best
    of them is above the bound of all others. Then one pass brings the table up to date with the rows chosen since. Each
    chosen row is compared with the table once, and passes are fewer than choices. Null, empty, zero and non-finite vectors
    are an error."""
    check_budget(n, rows.count())
    bad = rows.where(~F.coalesce(_direction(F.col(vector)), F.lit(False))).select(key).take(5)
    if bad:
        raise ContractError(f"Invalid vectors: {[r[0] for r in bad]}")
    if rows.select(group).distinct().count() < n:
        raise ContractError("Not enough groups")
    table = rows.select(key, group, F.col(factor).cast("double").alias("__f"), unit(F.col(vector)).alias("__v"), F.lit(None).cast("double").alias("__d"))
    chosen: list[tuple] = []
    fresh: list = []  # chosen since the table was written
    groups: set = set()
    while True:
        if fresh:
            near = [1 - dot(F.col("__v"), F.array(*[F.lit(float(x)) for x in v])) for v in fresh]
            table = table.withColumn("__d", F.least("__d", *[d / 2 for d in near]))
            gone = rows.sparkSession.createDataFrame([(g,) for g in groups], T.StructType([T.StructField(group, rows.schema[group].dataType)]))
            table = table.join(F.broadcast(gone), table[group].eqNullSafe(gone[group]), "left_anti")
        table = written(table)
        score = F.round(F.when(F.col("__d").isNull(), F.col("__f")).otherwise(0.5 * F.col("__f") + 0.5 * F.col("__d")), 12)
        best = table.withColumn("__s", score).orderBy(F.desc("__s"), key).limit(pool + 1).collect()
        bound = best[pool]["__s"] if len(best) > pool else float("-inf")
        vectors = np.array([r["__v"] for r in best[:pool]])
        factors = np.array([r["__f"] for r in best[:pool]])
        apart = np.array([np.nan if r["__d"] is None else r["__d"] for r in best[:pool]])
        scores = np.array([r["__s"] for r in best[:pool]])
        free = np.array([r[group] not in groups for r in best[:pool]])
        fresh = []
        while len(chosen) < n and free.any():
            top = scores[free].max()
            if fresh and top <= bound + 1e-9:
                break
            at = int(np.flatnonzero(free & (scores == top))[0])  # ties are in the order of keys
            row = best[at]
            chosen.append((len(chosen) + 1, row[key], float(top)))
            fresh.append(vectors[at])
            groups.add(row[group])
            free &= np.array([r[group] != row[group] for r in best[:pool]])
            apart = np.fmin(apart, (1 - np.cumsum(vectors * vectors[at], axis=1)[:, -1]) / 2)  # summed in the order of Spark's fold
            scores = np.round(0.5 * factors + 0.5 * apart, 12)
        if len(chosen) == n:
            break
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(chosen, f"rank int, {key} {kind}, score double")


def _direction(vector: Column) -> Column:
    """Whether a vector has a direction: finite numbers, not all zero."""
    numbers = F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))
    return (F.size(vector) > 0) & numbers & (F.sqrt(dot(vector, vector)) >= 1e-12)


def slots(base: DataFrame, extra: DataFrame, key: str, epochs: int, per_epoch: int, seed: str) -> DataFrame:
    """A training schedule: each epoch has all base rows, filled up by repeats of extra rows, in shuffled order."""
    missing = per_epoch - base.count()
    available = extra.count()
    repeats = F.explode(F.sequence(F.lit(0), F.lit(-(-missing // max(1, available)) - 1))).alias("again")
    fill = extra.select(key, repeats).orderBy(hash_order(F.concat_ws(":", key, "again"), seed)).limit(missing).select(key)
    epoch = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    all_ = base.select(key).union(fill)
    ordered = all_.withColumn("copy", F.row_number().over(W.partitionBy(key).orderBy(key))).select("*", epoch)
    shuffled = ordered.withColumn("__h", hash_order(F.concat_ws(":", "epoch", key, "copy"), seed))
    numbered = shuffled.withColumn("__x", F.conv(F.substring("__h", 1, 13), 16, 10).cast("double"))
    dealt = running(numbered, ["epoch"], "__x", [F.asc("__x"), F.asc("__h")], {"slot": F.lit(1)}, cuts_of(numbered, "__x"))
    return dealt.select("epoch", key, F.col("slot").cast("int").alias("slot"))


def targeted(ranked: DataFrame, used: DataFrame, key: str, group: str, seed: str, n: int, top: int = 36) -> DataFrame:
    """n rows, one to a group, in shuffled order, from the `top` best ranked (score) of groups that are not used yet; all
    columns. An error if there are fewer groups."""
    free = ranked.join(used.select(group).distinct(), group, "left_anti")
    best = free.orderBy(F.desc("score"), key).limit(top)
    chosen = one_per_group(best, group, [hash_order(F.col(key), seed)], n)
    if chosen.count() < n:
        raise ContractError("Not enough groups")
    return chosen
