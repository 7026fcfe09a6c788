"""Rank statistics, paired comparisons, bootstrap and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digest, ratio
from .running import cuts_of, running


def ranks(df: DataFrame, column: str, into: str, *more: Column) -> DataFrame:
    """Each value of a numeric column, its number of rows `n`, its average rank (ties share their mean rank), and the
    aggregates `more`. Values are counted first and ranked by ranges."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"), *more)
    below = running(counts, [], column, [F.asc(column)], {"__below": F.col("n")}, cuts_of(df, column))
    return below.withColumn(into, F.col("__below") - (F.col("n") - 1) / F.lit(2.0)).drop("__below")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rank correlation, null for a constant column. Equal pairs are counted before they meet their ranks."""
    known = df.where(f"{a} is not null and {b} is not null")
    pairs = known.groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    first = ranks(known, a, "x").select(F.col(a).alias("__a"), "x")
    second = ranks(known, b, "y").select(F.col(b).alias("__b"), "y")
    both = pairs.join(first, "__a").join(second, "__b")
    n, x, y = F.col("__n"), F.col("x"), F.col("y")
    sums = both.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * y).alias("sxy"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("varied"),
    )
    over = lambda p, q, r: F.col(p) - F.col(q) * F.col(r) / F.col("n")
    value = over("sxy", "sx", "sy") / F.sqrt(over("sxx", "sx", "sx") * over("syy", "sy", "sy"))
    return sums.select(F.when(F.col("varied"), value).alias("spearman"), "n")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """The chance that a positive row scores higher than a negative one, ties half; by ranks of values."""
    yes, no = F.count(F.when(F.col(label), 1)).alias("p"), F.count(F.when(~F.col(label), 1)).alias("q")
    ranked = ranks(df, score, "r", yes, no)
    sums = ranked.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("q"), F.lit(0)).alias("negatives"), F.sum(F.col("p") * F.col("r")).alias("won")
    )
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(F.when((p > 0) & (n > 0), (F.col("won") - p * (p + 1) / F.lit(2.0)) / (p * n)).alias("auc"), "positives", "negatives")


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """How many of the k best rows by a are among those by b."""
    first = lambda c: df.orderBy(F.desc(c), key).limit(k).select(key)
    return first(a).join(first(b), key).agg(F.count("*").alias("shared"))


def paired(df: DataFrame, arm: str, control: str, seed: str, value: str) -> DataFrame:
    """By arm: mean, sample deviation, and mean of the differences to the control of the same seed."""
    base = df.where(F.col(arm) == control).select(seed, F.col(value).alias("__c"))
    both = df.join(base, seed, "left")
    return both.groupBy(arm).agg(
        F.count("*").alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg(F.col(value) - F.col("__c")).alias("delta")
    )


def classifier_summary(df: DataFrame, truth: str, answer: str) -> DataFrame:
    """By class of the truth: n, correct, recall, invalid answers; and accuracy and mean recall over all."""
    right = F.count(F.when(F.col(answer).eqNullSafe(F.col(truth)), 1))
    by_class = df.groupBy(F.col(truth).alias("label")).agg(
        F.count("*").alias("n"), right.alias("correct"), F.count(F.when(F.col(answer).isNull(), 1)).alias("invalid")
    )
    each = by_class.withColumn("recall", ratio(F.col("correct"), F.col("n")))
    over = each.agg((F.sum("correct") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))
    return each.join(F.broadcast(over))


def multiplicity(group: Column, replicate: Column, seed: str) -> Column:
    """How often a group is drawn in a replicate: a Poisson variable of mean 1, from the hash of both."""
    u = (F.conv(F.substring(digest(F.lit(seed), replicate, group), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    bounds, term, total = [], 2.718281828459045**-1, 0.0
    for k in range(1, 12):
        total += term
        bounds.append(total)
        term /= k
    return sum(((u > b).cast("int") for b in bounds), F.lit(0))


def group_bootstrap(df: DataFrame, group: str, value: str, replicates: int, seed: str) -> DataFrame:
    """replicate, mean: means over resampled groups. Sums by group are formed first; a group's rows stay together."""
    sums = df.groupBy(F.col(group).alias("g")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("m", multiplicity(F.col("g"), F.col("replicate"), seed))
    return drawn.groupBy("replicate").agg(ratio(F.sum(F.col("m") * F.col("s")), F.sum(F.col("m") * F.col("n"))).alias("mean"))


def paired_bootstrap(
    df: DataFrame, group: str, arm: str, arms: tuple[str, str], seed: str, value: str, replicates: int, salt: str
) -> DataFrame:
    """One row: mean, lo and hi (2.5 and 97.5 per cent) over replicates of the mean over seeds of the first arm's mean less
    the second's. A replicate draws groups, the same for all arms and seeds; only sums by group are repeated."""
    known = df.where(F.col(arm).isin(*arms))
    sums = known.groupBy(F.col(group).alias("g"), F.col(arm).alias("a"), F.col(seed).alias("k")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("m", multiplicity(F.col("g"), F.col("replicate"), salt))
    share = lambda a: ratio(*[F.sum(F.when(F.col("a") == a, F.col("m") * F.col(c))) for c in ("s", "n")])
    by_seed = drawn.groupBy("replicate", "k").agg((share(arms[0]) - share(arms[1])).alias("delta"))
    deltas = by_seed.groupBy("replicate").agg(F.avg("delta").alias("delta"))
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return deltas.agg(F.avg("delta").alias("mean"), q.alias("q"), F.count("*").alias("replicates")).select(
        "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "replicates"
    )


def gate(df: DataFrame, ap_drop: float = 0.01, night_drop: float = 0.05, images: int = 20, objects: int = 100) -> DataFrame:
    """df: baseline_ap, ap, baseline_night, night, night_images, night_objects. The decision and its reasons."""
    supported = F.coalesce((F.col("night_images") >= images) & (F.col("night_objects") >= objects), F.lit(False))
    ap_delta, night_delta = F.col("ap") - F.col("baseline_ap"), F.col("night") - F.col("baseline_night")
    reasons = F.array_compact(
        F.array(F.when(ap_delta < -ap_drop, "AP regression"), F.when(supported & (night_delta < -night_drop), "night recall regression"))
    )
    decision = F.when(ap_delta.isNull(), "INSUFFICIENT_EVIDENCE").when(F.size(reasons) > 0, "REJECT").when(~supported, "INSUFFICIENT_EVIDENCE")
    return df.withColumns(
        {"ap_delta": ap_delta, "night_delta": F.when(supported, night_delta), "decision": decision.otherwise("PASS"), "reasons": reasons}
    )
