"""Mixing sources to target weights by Poisson replication.

A source with share w of the mixture and n of the N documents has the target repetition rate w N / n. Each document is
repeated as often as a Poisson variable of that mean says, by inverting its distribution at a uniform number that a
seeded hash of the document gives: independent of partitioning, and the same on every run. A rate above `PART_RATE` is
the sum of equal rates below it, each with a uniform number of its own, so that a table of the distribution has a bounded
length. The copies are shuffled globally by a hash of document and copy; documents of many copies are dealt out in pieces
of at most `PIECE` copies before their texts are repeated.

Only DataFrame functions are used. The rates are one row for each source; they are broadcast while there are at most
`BROADCAST_SOURCES`, and joined by a shuffle beyond.

Defined results: documents without a source form a source of their own; sources without a weight get none of the
mixture when weights are given, and equal weights when none are; a source of weight zero is left out; null texts and
ids are repeated like others; rows that repeat id and text are repeated alike. All columns are kept, but columns of the
input named `n_copies` and `copy` are replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_SOURCES = 10_000
PART_RATE = 512
PIECE = 1000
SEED = "mix-1"
#: Hexadecimal digits of the hash that make the uniform number: 52 bits.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, joined by colons."""
    line = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    head = F.conv(F.substring(F.md5(line.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (head + 0.5) / float(16**DIGITS)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 to where the rest of the distribution is below 1e-15, as an array; rate: at most PART_RATE."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(
        (-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all")
    )

    def add(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add)["all"]


def rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """__mix_source, the number of parts of its rate, and the distribution of a part. weights: (source, weight), any
    scale; all sources alike if None."""
    counts = docs.groupBy(F.col("source").alias("__mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum("weight").cast("double").alias("w"))
        weighted = counts.join(given, F.col("__mix_source").eqNullSafe(F.col("given"))).where("w > 0")
    totals = weighted.agg(F.sum("w").alias("all_w"))
    documents = counts.agg(F.sum("n").alias("all_n"))
    # One row each: the joins are with a single row, not between tables.
    out = weighted.join(F.broadcast(totals)).join(F.broadcast(documents))
    rated = out.select("__mix_source", (F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).alias("rate"))
    parts = rated.withColumn("__mix_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
    return parts.withColumn("__mix_cdf", poisson_cdf(F.col("rate") / F.col("__mix_parts"))).drop("rate")


def _drawn(cdf: Column, at: Column) -> Column:
    return F.size(F.filter(cdf, lambda c: c < at)).cast("long")


def replicas(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The rows of docs with `n_copies` and `copy` (from 0), one row for each copy."""
    by_source = rates(docs, weights)
    known = by_source.agg(F.count("*").alias("n"), F.max("__mix_parts").alias("parts")).first()
    small = known["n"] <= BROADCAST_SOURCES
    dealt = docs.join(F.broadcast(by_source) if small else by_source, F.col("source").eqNullSafe(F.col("__mix_source")))
    cdf, first = F.col("__mix_cdf"), _drawn(F.col("__mix_cdf"), uniform(F.lit(seed), F.col("doc_id")))
    more = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__mix_parts") - 1)),
        F.lit(0).cast("long"),
        lambda acc, i: acc + _drawn(cdf, uniform(F.lit(seed), F.col("doc_id"), i)),
    )
    drawn = first if (known["parts"] or 1) == 1 else first + F.when(F.col("__mix_parts") > 1, more).otherwise(0)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_copies", "copy")]
    repeated = dealt.select(*others, drawn.alias("__mix_n")).where("__mix_n > 0")
    if (known["parts"] or 1) == 1:
        copies = repeated.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_n") - 1)))
    else:  # pieces of documents with many copies go to several tasks before their texts are repeated
        pieces = repeated.withColumn("__mix_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_n") - 1, F.lit(PIECE).cast("long"))))
        spread = pieces.repartition(F.xxhash64("doc_id", "__mix_from"))
        last = F.least(F.col("__mix_n"), F.col("__mix_from") + PIECE) - 1
        copies = spread.withColumn("__mix_copy", F.explode(F.sequence(F.col("__mix_from"), last)))
    return copies.select(*others, F.col("__mix_n").alias("n_copies"), F.col("__mix_copy").alias("copy"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The mixture, dealt to partitions and ordered within them by a hash of document and copy."""
    copies = replicas(docs, weights, seed).withColumn(
        "__mix_order", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.col("copy"))
    )
    return copies.repartition(F.col("__mix_order")).sortWithinPartitions("__mix_order").drop("__mix_order")
