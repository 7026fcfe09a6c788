"""Running totals in an order, without one task that holds all rows.

The order's first column is cut into ranges at approximate quantiles. Each range of a group is a window of its own, and
the totals of the ranges before it, one row for each group and range, are added. Rows of one value stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def cuts_of(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Approximate quantiles of a numeric column, the bounds of its ranges."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, F.lit(10_000)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_of(column: Column, cuts: list[float]) -> Column:
    """The number of the range that a value falls in; nulls come before all others."""
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    return F.when(column.isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= column.cast("double"))))


def running(
    df: DataFrame, group: list[str], column: str, order: list[Column], totals: dict[str, Column], cuts: list[float], descending: bool = False
) -> DataFrame:
    """df with the running totals, up to and with each row, of `totals` by group in the order. `order` begins with
    `column`, falling if descending; cuts: of that column."""
    parts = {f"__t_{n}": c for n, c in totals.items()}
    dealt = df.withColumns({"__range": range_of(F.col(column), cuts), **parts})
    key = [*group, "__range"]
    sums = dealt.groupBy(*key).agg(*[F.sum(p).alias(p) for p in parts])
    way = F.desc("__range") if descending else F.asc("__range")
    before = W.partitionBy(*group).orderBy(way).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*key, *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"__o{p}") for p in parts])
    run = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.select(*df.columns, "__range", *[F.sum(p).over(run).alias(p) for p in parts])
    both = own.join(offsets, key)
    return both.select(*df.columns, *[(F.col(f"__t_{n}") + F.col(f"__o__t_{n}")).alias(n) for n in totals])
