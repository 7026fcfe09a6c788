"""Integrity contracts. Each gives a table of violations (rule, key, detail); `enforce` stops the run if one has rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite

# The columns that selection may see.
POOL_COLUMNS = ("sample_id", "group_id", "split", "image_path", "sha256")


class ContractError(ValueError):
    """A contract is violated."""


def violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, column: str) -> DataFrame:
    again = df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return violations(again, f"unique {column}", F.col(column), F.col("n"))


def one_value_per_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """A group lies in one split only."""
    spread = df.groupBy(group).agg(F.count_distinct(column).alias("n")).where("n > 1")
    return violations(spread, f"one {column} per {group}", F.col(group), F.col("n"))


def complete(left: DataFrame, right: DataFrame, key: str, same: str | None = None) -> DataFrame:
    """Every left row has a right one (with the same content), and no right row is left over."""
    a, b = left.select(key, *([same] if same else [])), right.select(key, *([F.col(same).alias("__same")] if same else []), F.lit(1).alias("__there"))
    joined = a.join(b.hint("merge"), key, "left")  # both grow with the input: neither is broadcast
    missing = violations(joined.where("__there is null"), "missing", F.col(key), F.lit("no row"))
    extra = violations(right.join(left.select(key).hint("merge"), key, "left_anti"), "unexpected", F.col(key), F.lit("extra row"))
    out = missing.union(extra)
    if same:
        stale = joined.where(F.col("__there").isNotNull() & ~F.col(same).eqNullSafe(F.col("__same")))
        out = out.union(violations(stale, "stale", F.col(key), F.col("__same")))
    return out


def box_errors(x1: Column, y1: Column, x2: Column, y2: Column, label: Column, score: Column | None = None, labels: int = 7) -> Column:
    """The first broken rule of an object, or null."""
    corners = reduce(Column.__and__, [finite(c) for c in (x1, y1, x2, y2)])
    out = F.when(~F.coalesce(corners, F.lit(False)), "box is not finite").when((x2 <= x1) | (y2 <= y1), "box is empty")
    out = out.when(label.isNull() | ~label.between(0, labels - 1), "unknown label")
    if score is not None:
        out = out.when(~F.coalesce(finite(score), F.lit(False)) | ~score.between(0.0, 1.0), "score is out of range")
    return out


def pool(df: DataFrame) -> DataFrame:
    """Selection sees just its columns, and rows of the pool only."""
    if sorted(df.columns) != sorted(POOL_COLUMNS):
        raise ContractError(f"Pool columns: {sorted(df.columns)}")
    return violations(df.where("split is distinct from 'pool'"), "pool only", F.col("sample_id"), F.col("split"))


def budget(n: int, available: int) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or not 0 < n <= available:
        raise ContractError(f"Budget {n!r} outside of {available}")


def limit(n: int, available: int, least: int = 20) -> None:
    """A sample of at least `least` rows that the source has."""
    if isinstance(n, bool) or not isinstance(n, int) or not least <= n <= available:
        raise ContractError(f"Limit {n!r} outside of {least} to {available}")


def roles(df: DataFrame, key: str, role: str, split: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows whose split their role must not use; a role that isn't named may use none. With a role for training,
    selection and control each, or for development only."""
    fits = reduce(Column.__or__, [(F.col(role) == r) & F.col(split).isin(splits) for r, splits in allowed.items()], F.lit(False))
    return violations(df.where(~F.coalesce(fits, F.lit(False))), "split of role", F.col(key), F.concat_ws(" in ", role, split))


def prediction_errors(embedding: Column, latency: Column) -> Column:
    """The first broken rule of a prediction, or null: a nonempty vector of finite numbers, a finite time not below zero."""
    numbers = F.forall(embedding, lambda x: F.coalesce(finite(x), F.lit(False)))
    out = F.when(embedding.isNull() | (F.size(embedding) == 0), "embedding is empty").when(~numbers, "embedding is not finite")
    return out.when(~F.coalesce(finite(latency), F.lit(False)) | (latency < 0), "latency is out of range")


def nonempty(df: DataFrame, split: str, wanted: list[str]) -> DataFrame:
    """Splits that have no rows."""
    want = df.sparkSession.createDataFrame([(w,) for w in wanted], "__want string")
    return violations(want.join(df, F.col("__want") == F.col(split), "left_anti"), "empty split", F.col("__want"), F.lit("no row"))


def version(df: DataFrame, key: str, column: str, wanted: str) -> DataFrame:
    """Rows of another version than the wanted one."""
    return violations(df.where(~F.col(column).eqNullSafe(F.lit(wanted))), f"one {column}", F.col(key), F.col(column))


def chain(df: DataFrame, path: str, order: str, previous: str, current: str) -> DataFrame:
    """Each step of a path starts from the digest that the step before left; the first one from none (null)."""
    left = F.lag(current).over(W.partitionBy(path).orderBy(order))
    broken = df.withColumn("__left", left).where(~F.col(previous).eqNullSafe(F.col("__left")))
    return violations(broken, "chain", F.col(path), F.col(order))


def replay(recorded: DataFrame, again: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Metrics that differ when computed again, or that one side lacks."""
    a, b = recorded.select(key, F.col(value).alias("__was")), again.select(key, F.col(value).alias("__is"))
    same = F.col("__was").eqNullSafe(F.col("__is")) | (F.abs(F.col("__was") - F.col("__is")) <= tolerance)
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), key, "full")
    detail = F.when(F.col("__a").isNull(), "not recorded").when(F.col("__b").isNull(), "not recomputed")
    detail = detail.when(~F.coalesce(same, F.lit(False)), "differs")
    return violations(both.where(detail.isNotNull()), "replay", F.col(key), detail)


def safe_path(path: Column) -> Column:
    """Whether a relative path stays in its folder."""
    return ~(path.rlike(r"^[/\\]") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)"))


def allow_list(current: DataFrame, allowed: DataFrame) -> DataFrame:
    """current, allowed: (path, sha256). Files that are gone, changed, or not foreseen."""
    a = allowed.select("path", F.col("sha256").alias("want"))
    both = a.join(current.select("path", F.col("sha256").alias("got")), "path", "full")
    detail = F.when(F.col("got").isNull(), "gone").when(F.col("want").isNull(), "not listed").when(F.col("got") != F.col("want"), "changed")
    return violations(both.where(detail.isNotNull()), "artifact", F.col("path"), detail)


def enforce(*tables: DataFrame) -> None:
    found = reduce(DataFrame.union, tables).take(5)
    if found:
        raise ContractError("; ".join(f"{r.rule}: {r.key} ({r.detail})" for r in found))
