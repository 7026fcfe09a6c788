"""Digests of values and of tables.

A value's digest is that of its canonical JSON: keys sorted, no blanks, ASCII escapes, the shortest digits of a number. A
table's digest is the root of a tree that doesn't depend on the order of rows: leaves are rows' digests sorted into
branches by their first hexadecimal digits, and a node's digest is that of its children's, in order. Rows' digests are
uniform, equal rows are counted first, and the depth follows the number of rows, so that no node has more than about
LEAF_ROWS children, however large the table or a key. Two trees show from the root down which branches differ, and only
rows of those are compared."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.scratch import written
from .contracts import ContractError

#: Hexadecimal digits by level, and rows that a leaf branch is to have at most, on average.
DIGITS, LEAF_ROWS = 3, 4096


def _plain(value, kind: pa.DataType):
    """A value as JSON has it: maps and structs are objects, floats of 32 bits the doubles that they are."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return {_name(k): _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    if isinstance(value, bool | int | float | str):
        return value
    raise TypeError(f"{kind} has no JSON form; cast it first")


def _name(key) -> str:
    return key if isinstance(key, str) else json.dumps(key)


def canonical_json(value: Column | str) -> Column:
    """The canonical JSON of a nested value; null is `null`. Numbers that aren't finite, and dates, decimals and bytes, are
    an error."""

    @arrow_udf("string")
    def dump(column: pa.Array) -> pa.Array:
        return pa.array([json.dumps(_plain(v, column.type), sort_keys=True, separators=(",", ":"), allow_nan=False) for v in column.to_pylist()], pa.string())

    return dump(value)


def digest(value: Column) -> Column:
    """SHA-256 of a nested value's canonical JSON."""
    return F.sha2(canonical_json(value).cast("binary"), 256)


def hashed(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, h: each row's digest over the columns, all if none are named."""
    return rows.select(key, digest(F.struct(*(columns or rows.columns))).alias("h"))


def depth_of(n: int) -> int:
    """Levels below the root for n rows."""
    depth = 1
    while n > LEAF_ROWS * 16 ** (DIGITS * depth):
        depth += 1
    return depth


def tree(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """level, prefix, digest, n of all nodes; the root is level 0. rows: h."""
    depth = depth or depth_of(rows.count())
    joined = lambda c: F.sha2(F.array_join(c, "").cast("binary"), 256).alias("digest")
    times = rows.groupBy("h").agg(F.count("*").alias("n"))
    text = F.when(F.col("n") > 1, F.concat_ws("x", "h", "n")).otherwise(F.col("h"))
    leaf = times.groupBy(F.substring("h", 1, DIGITS * depth).alias("prefix")).agg(joined(F.array_sort(F.collect_list(text))), F.sum("n").alias("n"))
    levels = [written(leaf.select(F.lit(depth).alias("level"), "prefix", "digest", "n"))]
    for level in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        up = levels[-1].groupBy(F.substring("prefix", 1, DIGITS * level).alias("p")).agg(joined(F.transform(children, lambda c: c["digest"])), F.sum("n").alias("n"))
        levels.append(up.select(F.lit(level).alias("level"), F.col("p").alias("prefix"), "digest", "n"))
    return reduce(DataFrame.union, levels)


def root(nodes: DataFrame) -> DataFrame:
    """digest, n of a tree; an empty table has none."""
    return nodes.where("level = 0").select("digest", "n")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, prefix of the nodes that two trees of one depth don't share, those of equal parents left out."""
    other = b.select("level", "prefix", F.col("digest").alias("other"))
    return a.join(other, ["level", "prefix"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("level", "prefix")


def changes(recorded: DataFrame, current: DataFrame, key: str, depth: int | None = None) -> DataFrame:
    """key, detail (gone, new, changed) of the keys whose rows differ. Only rows of branches that differ are joined."""
    depth = depth or depth_of(recorded.count())
    leaves = differing(tree(recorded, depth), tree(current, depth)).where(F.col("level") == depth).select("prefix")
    prefix = F.substring("h", 1, DIGITS * depth)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("prefix", prefix).join(leaves, "prefix", "left_semi").groupBy(F.col(key).alias("k"), "h").agg(F.count("*").alias(name))

    a, b = side(recorded, "was"), side(current, "is")
    both = a.join(b, a.k.eqNullSafe(b.k) & (a.h == b.h), "full").select(F.coalesce(a.k, b.k).alias("k"), F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("is", F.lit(0)).alias("is"))
    told = both.where("was <> is").groupBy("k").agg(F.max(F.col("was") > F.col("is")).alias("less"), F.max(F.col("is") > F.col("was")).alias("more"))
    detail = F.when(F.col("less") & F.col("more"), "changed").when(F.col("less"), "gone").otherwise("new")
    return told.select(F.col("k").alias(key), detail.alias("detail"))


def require_same(rows: DataFrame, recorded: DataFrame) -> None:
    """An error that names branches if the rows' tree isn't the recorded one."""
    depth = recorded.agg(F.max("level")).first()[0] or 1
    found = differing(tree(rows, depth), recorded).where(F.col("level") == depth).take(5)
    if found:
        raise ContractError(f"Digest differs in branches {sorted(r.prefix for r in found)}")


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n, a, b) that two tables share if they hold the same rows, repeats included, in any order and partitioning:
    the sums of two 64-bit hashes of each row, as decimals. Nothing is sorted, joined or shuffled but one row a task.
    Numbers are compared by their values, so -0.0 is 0.0; the columns must have the same types."""
    names = list(columns) or sorted(rows.columns)
    parts = [F.coalesce(F.xxhash64(F.lit(i), _comparable(rows, c)), F.lit(0)) for i, c in enumerate(names)]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *parts).cast("decimal(20,0)"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(total(1), F.lit(0).cast("decimal(30,0)")).alias("a"), F.coalesce(total(2), F.lit(0).cast("decimal(30,0)")).alias("b"))


def _comparable(rows: DataFrame, column: str) -> Column:
    kind = rows.schema[column].dataType.simpleString()
    value = F.col(column)
    if "map<" in kind:
        return F.to_json(F.struct(F.array_sort(F.map_entries(value)) if kind.startswith("map<") else value))
    if kind in ("double", "float"):
        value = value + F.lit(0.0)
    return F.struct(value.isNull(), value)


def parity(expected: DataFrame, actual: DataFrame, *columns: str) -> bool:
    """Whether two runs gave the same rows, by their fingerprints: one pass over each, and no row meets another."""
    if sorted((f.name, f.dataType.simpleString()) for f in expected.schema) != sorted((f.name, f.dataType.simpleString()) for f in actual.schema):
        return False
    one, two = fingerprint(expected, *columns).first(), fingerprint(actual, *columns).first()
    return tuple(one) == tuple(two)
