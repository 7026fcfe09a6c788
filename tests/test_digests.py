"""Canonical JSON, trees of digests, parity of runs, drift."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import digests, provenance
from gleaner.operators.contracts import ContractError


def test_canonical_json(spark):
    values = [
        {"b": 1e-05, "a": 1e16, "é": "é\U0001f600\"\\/\n\x7f", "n": None, "l": [1, None, 3], "t": True, "m": {"z": 1, "a": 2}, "f": 0.1},
        {"b": -0.0, "a": 123456789.123, "é": "", "n": None, "l": [], "t": False, "m": {}, "f": 2.5},
        {"b": 5e-324, "a": 1e22, "é": "plain", "n": None, "l": None, "t": None, "m": None, "f": None},
    ]
    schema = "b double, a double, `é` string, n int, l array<long>, t boolean, m map<string,long>, f double"
    df = spark.createDataFrame([tuple(v.values()) for v in values], schema)
    want = [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values]
    whole = F.struct(*df.columns)
    assert [r[0] for r in df.select(digests.canonical_json(whole)).collect()] == want
    assert [r[0] for r in df.select(digests.digest(whole)).collect()] == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    nested = spark.sql("SELECT named_struct('z', array(named_struct('b', 1, 'a', 'x')), 'k', map(2, 'two', 10, 'ten')) AS v")
    assert nested.select(digests.canonical_json("v")).first()[0] == '{"k":{"10":"ten","2":"two"},"z":[{"a":"x","b":1}]}'
    assert spark.sql("SELECT CAST(NULL AS STRUCT<a: INT>) AS v").select(digests.canonical_json("v")).first()[0] == "null"
    for bad in ("double('nan')", "double('inf')", "current_date()", "binary('x')", "decimal(1.5)"):
        with pytest.raises(Exception, match="JSON"):
            spark.sql(f"SELECT named_struct('a', {bad}) AS v").select(digests.canonical_json("v")).collect()


def frame(spark, n, step=1):
    return spark.range(0, n, step, 3).select("id", F.sha2(F.concat(F.lit("row"), F.col("id").cast("string")).cast("binary"), 256).alias("h"))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tree_and_changes(spark, depth):
    rows = frame(spark, 600)
    nodes = digests.tree(rows, depth)
    root = digests.root(nodes).first()
    assert root.n == 600 and digests.root(digests.tree(rows.orderBy(F.desc("h")).repartition(2), depth)).first() == root
    assert {r.level: r.n for r in nodes.groupBy("level").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(range(depth + 1), 600)
    # As a loop.
    level = {}
    for h in sorted(r.h for r in rows.collect()):
        level.setdefault(h[: 3 * depth], []).append(h)
    level = {p: hashlib.sha256("".join(hs).encode()).hexdigest() for p, hs in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for p in sorted(level):
            up.setdefault(p[: 3 * d], []).append(level[p])
        level = {p: hashlib.sha256("".join(hs).encode()).hexdigest() for p, hs in up.items()}
    assert level == {"": root.digest}
    bent = rows.withColumn("h", F.when(F.col("id") == 5, F.reverse("h")).otherwise(F.col("h"))).where("id <> 7")
    bent = bent.union(spark.createDataFrame([(900, "f" * 64), (8, rows.where("id = 8").first().h), (None, "e" * 64)], "id long, h string"))
    got = {r.id: r.detail for r in digests.changes(rows, bent, "id", depth).collect()}
    assert got == {5: "changed", 7: "gone", 900: "new", 8: "new", None: "new"}
    few = digests.differing(nodes, digests.tree(bent, depth)).where(F.col("level") == depth).count()
    assert 4 <= few <= 6
    digests.require_same(rows.repartition(5), nodes)
    with pytest.raises(ContractError, match="branches"):
        digests.require_same(bent, nodes)


def test_tree_of_equal_rows_has_no_long_array(spark):
    """A third of all rows alike is one child with its count."""
    same = spark.range(3000).select(F.lit("a" * 64).alias("h"))
    leaf = digests.tree(same, 1).where("level = 1").first()
    assert leaf.n == 3000 and leaf.digest == hashlib.sha256(("a" * 64 + "x3000").encode()).hexdigest()
    assert digests.root(digests.tree(same, 1)).first() != digests.root(digests.tree(same.limit(2999), 1)).first()
    assert digests.root(digests.tree(same.limit(0))).collect() == []
    assert [digests.depth_of(n) for n in (0, 4096 * 4096, 4096 * 4096 + 1, 10**14)] == [1, 1, 2, 3]


def test_parity(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, [1, 2]), (1, "a", 0.5, [1, 2]), (2, None, None, None), (None, "b", -0.0, [])], "k long, s string, d double, l array<int>")
    assert digests.parity(rows, rows.repartition(3).select("l", "d", "s", "k"))
    assert digests.parity(rows, rows.withColumn("d", F.when(F.col("d") == 0, 0.0).otherwise(F.col("d"))))
    assert not digests.parity(rows, rows.distinct())
    assert not digests.parity(rows, rows.withColumn("k", F.col("k").cast("int")))
    assert not digests.parity(rows, rows.withColumn("s", F.coalesce("s", F.lit(""))))
    swapped = rows.withColumns({"s": F.when(F.col("k") == 2, "b").when(F.col("k").isNull(), None).otherwise(F.col("s"))})
    assert not digests.parity(rows, swapped)
    assert digests.parity(rows.limit(0), rows.where("k = 99")) and not digests.parity(rows.limit(0), rows)
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    assert digests.parity(maps, spark.sql("SELECT map('b', 2, 'a', 1) AS m")) and not digests.parity(maps, spark.sql("SELECT map('b', 1, 'a', 2) AS m"))


def test_drift_marks_just_its_dependants(spark):
    files = lambda **d: spark.createDataFrame(list(d.items()), "artifact string, digest string")
    recorded = files(manifest="1", weights="1", protocol="1", predictions="1", evaluation="1", report="1", other="1")
    edges = spark.createDataFrame(
        [("predictions", "manifest", "1"), ("predictions", "weights", "1"), ("evaluation", "predictions", None), ("report", "evaluation", "1"), ("report", "protocol", "0"), ("protocol", "report", None)],
        "artifact string, input string, input_digest string",
    )
    got = lambda now: {r.artifact: (r.reason, r.distance) for r in provenance.stale(edges, recorded, now).collect()}
    made = {"report": ("made from another version", 1), "protocol": ("made from it", 2)}
    assert got(recorded) == made
    now = files(manifest="1", weights="2", protocol="1", predictions="1", evaluation="1", report="1", new="1")
    assert got(now) == made | {
        "weights": ("changed", 0), "predictions": ("made from it", 1), "evaluation": ("made from it", 2), "other": ("gone", 0), "new": ("not recorded", 0),
    } | {"predictions": ("made from another version", 1)}
