"""Long hashes, classes of thumbnails, acceptance by ranges, the prefix tree, lazy diverse selection: against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import neighbours, selection, trie
from gleaner.operators.contracts import ContractError


def thumbs(seed, n):
    """Thumbnails of 16 rows of 17: some near each other, some equal."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            v = list(draw.choice(out))
            for _ in range(draw.choice([0, 1, 3, 9, 40])):
                v[draw.randrange(272)] = draw.randrange(256)
        else:
            v = [draw.randrange(256) for _ in range(272)]
        out.append(v)
    return out


def bits_of(v):
    a = np.array(v).reshape(16, 17)
    return a[:, :-1], a[:, 1:] > a[:, :-1]


def near(a, b):
    (x, p), (y, q) = bits_of(a), bits_of(b)
    return int(np.count_nonzero(p != q)) <= 8 and float(np.abs(x - y).mean()) < 5


def test_hash_of_256_bits(spark):
    values = thumbs(1, 20) + [[7] * 272, list(range(272)), list(range(272, 0, -1))]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for r, v in zip(df.select(neighbours.thumbnail_hash(F.col("v"), 17, 16).alias("w")).collect(), values, strict=True):
        flat = bits_of(v)[1].reshape(-1)
        assert r.w == [int("".join("01"[int(b)] for b in flat[i : i + 32]), 2) for i in range(0, 256, 32)]


def test_classes_against_all_pairs(spark):
    values = thumbs(2, 120)
    df = spark.createDataFrame(list(enumerate(values)), "k long, v array<int>")
    members, links = neighbours.thumbnail_links(df, "k", "v", 17, 16, 8, 5.0)
    of = {r.k: r["class"] for r in members.collect()}
    assert of == {i: values.index(v) for i, v in enumerate(values)} and len(set(of.values())) < len(of)
    heads = sorted(set(of.values()))
    want = {(a, b) for a in heads for b in heads if a < b and near(values[a], values[b])}
    got = [(r.a, r.b) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) > 20


@pytest.mark.parametrize("bits,distance", [(40, 3), (64, 8), (33, 0), (70, 69)])
def test_bands_of_odd_sizes(spark, bits, distance):
    draw = random.Random(bits)
    values = [draw.getrandbits(bits) for _ in range(30)]
    values += [v ^ (1 << draw.randrange(bits)) ^ (1 << draw.randrange(bits)) for v in values] + [0, (1 << bits) - 1]
    words = lambda v: [int(format(v, f"0{bits}b")[i : i + 32], 2) for i in range(0, bits, 32)]
    df = spark.createDataFrame([(i, words(v)) for i, v in enumerate(values)], "k long, w array<long>")
    members, links = neighbours.near_classes(df, "k", "w", bits, distance)
    of = {r.k: r["class"] for r in members.collect()}
    heads = sorted(set(of.values()))
    want = {(a, b, (values[a] ^ values[b]).bit_count()) for a in heads for b in heads if a < b and (values[a] ^ values[b]).bit_count() <= distance}
    got = [tuple(r) for r in links.collect()]
    assert set(got) == want and len(got) == len(want)


def test_many_equal_rows_are_no_pairs(spark):
    df = spark.range(100_000).select("id", F.array(F.lit(5).cast("long"), F.lit(9).cast("long")).alias("w"))
    members, links = neighbours.near_classes(df, "id", "w", 64, 4)
    assert members.where("class = 0").count() == 100_000 and links.count() == 0


@pytest.mark.parametrize("per_range,quota", [(7, 12), (1000, 12), (20, 40)])
def test_accepted_as_by_a_loop(spark, per_range, quota):
    values = thumbs(3, 130)
    order = list(range(130))
    random.Random(9).shuffle(order)
    rows = [(i, float(order[i] // 2), values[i]) for i in range(10, 130)]  # ties of the order
    taken = [(i, values[i]) for i in range(10)]
    held, want, turned = list(taken), [], set()
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        found = [k for k, u in held if near(u, v)]
        if found:
            turned |= {(i, k) for k in found}
            continue
        held.append((i, v))
        want.append(i)
        if len(want) == quota:
            break
    df, old = spark.createDataFrame(rows, "k long, o double, v array<int>"), spark.createDataFrame(taken, "k long, v array<int>")
    links = lambda d: neighbours.thumbnail_links(d, "k", "v", 17, 16, 8, 5.0)
    if len(want) < quota:
        with pytest.raises(ContractError, match=f"Only {len(want)}"):
            neighbours.accept_until(df, "k", "o", links, quota, old, per_range)
        return
    kept, away = neighbours.accept_until(df, "k", "o", links, quota, old, per_range)
    assert [r.k for r in kept.orderBy("o", "k").collect()] == want
    assert {(r.k, r.neighbour) for r in away.collect()} == turned and (turned or quota == 12)


def test_ranges_behind_the_quota_are_not_read(spark, monkeypatch):
    seen = []
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("o"), F.array(F.col("id") * 7919 * 65537 % 2**32).alias("w"))

    def links(d):
        seen.append(d.count())
        return neighbours.near_classes(d, "id", "w", 32, 0)

    kept, _ = neighbours.accept_until(df, "id", "o", links, 50, per_range=100)
    assert kept.count() == 50 and sum(seen) <= 250


def test_ranges_are_few(spark, monkeypatch):
    seen, old = [], neighbours.range_of
    monkeypatch.setattr(neighbours, "range_of", lambda column, cuts: seen.append(len(cuts)) or old(column, cuts))
    df = spark.range(3000).select("id", F.col("id").cast("double").alias("o"), F.array(F.col("id") * 7919 * 65537 % 2**32).alias("w"))
    kept, _ = neighbours.accept_until(df, "id", "o", lambda d: neighbours.near_classes(d, "id", "w", 32, 0), 2, per_range=4)
    assert [r.id for r in kept.orderBy("o").collect()] == [0, 1] and seen[0] <= 10


def test_one_hash_of_many_values_is_no_square(spark):
    """20,000 rows of one hash, all far from each other but for three."""
    df = spark.range(20_000).select("id", F.array(*[F.col("id").cast("double") * 8 + i for i in range(8)]).alias("v"))
    df = df.union(spark.createDataFrame([(50_000, [80.0 + i for i in range(8)]), (50_001, [80.01 + i for i in range(8)])], df.schema))
    assert {tuple(r) for r in neighbours.alike(df, "id", "v", 7, 2, 0.5).collect()} == {(10, 50_000, 0), (10, 50_001, 0), (50_000, 50_001, 0)}


@pytest.mark.parametrize("most", [0.0, 0.02, 0.3, 5.0])
def test_alike_against_all_pairs(spark, most):
    draw = np.random.default_rng(4)
    values = draw.normal(size=(60, 11)).round(3).tolist()
    values += [[x + float(draw.choice([0, 0, 0.1, -0.1])) for x in v] for v in values] + values[:9] + [[1.0] * 5, [1.0] * 5, [], None, [None] * 11, [float("nan")] * 11, [float("inf")] * 11]
    hash_of = lambda v: [v[i] > v[i + 1] for i in range(min(10, len(v) - 1))]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v array<double>")
    known = range(129)
    want = {
        (a, b, d) for a in known for b in known if a < b and (d := sum(p != q for p, q in zip(hash_of(values[a]), hash_of(values[b])))) <= 2
        and sum(abs(x - y) for x, y in zip(values[a], values[b])) / 11 < most
    }
    got = [tuple(r) for r in neighbours.alike(df, "k", "v", 10, 2, most).collect()]
    assert set(got) == want and len(got) == len(want) and (want or not most)


def test_prefix_tree(spark):
    labels = spark.createDataFrame([("day", [10, 11]), ("night", [20])], "k string, t array<int>")
    tree = trie.transitions(labels, "k", "t")

    def allowed(*prefixes, of=tree):
        asked = spark.createDataFrame([(i, list(p)) for i, p in enumerate(prefixes)], "i int, t array<int>")
        out = {}
        for r in trie.allowed_next(of, asked, "i", "t").collect():
            out.setdefault(prefixes[r.i], []).append(99 if r.token is None else r.token)
        return {p: sorted(v) for p, v in out.items()}

    assert allowed((), (10,), (20,), (10, 11)) == {(): [10, 20], (10,): [11], (20,): [99], (10, 11): [99]}
    for bad in ((30,), (11,), (10, 11, 12), (20, 10)):
        with pytest.raises(ContractError, match="Invalid prefixes"):
            allowed((10,), bad)
    more = spark.createDataFrame([("e", []), ("a", [1]), ("b", [1, 1]), ("c", [1, 1, 1]), ("d", [1, 2])], "k string, t array<int>")
    assert allowed((), (1,), (1, 1), of=trie.transitions(more, "k", "t")) == {(): [1, 99], (1,): [1, 2, 99], (1, 1): [1, 99]}


def test_long_sequences_take_linear_space(spark):
    long = spark.createDataFrame([("k", list(range(20_000)))], "k string, t array<int>")
    tree = trie.transitions(long, "k", "t")
    assert tree.count() == 20_001 and tree.groupBy("depth").count().where("count > 1").count() == 0
    asked = spark.createDataFrame([(1, list(range(19_999)))], "i int, t array<int>")
    assert [r.token for r in trie.allowed_next(tree, asked, "i", "t").collect()] == [19_999]


@pytest.mark.parametrize("pool", [1, 3, 40, 2048])
def test_diverse_selection_against_a_loop(spark, pool):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(160, 6)).round(2)
    vectors[40:60] = vectors[:20]
    factors = (draw.integers(0, 8, 160) / 8).tolist()
    groups = [None if i % 23 == 0 else i % 45 for i in range(160)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen, used = [], set()
    while len(chosen) < 30:
        apart = np.min([(1 - unit @ unit[c]) / 2 for c, _ in chosen], axis=0) if chosen else None
        score = np.array(factors) if apart is None else np.round(0.5 * np.array(factors) + 0.5 * apart, 12)
        free = [i for i in range(160) if groups[i] not in used]
        best = max(free, key=lambda i: (score[i], -i))
        chosen.append((best, score[best]))
        used.add(groups[best])
    df = spark.createDataFrame([(i, groups[i], factors[i], vectors[i].tolist()) for i in range(160)], "k long, g long, f double, v array<double>")
    got = selection.diverse(df, 30, "k", "g", "f", "v", pool).orderBy("rank").collect()
    assert [r.k for r in got] == [c for c, _ in chosen]
    assert [r.score for r in got] == pytest.approx([s for _, s in chosen])


@pytest.mark.parametrize("bad", [None, [], [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0]])
def test_vectors_without_direction_raise(spark, bad):
    df = spark.createDataFrame([(1, "a", 0.5, [1.0, 0.0]), (2, "b", 0.5, bad)], "k long, g string, f double, v array<double>")
    with pytest.raises(ContractError, match="Invalid vectors"):
        selection.diverse(df, 2, "k", "g", "f", "v")
