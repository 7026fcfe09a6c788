"""Every query that has SQL against that SQL, and the operators' hand cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gleaner.functions import scalars as S
from gleaner.operators import coco, contracts, journal, matching, neighbours, selection, statistics
from gleaner.plans import queries as plans
from gleaner.sources import tables

GOLD = "image long, cls int, j long, x1 double, y1 double, x2 double, y2 double"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return list(value) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_sql(spark, duck, sf, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda many, names: sorted(([plain(r[names.index(c)]) for c in columns] for r in many), key=repr)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(df):
    return df.first().asDict()


def test_matching_cases(spark):
    gold = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0)], GOLD)
    pred = lambda *rows: spark.createDataFrame(list(rows), GOLD + ", score double")
    box = (0.0, 0.0, 10.0, 10.0)

    def counts(p):
        r = matching.counts(gold, p, matching.match(gold, p)).where("image = 1").first()
        return r.tp, r.fp, r.fn

    assert counts(pred((1, 0, 1, *box, 0.9), (1, 0, 2, *box, 0.9))) == (1, 1, 0)
    assert counts(pred((1, 1, 1, *box, 0.9))) == (0, 1, 1)
    assert counts(pred((1, 0, 1, *box, 0.49))) == (0, 0, 1)
    two = gold.union(spark.createDataFrame([(1, 0, 2, *box)], GOLD))
    assert matching.match(two, pred((1, 0, 1, *box, 0.9))).first().j == 2  # ties go to the later box


def twin(gold, preds):
    """The detection metrics as loops."""
    cells = {}
    for cls in {g[1] for g in gold}:
        for area, (lo, hi) in coco.AREAS.items():
            size = lambda b: (b[5] - b[3]) * (b[6] - b[4])
            npos = sum(g[1] == cls and lo <= size(g) <= hi for g in gold)
            if not npos:
                continue
            for t in coco.THRESHOLDS:
                judged = []
                for image in sorted({b[0] for b in [*gold, *preds]}):
                    gs = sorted((g for g in gold if g[:2] == (image, cls)), key=lambda g: (not lo <= size(g) <= hi, g[2]))
                    ps = sorted((p for p in preds if p[:2] == (image, cls)), key=lambda p: (-p[7], p[2]))[:100]
                    used = set()
                    for rank, p in enumerate(ps):
                        best, at = min(t, 1 - 1e-10), None
                        for k, g in enumerate(gs):
                            out = not lo <= size(g) <= hi
                            if k in used or (at is not None and out and lo <= size(gs[at]) <= hi):
                                continue
                            w = max(0, min(p[5], g[5]) - max(p[3], g[3])) * max(0, min(p[6], g[6]) - max(p[4], g[4]))
                            iou = w / (size(p) + size(g) - w)
                            if iou >= best:
                                best, at = iou, k
                        if at is not None:
                            used.add(at)
                        ignored = not lo <= size(gs[at]) <= hi if at is not None else not lo <= size(p) <= hi
                        judged.append((-p[7], image, rank, at is not None, ignored))
                for lim in coco.LIMITS:
                    tp = n = 0
                    curve = []
                    for _, _, rank, hit, ignored in sorted(judged):
                        if rank < lim and not ignored:
                            tp, n = tp + hit, n + 1
                            curve.append((tp / npos, tp / n))
                    ap = sum(max((pr for rc, pr in curve if rc >= r), default=0) for r in coco.LEVELS) / 101
                    cells[cls, area, t, lim] = ap, max((rc for rc, _ in curve), default=0)
    return cells


def test_coco(spark):
    import random

    rng = random.Random(4)
    gold, preds = [], []
    for image in range(6):
        for j in range(8):
            x, y, w = rng.randrange(40), rng.randrange(40), rng.choice([6, 20, 40, 90])
            cls = rng.randrange(2)
            gold.append((image, cls, j, float(x), float(y), float(x + w), float(y + w)))
            for d in rng.sample(range(4), rng.randrange(3)):
                preds.append((image, cls, len(preds), float(x + d), float(y), float(x + w), float(y + w + d), rng.choice([0.2, 0.5, 0.9])))
    got = coco.curves(spark.createDataFrame(gold, GOLD), spark.createDataFrame(preds, GOLD + ", score double")).collect()
    want = twin(gold, preds)
    assert {(r.cls, r.area, r.thr, r.lim) for r in got} == set(want)
    for r in got:
        assert (r.ap, r.recall) == pytest.approx(want[r.cls, r.area, r.thr, r.lim], abs=1e-12)
    perfect = coco.summary(spark.createDataFrame(gold[:3], GOLD), spark.createDataFrame([(*g, 0.9) for g in gold[:3]], GOLD + ", score double")).first()
    assert perfect.AP == pytest.approx(1.0) and perfect.AP_large is None or perfect.AP_large == pytest.approx(1.0)


def test_contracts(spark):
    rows = spark.createDataFrame([("a", "g", "pool", "p", "1"), ("b", "g", "pool", "q", "2")], ", ".join(f"{c} string" for c in contracts.POOL_COLUMNS))
    contracts.enforce(contracts.pool(rows), contracts.unique(rows, "sample_id"))
    with pytest.raises(contracts.ContractError):
        contracts.pool(rows.withColumn("ground_truth", F.lit(1)))
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.complete(rows, rows.where("sample_id = 'a'"), "sample_id", "sha256"))
    stale = rows.withColumn("sha256", F.lit("1"))
    assert [r.rule for r in contracts.complete(rows, stale, "sample_id", "sha256").collect()] == ["stale"]
    for bad in (0, -1, 3, True, 1.5):
        with pytest.raises(contracts.ContractError):
            contracts.budget(bad, 2)
    nan, inf = float("nan"), float("inf")
    boxes = [(0.0, 0.0, -1.0, 1.0, 0, 0.5), (0.0, 0.0, nan, 1.0, 0, 0.5), (2.0, 0.0, 1.0, 1.0, 0, 0.5), (0.0, 0.0, 1.0, inf, 0, 0.5), (0.0, 0.0, 1.0, 1.0, 999, 0.5),
             (0.0, 0.0, 1.0, 1.0, 0, 1.1), (0.0, 0.0, 1.0, 1.0, 0, nan), (0.0, 0.0, 1.0, 1.0, 0, 0.5)]
    df = spark.createDataFrame(boxes, "a double, b double, c double, d double, l int, s double")
    errors = [r[0] for r in df.select(contracts.box_errors(*[F.col(c) for c in "abcdls"])).collect()]
    assert [e is None for e in errors] == [False] * 7 + [True]
    paths = spark.createDataFrame([("a/b.jpg",), ("../x",), ("/etc",), ("a/../../b",), ("a..b",)], "p string")
    assert [r[0] for r in paths.select(contracts.safe_path(F.col("p"))).collect()] == [True, False, False, False, True]


def test_statistics(spark):
    df = lambda rows: spark.createDataFrame(rows, "y boolean, s double")
    assert statistics.auc(df([(True, 1.0), (False, 1.0)]), "y", "s").first().auc == 0.5
    assert statistics.auc(df([(True, 0.0), (False, 1.0)]), "y", "s").first().auc == 0
    assert statistics.auc(df([(True, 0.0)]), "y", "s").first().auc is None
    assert statistics.spearman(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), "a", "b").first().spearman is None
    gate = lambda ap, images: statistics.gate(spark.createDataFrame([(0.2, ap, 0.5, 0.5, images, 200)], "baseline_ap double, ap double, baseline_night double, night double, night_images int, night_objects int")).first().decision
    assert [gate(0.3, 5), gate(0.1, 5), gate(0.3, 30), gate(0.1, 30), gate(None, 30)] == ["INSUFFICIENT_EVIDENCE", "REJECT", "PASS", "REJECT", "INSUFFICIENT_EVIDENCE"]


def test_selection(spark):
    rows = spark.createDataFrame([("a", "g1", 0.5, [1.0, 0.0]), ("b", "g2", 0.5, [1.0, 0.0]), ("c", "g3", 0.1, [0.0, 1.0])], "k string, g string, f double, v array<double>")
    for df in (rows, rows.orderBy(F.desc("k"))):
        assert [r.k for r in selection.diverse(df, 2, "k", "g", "f", "v").orderBy("rank").collect()] == ["a", "c"]
    with pytest.raises(contracts.ContractError):
        selection.diverse(rows.withColumn("g", F.lit("x")), 2, "k", "g", "f", "v")
    assert selection.select(rows.withColumnRenamed("f", "uncertainty"), "uncertainty", 2, "s", "k").where("k = 'c'").count() == 0
    tags = spark.createDataFrame([("Daytime.",), (" night ",), ("daytime or night",), ("not night",), ("",)], "t string")
    assert [r[0] for r in tags.select(S.tag(F.col("t"))).collect()] == ["daytime", "night", None, None, None]
    audit = spark.createDataFrame([("night", None), ("daytime", "daytime")], "r string, v string")
    got = {r.label: r for r in statistics.classifier_summary(audit, "r", "v").collect()}
    assert got["night"].recall == 0 and got["night"].invalid == 1 and got["night"].accuracy == 0.5


def test_near_pairs(spark):
    import random

    rng = random.Random(1)
    values = [rng.getrandbits(20) for _ in range(150)] + [7, 7, 7 ^ 1, 7 ^ 6]
    df = spark.createDataFrame(list(enumerate(values)), "k long, h long")
    pairs = neighbours.near_pairs(df, "k", "h", 3, 20)
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    kept = []
    near = {(a, b) for a, b, _ in want}
    for i in range(len(values)):
        if not any((k, i) in near for k in kept):
            kept.append(i)
    got = neighbours.accept_in_order(df.withColumn("o", F.col("k")), pairs, "k", "o")
    assert sorted(r.k for r in got.collect()) == kept


def test_journal(spark):
    log = lambda rows: spark.createDataFrame([(*r, f"r{r[1]}", None) for r in rows], "key string, seq long, event string, result string, error string")
    first = [("a", 1, "start"), ("a", 2, "succeed"), ("b", 3, "start")]
    states = lambda rows: {r.key: (r.status, r.attempts) for r in journal.fold(log(rows)).collect()}
    assert states(first) == {"a": ("succeeded", 1), "b": ("running", 1)}
    more = [*first, ("b", 4, "start"), ("b", 5, "succeed"), ("c", 6, "start"), ("c", 7, "succeed")]
    assert states(more) == {"a": ("succeeded", 1), "b": ("succeeded", 2), "c": ("succeeded", 1)}
    jobs = journal.fold(log(more))
    assert journal.todo(jobs).count() == 0 and journal.enqueue(jobs, jobs.select("key")).count() == 3
    assert [r.result for r in journal.fold(log([("a", 1, "succeed"), ("a", 2, "succeed")])).collect()] == ["r1"]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "t")
    assert tables.write_once(df, path) and not tables.write_once(df, path)
    with pytest.raises(ValueError):
        tables.write_once(spark.range(6), path)
    with pytest.raises(ValueError):
        tables.write_all_or_nothing(df.withColumn("error", F.when(F.col("id") == 3, "bad")), str(tmp_path / "u"), str(tmp_path / "e"))
    assert not (tmp_path / "u").exists() and spark.read.parquet(str(tmp_path / "e")).count() == 1
    tables.write_json({"a": 1.5}, str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        tables.write_json({"a": math.nan}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 1.5\n}'
    (tmp_path / "index.json").write_text('{"samples": [{"filepath": "p", "detections": {"detections": [{"label": "car", "bounding_box": [0.1, 0.1, 0.2, 0.2]}]}}]}')
    got = tables.annotations(spark, str(tmp_path / "index.json")).first()
    assert got.filepath == "p" and got.detections.detections[0].label == "car" and got.weather is None


def test_tables_that_belong_together(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert tables.write_all_once({a: spark.range(3), b: spark.range(4)}) == {a: True, b: True}
    assert tables.write_all_once({a: spark.range(3), b: spark.range(4)}) == {a: False, b: False}
    c = str(tmp_path / "c")
    with pytest.raises(ValueError):
        tables.write_all_once({c: spark.range(1), b: spark.range(5)})
    assert not tables.exists(spark, c)
    tables.refuse_frozen(spark, str(tmp_path), "release.json")
    (tmp_path / "release.json").write_text("{}")
    with pytest.raises(ValueError):
        tables.refuse_frozen(spark, str(tmp_path), "release.json")


def test_run_contracts(spark):
    rows = spark.createDataFrame([(1, "train", "seed"), (2, "train", "val"), (3, "control", "pool"), (4, None, "seed")], "k long, role string, split string")
    bad = contracts.roles(rows, "k", "role", "split", {"train": ["seed", "pool"], "control": ["seed"]})
    assert sorted(r.key for r in bad.collect()) == ["2", "3", "4"]
    assert contracts.roles(rows, "k", "role", "split", {}).count() == 4
    assert [r.key for r in contracts.nonempty(rows, "split", ["seed", "test"]).collect()] == ["test"]
    assert contracts.version(rows, "k", "role", "train").count() == 2
    nan = float("nan")
    kinds = spark.createDataFrame([([1.0], 0.0), ([], 0.0), (None, 0.0), ([nan], 0.0), ([None], 0.0), ([1.0], -1.0), ([1.0], nan), ([1.0], None)], "e array<double>, t double")
    errors = [r[0] for r in kinds.select(contracts.prediction_errors(F.col("e"), F.col("t"))).collect()]
    assert errors == [None, *["embedding is empty"] * 2, *["embedding is not finite"] * 2, *["latency is out of range"] * 3]
    steps = spark.createDataFrame([("p", 1, None, "a"), ("p", 2, "a", "b"), ("p", 3, "x", "c"), ("q", 1, "z", "a")], "path string, n int, was string, now string")
    assert sorted((r.key, r.detail) for r in contracts.chain(steps, "path", "n", "was", "now").collect()) == [("p", "3"), ("q", "1")]
    was = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None), ("e", None)], "m string, v double")
    now = spark.createDataFrame([("a", 1.05), ("b", 1.2), ("d", None), ("e", 1.0), ("f", 1.0)], "m string, v double")
    got = {(r.key, r.detail) for r in contracts.replay(was, now, "m", "v", 0.1).collect()}
    assert got == {("b", "differs"), ("c", "not recomputed"), ("e", "differs"), ("f", "not recorded")}
    for n in (19, 41, True, 20.0):
        with pytest.raises(contracts.ContractError):
            contracts.limit(n, 40)
    contracts.limit(20, 40)


def test_stream(spark, sf, tmp_path):
    from gleaner.streaming import journal as streams

    folder = str(tmp_path / "in")
    tables.table(spark, sf, "events").repartition(3).write.parquet(folder)
    counts = streams.windowed_counts(streams.event_stream(spark, folder), late="10000 days")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    streams.write_batches(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    events = streams.event_stream(spark, folder)
    assert events.isStreaming
    streams.write_batches(events.select("event_id"), str(tmp_path / "all"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == tables.table(spark, sf, "events").count()
