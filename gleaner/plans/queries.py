"""The registered queries: each with the SQL that it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import coco, contracts, diagnosis, digests, evaluation, inference, journal, labels, matching, neighbours, provenance, selection, statistics, trie
from ..sources.scratch import shared_dir
from ..sources.tables import table
from ..streaming import journal as streams
from .views import BOXES_SQL, MATCH_SQL, SCORES_SQL, boxes, scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(c, digits: int = 6):
    return F.round(c, digits)


@query("SELECT event_type, user_id % 4 AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL ORDER BY 1, 2")
def catalog_summary(spark, sf):
    """The catalog's group-by: counts and means by two keys."""
    rows = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean_value")).orderBy("event_type", "bucket")


@query("""SELECT split, count(DISTINCT user_id) AS groups, count(*) AS n FROM (SELECT user_id,
  CASE WHEN b < 15 THEN 'seed' WHEN b < 55 THEN 'pool' WHEN b < 75 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT user_id, ('0x' || substr(sha256('split-v1:' || user_id), 1, 8))::BIGINT % 100 AS b FROM events)) GROUP BY split""")
def split_assignment(spark, sf):
    """Splits by a hash of the group, so that no group straddles two."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("c")).withColumn("split", S.split_of(F.col("user_id")))
    return rows.groupBy("split").agg(F.count("*").alias("groups"), F.sum("c").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('subset-v1:' || o_orderkey) LIMIT 100")
def hash_sample(spark, sf):
    """The first hundred orders in the order of a hash."""
    return selection.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "subset-v1", 100)


@query("SELECT 'unique digest' AS rule, sha256(text) AS key, count(*)::VARCHAR AS detail FROM documents WHERE text IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def duplicate_content(spark, sf):
    """Texts that occur twice, by their digest."""
    rows = table(spark, sf, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return contracts.unique(rows, "digest")


@query("SELECT 'one lang per source' AS rule, source AS key, count(DISTINCT lang)::VARCHAR AS detail FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def group_leakage(spark, sf):
    """Groups that are spread over several values."""
    return contracts.one_value_per_group(table(spark, sf, "documents"), "source", "lang")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 2000")
def pool_projection(spark, sf):
    """A conjunctive filter and the columns of the contract; both reach the scan."""
    return table(spark, sf, "documents").where("lang = 'en' and n_chars between 100 and 2000").select("doc_id", "source", "n_chars")


@query("""SELECT 'missing' AS rule, doc_id::VARCHAR AS key, 'no row' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'unexpected', doc_id::VARCHAR, 'extra row' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def missing_rows(spark, sf):
    """Documents without labels, and labels without documents."""
    return contracts.complete(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT cls, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 END AS cls FROM lineitem) WHERE cls IS NOT NULL GROUP BY cls""")
def label_map(spark, sf):
    """Names mapped to classes; rows of unmapped names go."""
    mapping = F.create_map(F.lit("N"), F.lit(0), F.lit("R"), F.lit(1))
    rows = table(spark, sf, "lineitem").select(F.try_element_at(mapping, F.col("l_returnflag")).alias("cls"))
    return rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(x * 640, 0), 640), 6) AS x1, round(least(greatest(y * 360, 0), 360), 6) AS y1,
  round(least(greatest((x + w) * 640, 0), 640), 6) AS x2, round(least(greatest((y + h) * 360, 0), 360), 6) AS y2
FROM (SELECT l_orderkey, l_linenumber, l_discount - 0.02::DOUBLE AS x, l_tax AS y, l_quantity / 45 AS w, l_linenumber::DOUBLE / 5 AS h FROM lineitem)""")
def box_convert(spark, sf):
    """Relative boxes to pixels, clipped to the image."""
    rows = table(spark, sf, "lineitem")
    box = S.clipped(
        F.col("l_discount") - F.lit(0.02), F.col("l_tax"), F.col("l_quantity") / 45, F.col("l_linenumber").cast("double") / 5, F.lit(640.0), F.lit(360.0)
    )
    return rows.select("l_orderkey", "l_linenumber", *[_r(c).alias(n) for c, n in zip(box, matching.BOX, strict=True)])


@query("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN x2 <= x1 THEN 'box is empty' WHEN l_linenumber - 1 NOT BETWEEN 0 AND 5 THEN 'unknown label'
  WHEN l_discount * 12 > 1 THEN 'score is out of range' END AS error FROM (SELECT *, l_quantity AS x1, l_tax * 600 AS x2 FROM lineitem)) GROUP BY error""")
def object_contract(spark, sf):
    """The first broken rule of each object."""
    error = contracts.box_errors(
        F.col("l_quantity"), F.lit(0.0), F.col("l_tax") * 600, F.lit(1.0), F.col("l_linenumber") - 1, F.col("l_discount") * 12, labels=6
    )
    return table(spark, sf, "lineitem").groupBy(error.alias("error")).agg(F.count("*").alias("n"))


@query(f"WITH {BOXES_SQL} SELECT cls, count(*) AS n, round(avg(iou), 6) AS mean_iou, count(DISTINCT image) AS images FROM pairs GROUP BY cls")
def iou_pairs(spark, sf):
    """Overlapping pairs of gold and predicted boxes."""
    pairs = matching.overlaps(*boxes(spark, sf))
    return pairs.groupBy("cls").agg(F.count("*").alias("n"), _r(F.avg("iou")).alias("mean_iou"), F.count_distinct("image").alias("images"))


_COUNTS = """, base AS (SELECT image, sum(o) AS objects, sum(p) AS n, sum(t) AS tp FROM (
  SELECT image, 1 AS o, 0 AS p, 0 AS t FROM gold UNION ALL SELECT image, 0, 1, 0 FROM pred WHERE score >= {thr}
  UNION ALL SELECT image, 0, 0, 1 FROM matched WHERE score >= {thr}) GROUP BY image),
counts AS (SELECT image, objects::BIGINT AS objects, tp::BIGINT AS tp, (n - tp)::BIGINT AS fp, (objects - tp)::BIGINT AS fn FROM base)"""
_MATCHED = "WITH RECURSIVE " + MATCH_SQL.format(least="0.5") + _COUNTS.format(thr="0.5")


@query(_MATCHED + " SELECT * FROM counts")
def greedy_match(spark, sf):
    """One-to-one matching: true and false positives and misses by image."""
    gold, predictions = boxes(spark, sf)
    return matching.counts(gold, predictions, matching.match(gold, predictions))


@query("WITH RECURSIVE " + MATCH_SQL.format(least="0.05") + """ SELECT image, count(*) FILTER (score >= 0.5) AS tp_high, count(*) AS tp_low,
  coalesce(string_agg((cls * 1000 + j)::VARCHAR, ',' ORDER BY cls * 1000 + j) FILTER (score < 0.5), '') AS recoverable FROM matched GROUP BY image""")
def match_two_thresholds(spark, sf):
    """One matching at the low threshold holds the one at the high; what it adds are recoverable misses."""
    gold, predictions = boxes(spark, sf)
    high = F.col("score") >= 0.5
    return matching.match(gold, predictions, 0.05).groupBy("image").agg(
        F.count(F.when(high, 1)).alias("tp_high"), F.count("*").alias("tp_low"),
        F.array_join(F.array_sort(F.collect_list(F.when(~high, F.col("cls") * 1000 + F.col("j")))).cast("array<string>"), ",").alias("recoverable"),
    )


@query(_MATCHED + """ SELECT tag, count(*) AS images, sum(objects)::BIGINT AS objects, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
  round(sum(tp) / nullif(sum(objects), 0), 6) AS recall, round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS precision
FROM (SELECT *, unnest(['all', 'size:' || (image % 3), 'brand:' || (image % 5)]) AS tag FROM counts) GROUP BY tag""")
def slice_evaluation(spark, sf):
    """Sums and ratios by slice, an image counting for several."""
    gold, predictions = boxes(spark, sf)
    samples = matching.counts(gold, predictions, matching.match(gold, predictions))
    tags = [F.concat(F.lit(f"{name}:"), F.col("image") % n) for name, n in (("size", 3), ("brand", 5))]
    out = matching.sliced(samples, tags)
    return out.withColumns({c: _r(c) for c in ("recall", "precision")})


@query(_MATCHED + """ SELECT tag, count(DISTINCT image) AS images, count(*) AS objects, sum(hit)::BIGINT AS tp, (count(*) - sum(hit))::BIGINT AS fn,
  round(sum(hit) / count(*), 6) AS recall FROM (SELECT g.image, (m.j IS NOT NULL)::INT AS hit,
    unnest(list_filter([CASE WHEN (g.x2 - g.x1) * (g.y2 - g.y1) < 300 THEN 'small' END, CASE WHEN g.cls = 0 THEN 'class:0' END], lambda t: t IS NOT NULL)) AS tag
  FROM gold g LEFT JOIN matched m ON g.image = m.image AND g.cls = m.cls AND g.j = m.j) GROUP BY tag""")
def object_slices(spark, sf):
    """Recall over subsets of gold boxes; they have no false positives."""
    gold, predictions = boxes(spark, sf)
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    tags = [F.when(size < 300, "small"), F.when(F.col("cls") == 0, "class:0")]
    return matching.object_slices(gold, matching.match(gold, predictions), tags).withColumn("recall", _r("recall"))


@query("WITH RECURSIVE " + MATCH_SQL.format(least="0.05") + """, flagged AS (SELECT g.image, g.cls, m.score IS NOT NULL AND m.score >= 0.5 AS hit,
    m.score IS NOT NULL AND m.score < 0.5 AS target FROM gold g LEFT JOIN matched m ON g.image = m.image AND g.cls = m.cls AND g.j = m.j)
SELECT tag, count(*) AS objects, sum(hit::INT)::BIGINT AS tp, round(sum(hit::INT) / count(*), 6) AS recall
FROM (SELECT *, unnest(['all', CASE WHEN target THEN 'target' ELSE 'complement' END]) AS tag FROM flagged) GROUP BY tag""")
def target_complement(spark, sf):
    """Gold boxes that the base matching misses but could recover, and the others."""
    gold, predictions = boxes(spark, sf)
    low = matching.match(gold, predictions, 0.05).select("image", "cls", "j", "score")
    flagged = gold.join(low, ["image", "cls", "j"], "left")
    hit = F.coalesce((F.col("score") >= 0.5).cast("int"), F.lit(0))
    target = F.when(F.col("score") < 0.5, "target").otherwise("complement")
    rows = flagged.select(hit.alias("hit"), F.explode(F.array(F.lit("all"), target)).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("objects"), F.sum("hit").alias("tp"), _r(F.avg("hit")).alias("recall"))


@query("WITH RECURSIVE " + MATCH_SQL.format(least="0.0") + """, n AS (SELECT cls, count(*) AS positives FROM gold GROUP BY cls),
hits AS (SELECT p.cls, p.image, p.j, p.score, (m.p IS NOT NULL)::INT AS hit FROM pred p LEFT JOIN matched m ON p.image = m.image AND p.cls = m.cls AND p.j = m.p),
curve AS (SELECT cls, sum(hit) OVER w / positives AS rc, sum(hit) OVER w / row_number() OVER w AS pr FROM hits JOIN n USING (cls)
  WINDOW w AS (PARTITION BY cls ORDER BY score DESC, image, j ROWS UNBOUNDED PRECEDING)),
level AS (SELECT cls, i, coalesce(max(pr) FILTER (rc >= i * 0.01::DOUBLE), 0) AS best FROM curve, range(0, 101) t(i) GROUP BY cls, i)
SELECT cls, round(sum(best) / 101, 6) AS ap FROM level GROUP BY cls""")
def average_precision(spark, sf):
    """Precision interpolated at 101 levels of recall, by class."""
    gold, predictions = boxes(spark, sf)
    hit = matching.match(gold, predictions, 0.0).select("image", "cls", F.col("p").alias("j"), F.lit(1).alias("hit"))
    positives = gold.groupBy("cls").agg(F.count("*").alias("positives"))
    rows = predictions.join(hit, ["image", "cls", "j"], "left").na.fill(0, ["hit"]).join(positives, "cls")
    return matching.average_precision(rows, ["cls"], [F.asc("image"), F.asc("j")]).withColumn("ap", _r("ap"))


#: The matching of each cell (ten thresholds by range of area) as a recursive query; runs, dets, cells are given before.
_CELLS = """,
thr AS (SELECT unnest(range(0, 10)) AS t, unnest([{thrs}]) AS thr),
cells AS (SELECT a * 10 + t AS cell, a, thr, lo, hi FROM thr, (VALUES {areas}) v(a, lo, hi)),
top AS (SELECT *, row_number() OVER (PARTITION BY run, image, cls ORDER BY score DESC, j) AS rank FROM runs QUALIFY rank <= 100),
cand AS (SELECT *, row_number() OVER (PARTITION BY run, image, cls, cell ORDER BY rank) AS n FROM (SELECT run, image, cls, cell, rank, list(e ORDER BY e % 2, iou DESC, e DESC) AS free
  FROM (SELECT run, t.image, t.cls, cell, rank, iou, g.j * 2 + (NOT (g.x2 - g.x1) * (g.y2 - g.y1) BETWEEN lo AND hi)::INT AS e
    FROM top t JOIN pairs x ON t.image = x.image AND t.cls = x.cls AND t.j = x.p JOIN gold g ON g.image = x.image AND g.cls = x.cls AND g.j = x.j, cells
    WHERE iou >= least(thr, 1 - 1e-10)) GROUP BY ALL)),
walk AS (SELECT run, image, cls, cell, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS rank, NULL::BIGINT AS e FROM (SELECT DISTINCT run, image, cls, cell FROM cand)
  UNION ALL
  SELECT run, image, cls, cell, n, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, rank, f FROM
    (SELECT w.run, w.image, w.cls, w.cell, c.n, w.used, c.rank, list_filter(c.free, lambda x: NOT list_contains(w.used, x))[1] AS f
    FROM walk w JOIN cand c ON w.run = c.run AND w.image = c.image AND w.cls = c.cls AND w.cell = c.cell AND c.n = w.n + 1)),
judged AS (SELECT t.run, t.image, t.cls, t.rank, t.score, c.cell, (e IS NOT NULL)::INT AS hit,
    CASE WHEN e IS NULL THEN NOT (x2 - x1) * (y2 - y1) BETWEEN lo AND hi ELSE e % 2 = 1 END AS skip
  FROM top t CROSS JOIN cells c LEFT JOIN (SELECT * FROM walk WHERE e IS NOT NULL) w ON w.run = t.run AND w.image = t.image AND w.cls = t.cls AND w.rank = t.rank AND w.cell = c.cell),
levels AS (SELECT unnest([{levels}]) AS level)"""
_GRID = {
    "thrs": ", ".join(f"{t!r}::DOUBLE" for t in coco.THRESHOLDS), "areas": ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(coco.AREAS.values())),
    "levels": ", ".join(f"{r!r}::DOUBLE" for r in coco.LEVELS),
}


@query("WITH RECURSIVE " + BOXES_SQL + ", runs AS (SELECT 0 AS run, * FROM pred)" + _CELLS.format(**_GRID) + """,
pos AS (SELECT cls, cell, count(*) AS positives FROM gold, cells WHERE (x2 - x1) * (y2 - y1) BETWEEN lo AND hi GROUP BY ALL),
curve AS (SELECT cls, cell, lim, sum(hit) OVER w / positives AS rc, sum(hit) OVER w / count(*) OVER w AS pr
  FROM judged JOIN pos USING (cls, cell), (SELECT unnest([1, 10, 100]) AS lim) WHERE NOT skip AND rank <= lim
  WINDOW w AS (PARTITION BY cls, cell, lim ORDER BY score DESC, image, rank ROWS UNBOUNDED PRECEDING)),
peak AS (SELECT cls, cell, lim, level, max(pr) AS pr, max(rc) AS rc FROM curve ASOF JOIN levels ON rc >= level GROUP BY ALL),
best AS (SELECT g.cls, g.cell, g.lim, l.level, coalesce(max(p.pr), 0) AS pr, coalesce(max(p.rc), 0) AS rc
  FROM (SELECT cls, cell, unnest([1, 10, 100]) AS lim FROM pos) g CROSS JOIN levels l LEFT JOIN peak p ON p.cls = g.cls AND p.cell = g.cell AND p.lim = g.lim AND p.level >= l.level GROUP BY ALL),
c AS (SELECT cls, cell, cell // 10 AS a, cell % 10 AS t, lim, avg(pr) AS ap, max(rc) AS ar FROM best GROUP BY ALL)
SELECT """ + ", ".join(
    [f'round(avg({v}) FILTER ({w}), 6) AS "{k}"' for k, v, w in (
        ("AP", "ap", "lim = 100 AND a = 0"), ("AP50", "ap", "lim = 100 AND a = 0 AND t = 0"), ("AP75", "ap", "lim = 100 AND a = 0 AND t = 5"),
        *[(f"AP_{n}", "ap", f"lim = 100 AND a = {i}") for i, n in enumerate(coco.AREAS) if i], *[(f"AR{m}", "ar", f"lim = {m} AND a = 0") for m in coco.LIMITS],
        *[(f"AR_{n}", "ar", f"lim = 100 AND a = {i}") for i, n in enumerate(coco.AREAS) if i])]
) + " FROM c")
def coco_summary(spark, sf):
    """The twelve detection metrics."""
    out = coco.summary(*boxes(spark, sf))
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query("WITH RECURSIVE " + BOXES_SQL + """, runs AS (SELECT arm * 2 + seed AS run, pred.* FROM pred, range(0, 2) a(arm), range(0, 2) s(seed) WHERE (image + j + seed) % (3 + arm) <> 0)""" + _CELLS.format(**_GRID | {"areas": _GRID["areas"].split("), ")[0] + ")"}) + """,
steps AS (SELECT k, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS b FROM range(0, 11) t(k)),
drawn AS (SELECT g, replicate, (SELECT count(*) FROM steps WHERE u > b) AS w FROM (SELECT g, replicate,
  (('0x' || substr(sha256('ap:' || replicate || ':' || g), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u FROM (SELECT DISTINCT p_partkey // 20 AS g FROM part), range(1, 21) t(replicate))),
pos AS (SELECT cls, replicate, sum(w) AS positives FROM gold JOIN drawn ON g = image // 20 GROUP BY ALL HAVING sum(w) > 0),
curve AS (SELECT run, cls, cell, replicate, sum(w * hit) OVER o / positives AS rc, sum(w * hit) OVER o / sum(w) OVER o AS pr
  FROM judged JOIN (SELECT * FROM drawn WHERE w > 0) ON g = image // 20 JOIN pos USING (cls, replicate) WHERE NOT skip
  WINDOW o AS (PARTITION BY run, cls, cell, replicate ORDER BY score DESC, image, rank ROWS UNBOUNDED PRECEDING)),
peak AS (SELECT run, cls, cell, replicate, level, max(pr) AS pr FROM curve ASOF JOIN levels ON rc >= level GROUP BY ALL),
down AS (SELECT run, replicate, max(pr) OVER w * round(100 * (level - coalesce(lead(level) OVER w, -0.01))) AS area FROM peak WINDOW w AS (PARTITION BY run, cls, cell, replicate ORDER BY level DESC)),
aps AS (SELECT run, replicate, sum(area) / 101 / any_value(n) AS ap FROM down JOIN (SELECT replicate, count(*) * 10 AS n FROM pos GROUP BY 1) USING (replicate) GROUP BY run, replicate),
deltas AS (SELECT replicate, avg(d) AS d FROM (SELECT replicate, run % 2 AS seed, sum(CASE WHEN run < 2 THEN ap ELSE -ap END) AS d FROM aps GROUP BY ALL) GROUP BY 1)
SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025::DOUBLE), 6) AS lo, round(quantile_cont(d, 0.975::DOUBLE), 6) AS hi, count(*) AS replicates FROM deltas""")  # fmt: skip
def bootstrap_ap(spark, sf):
    """The interval of the difference in average precision of two arms of two seeds, over twenty draws of groups of images
    that all runs share."""
    gold, predictions = boxes(spark, sf)
    grid = [F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed")) for a in range(2) for s in range(2)]
    runs = predictions.withColumn("run", F.explode(F.array(*grid))).select("*", "run.*").drop("run")
    runs = runs.where((F.col("image") + F.col("j") + F.col("seed")) % (3 + F.col("arm")) != 0)
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.floor(F.col("p_partkey") / 20).alias("group"))
    out = coco.paired_bootstrap(gold, runs, images, "arm", "seed", (0, 1), 20, "ap")
    return out.select(*[_r(c).alias(c) for c in ("mean", "lo", "hi")], "replicates")


_ENTROPY = "-(s * ln(greatest(s, 1e-12)) + (1 - s) * ln(greatest(1 - s, 1e-12))) / ln(2)"


@query(f"""WITH {SCORES_SQL}, best AS (SELECT sample, score AS s, row_number() OVER (PARTITION BY sample ORDER BY score DESC) AS r FROM scores)
SELECT c_custkey AS sample, round(coalesce(avg({_ENTROPY}), 1), 6) AS uncertainty FROM customer LEFT JOIN (SELECT * FROM best WHERE r <= 20) ON sample = c_custkey GROUP BY 1""")
def score_entropy(spark, sf):
    """The mean entropy of the twenty best scores; 1 without any."""
    samples = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample"))
    return selection.uncertainty(scores(spark, sf), samples, "sample").withColumn("uncertainty", _r("uncertainty"))


@query(f"""WITH {SCORES_SQL} SELECT sample, round(coalesce(sum(score * (1 - score)) FILTER (score >= 0.05 AND score < 0.5), 0), 6) AS mass,
  count(*) FILTER (score >= 0.05 AND score < 0.5) AS low_count FROM scores GROUP BY sample""")
def low_confidence_mass(spark, sf):
    """The mass of scores that are neither sure nor negligible."""
    return selection.low_confidence_mass(scores(spark, sf), "sample").withColumn("mass", _r("mass"))


_UNIT = """e AS (SELECT vec_id, label, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS u, x
  FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings))"""
_SIMILAR = f"""{_UNIT}, c AS (SELECT i, avg(x) AS m FROM e WHERE vec_id % 7 = 0 GROUP BY i),
p AS (SELECT i, m / greatest(sqrt(sum(m * m) OVER ()), 1e-12) AS p FROM c),
sim AS (SELECT vec_id, any_value(label) AS label, greatest(0, sum(u * p)) AS similarity FROM e JOIN p USING (i) GROUP BY vec_id)"""


def _similar(spark, sf):
    rows = table(spark, sf, "embeddings")
    return selection.similarity(rows, selection.centroid(rows.where("vec_id % 7 = 0"), "embedding"), "embedding")


@query(f"WITH {_SIMILAR} SELECT vec_id, round(similarity, 6) AS similarity FROM sim")
def prototype_similarity(spark, sf):
    """Cosines with the centroid of some of the vectors."""
    return _similar(spark, sf).select("vec_id", _r("similarity").alias("similarity"))


_RANKED = f"""{_SIMILAR}, {SCORES_SQL}, mass AS (SELECT sample, sum(score * (1 - score)) FILTER (score >= 0.05 AND score < 0.5) AS mass FROM scores GROUP BY sample),
full_ AS (SELECT vec_id, label, similarity, coalesce(mass, 0) AS mass, round(similarity * ln(1 + coalesce(mass, 0)), 9) AS score FROM sim LEFT JOIN mass ON sample = vec_id)"""


def _ranked(spark, sf):
    mass = selection.low_confidence_mass(scores(spark, sf), "sample").select(F.col("sample").alias("vec_id"), "mass")
    rows = _similar(spark, sf).select("vec_id", "label", "similarity").join(mass, "vec_id", "left").na.fill(0.0, ["mass"])
    return rows.withColumn("score", F.round(F.col("similarity") * F.log1p("mass"), 9))


@query(f"WITH {_RANKED} SELECT vec_id, round(score, 6) AS score FROM full_ ORDER BY full_.score DESC, vec_id LIMIT 36")
def rank_pool(spark, sf):
    """The 36 best samples by similarity and mass."""
    return _ranked(spark, sf).orderBy(F.desc("score"), "vec_id").limit(36).select("vec_id", _r("score").alias("score"))


@query("""SELECT label, vec_id FROM (SELECT label, vec_id, h, row_number() OVER (PARTITION BY label ORDER BY h) AS r
  FROM (SELECT label, vec_id, sha256('one:' || vec_id) AS h FROM embeddings)) WHERE r = 1 ORDER BY h LIMIT 8""")
def one_per_group(spark, sf):
    """One sample of each group in shuffled order, eight in all."""
    rows = table(spark, sf, "embeddings").select("label", "vec_id")
    return selection.one_per_group(rows, "label", [selection.hash_order(F.col("vec_id"), "one")], 8)


@query(f"""WITH RECURSIVE {_UNIT}, v AS (SELECT vec_id, any_value(label) AS label, (vec_id % 11)::DOUBLE / 11 AS f, list(u ORDER BY i) AS u FROM e GROUP BY vec_id),
pick AS (SELECT 1 AS rank, vec_id, [label] AS used, [vec_id] AS ids, round(f, 12) AS score FROM (SELECT * FROM v ORDER BY round(f, 12) DESC, vec_id LIMIT 1)
  UNION ALL SELECT rank, vec_id, used, ids, score FROM (SELECT p.rank + 1 AS rank, v.vec_id, list_append(p.used, v.label) AS used, list_append(p.ids, v.vec_id) AS ids,
      round(0.5 * v.f + 0.5 * (SELECT min((1 - list_dot_product(v.u, o.u)) / 2) FROM v o WHERE list_contains(p.ids, o.vec_id)), 12) AS score
    FROM pick p, v WHERE p.rank < 5 AND NOT list_contains(p.used, v.label) ORDER BY score DESC, v.vec_id LIMIT 1))
SELECT rank, vec_id, round(score, 6) AS score FROM pick""")
def diverse_selection(spark, sf):
    """Five samples of different groups, uncertain and far from each other."""
    rows = table(spark, sf, "embeddings").withColumn("factor", (F.col("vec_id") % 11).cast("double") / 11)
    return selection.diverse(rows, 5, "vec_id", "label", "factor", "embedding").withColumn("score", _r("score"))


_SPLIT = "CASE WHEN b < 15 THEN 'seed' WHEN b < 55 THEN 'pool' WHEN b < 75 THEN 'dev' ELSE 'test' END"


@query(f"""WITH s AS (SELECT k, {_SPLIT} AS split FROM (SELECT c_custkey AS k, ('0x' || substr(sha256('split-v1:' || c_custkey), 1, 8))::BIGINT % 100 AS b FROM customer)),
base AS (SELECT k FROM s WHERE split = 'seed'), extra AS (SELECT k FROM s WHERE split = 'dev'),
m AS (SELECT (SELECT count(*) * 56 // 44 - count(*) FROM base) AS missing, (SELECT count(*) FROM extra) AS n),
fill AS (SELECT k FROM (SELECT k, r FROM extra, (SELECT unnest(range(0, (missing + n - 1) // n)) AS r FROM m)) ORDER BY sha256('slots:' || k || ':' || r) LIMIT (SELECT missing FROM m)),
rows AS (SELECT k, row_number() OVER (PARTITION BY k) AS c FROM (SELECT k FROM base UNION ALL SELECT k FROM fill))
SELECT epoch::INT AS epoch, k, row_number() OVER (PARTITION BY epoch ORDER BY sha256('slots:' || epoch || ':' || k || ':' || c))::INT AS slot FROM rows, range(1, 3) t(epoch)""")
def schedule_slots(spark, sf):
    """Two epochs: the seed split, and rows of another split repeated to fill up 56 slots for each 44 rows."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    split = S.split_of(F.col("k"))
    base = keys.where(split == "seed")
    return selection.slots(base, keys.where(split == "dev"), "k", 2, base.count() * 56 // 44, "slots")


_LG = f"""WITH {_UNIT}, t AS (SELECT i, sum(x) AS s, count(*) AS n FROM e WHERE vec_id % 7 = 0 GROUP BY i),
o AS (SELECT label, i, sum(x) FILTER (vec_id % 7 = 0) AS s, count(*) FILTER (vec_id % 7 = 0) AS n FROM e GROUP BY label, i),
m AS (SELECT label, i, (t.s - coalesce(o.s, 0)) / (t.n - o.n) AS m FROM o JOIN t USING (i)),
p AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS p FROM m)
SELECT vec_id, round(greatest(0, sum(u * p)), 6) AS similarity FROM e JOIN p USING (label, i) GROUP BY vec_id"""


@query(_LG)
def leave_group_out(spark, sf):
    """Cosines with the prototype of the failures of all other groups."""
    rows = table(spark, sf, "embeddings").withColumn("failed", F.col("vec_id") % 7 == 0)
    own = selection.leave_group_out(rows, "embedding", "label", "failed")
    similar = F.greatest(F.lit(0.0), S.dot(S.unit(F.col("embedding")), F.col("prototype")))
    return rows.join(own, "label").select("vec_id", _r(similar).alias("similarity"))


@query(f"""WITH {_RANKED}, long AS (UNPIVOT (SELECT vec_id, score AS full_score, mass, similarity FROM full_) ON full_score, mass, similarity INTO NAME component VALUE v)
SELECT component, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(stddev_pop(v), 6) AS spread FROM long GROUP BY component""")
def component_stats(spark, sf):
    """Least, greatest and spread of the parts of a score."""
    rows = _ranked(spark, sf).select("vec_id", F.col("score").alias("full_score"), "mass", "similarity")
    long = rows.unpivot("vec_id", ["full_score", "mass", "similarity"], "component", "v")
    return long.groupBy("component").agg(_r(F.min("v")).alias("lowest"), _r(F.max("v")).alias("highest"), _r(F.stddev_pop("v")).alias("spread"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a,
  rank() OVER (ORDER BY quality * 2 + toxic) + (count(*) OVER (PARTITION BY quality * 2 + toxic) - 1) / 2 AS b FROM documents JOIN labels USING (doc_id))
SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r""")
def spearman(spark, sf):
    """Rank correlation with shared ranks."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("n_chars", (F.col("quality") * 2 + F.col("toxic")).alias("grade"))
    return statistics.spearman(rows, "n_chars", "grade").withColumn("spearman", _r("spearman"))


@query("""WITH r AS (SELECT quality = 1 AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc,
  count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM r""")
def auc(spark, sf):
    """The area under the curve, by ranks."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select((F.col("quality") == 1).alias("y"), "n_chars")
    return statistics.auc(rows, "y", "n_chars").withColumn("auc", _r("auc"))


@query("""SELECT count(*) AS shared FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 36)
  JOIN (SELECT doc_id FROM documents ORDER BY length(text) - doc_id % 50 DESC, doc_id LIMIT 36) USING (doc_id)""")
def top_overlap(spark, sf):
    """How many of the best 36 by two orders are the same."""
    rows = table(spark, sf, "documents").withColumn("other", F.char_length("text") - F.col("doc_id") % 50)
    return statistics.top_overlap(rows, "doc_id", "n_chars", "other", 36)


@query("""WITH r AS (SELECT o_orderpriority AS arm, o_custkey % 9 AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
c AS (SELECT seed, v AS c FROM r WHERE arm = '5-LOW')
SELECT arm, count(*) AS runs, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(avg(v - c), 4) AS delta FROM r LEFT JOIN c USING (seed) GROUP BY arm""")
def paired_delta(spark, sf):
    """Arms against the control of the same seed."""
    runs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 9).alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    out = statistics.paired(runs, "arm", "5-LOW", "seed", "v")
    return out.withColumns({c: _r(c, 4) for c in ("mean", "sd", "delta")})


@query("""SELECT event_type, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95,
  round(quantile_cont(value, 0.025::DOUBLE), 6) AS lo, round(quantile_cont(value, 0.975::DOUBLE), 6) AS hi FROM events GROUP BY event_type""")
def quantiles(spark, sf):
    """Exact quantiles with linear interpolation."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.5, 0.95, 0.025, 0.975)]))
    rows = table(spark, sf, "events").groupBy("event_type").agg(q.alias("q"))
    return rows.select("event_type", *[_r(F.col("q")[i]).alias(n) for i, n in enumerate(("p50", "p95", "lo", "hi"))])


@query("""WITH g AS (SELECT o_custkey AS g, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1),
u AS (SELECT replicate, s, n, (('0x' || substr(sha256('boot:' || replicate || ':' || g), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u FROM g, range(1, 51) t(replicate)),
b AS (SELECT k, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS b FROM range(0, 11) t(k)),
m AS (SELECT replicate, s, n, (SELECT count(*) FROM b WHERE u > b) AS m FROM u)
SELECT replicate::INT AS replicate, round(sum(m * s) / sum(m * n), 4) AS mean FROM m GROUP BY replicate""")
def group_bootstrap(spark, sf):
    """Means over fifty resamples of customers."""
    return statistics.group_bootstrap(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 50, "boot").withColumn("mean", _r("mean", 4))


@query("""WITH r AS (SELECT o_custkey % 20 AS run, avg(o_totalprice) / 3e5 AS ap, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 3e5 AS night,
    count(DISTINCT o_custkey) AS night_images, count(*) FILTER (o_orderstatus = 'F') AS night_objects FROM orders GROUP BY 1),
d AS (SELECT r.run, r.ap - b.ap AS a, r.night - b.night AS n, r.night_images >= 5 AND r.night_objects >= 40 AS s FROM r, (SELECT ap, night FROM r WHERE run = 0) b)
SELECT run, round(a, 6) AS ap_delta, CASE WHEN s THEN round(n, 6) END AS night_delta,
  concat_ws(', ', CASE WHEN a < -0.01 THEN 'AP regression' END, CASE WHEN s AND n < -0.05 THEN 'night recall regression' END) AS reasons,
  CASE WHEN a IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN a < -0.01 OR (s AND n < -0.05) THEN 'REJECT' WHEN NOT s THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS decision FROM d""")
def regression_gate(spark, sf):
    """Runs judged against a base run, with reasons."""
    done = F.col("o_orderstatus") == "F"
    runs = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("run")).agg(
        (F.avg("o_totalprice") / 3e5).alias("ap"), (F.avg(F.when(done, F.col("o_totalprice"))) / 3e5).alias("night"),
        F.count_distinct("o_custkey").alias("night_images"), F.count(F.when(done, 1)).alias("night_objects"),
    )
    base = runs.where("run = 0").select(F.col("ap").alias("baseline_ap"), F.col("night").alias("baseline_night"))
    judged = statistics.gate(runs.join(F.broadcast(base)), images=5, objects=40)
    return judged.select("run", _r("ap_delta").alias("ap_delta"), _r("night_delta").alias("night_delta"), F.array_join("reasons", ", ").alias("reasons"), "decision")


@query("""WITH r AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN n_chars > 20000 THEN NULL WHEN n_chars > 300 THEN 'good' ELSE 'bad' END AS answer
  FROM documents JOIN labels USING (doc_id)),
e AS (SELECT label, count(*) AS n, count(*) FILTER (answer = label) AS correct, count(*) FILTER (answer IS NULL) AS invalid, count(*) FILTER (answer = label) / count(*) AS recall FROM r GROUP BY label)
SELECT label, n, correct, invalid, round(recall, 6) AS recall, round((SELECT sum(correct) / sum(n) FROM e), 6) AS accuracy, round((SELECT avg(recall) FROM e), 6) AS balanced_accuracy FROM e""")
def classifier_summary(spark, sf):
    """Accuracy and recall of a rule's answers; some are invalid."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    answer = F.when(F.col("n_chars") <= 20000, F.when(F.col("n_chars") > 300, "good").otherwise("bad"))
    rows = rows.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), answer.alias("answer"))
    out = statistics.classifier_summary(rows, "truth", "answer")
    return out.withColumns({c: _r(c) for c in ("recall", "accuracy", "balanced_accuracy")})


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_concat([embedding[2], embedding[1]], embedding[3:])::DOUBLE[] FROM embeddings),
h AS (SELECT vec_id, e, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda i: (e[i] > e[i + 1])::BIGINT)), lambda a, b: a * 2 + b) AS h FROM v)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 8
WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i]))) / len(a.e) < 0.005""")
def near_duplicate_pairs(spark, sf):
    """Vectors whose difference hashes of all neighbouring dimensions are near and whose values are, on average; among the
    vectors and their copies with the first two values changed over."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    turned = F.concat(F.array(F.get("e", F.lit(1)), F.get("e", F.lit(0))), F.slice("e", F.lit(3), F.size("e") - 2))
    return neighbours.alike(rows.union(rows.select(F.col("vec_id") + 1_000_000_000, turned)), "vec_id", "e", 63, 8, 0.005)


_LOG = """log AS (SELECT user_id AS key, event_id AS seq, ['enqueue', 'start', 'succeed', 'fail'][1 + event_id % 4] AS event, 'r' || event_id AS result, 'e' || event_id AS error FROM events)"""
_FOLD = f"""{_LOG}, last AS (SELECT key, count(*) FILTER (event = 'start') AS attempts, arg_min(result, seq) FILTER (event = 'succeed') AS result, arg_max(event, seq) AS event, arg_max(error, seq) AS e FROM log GROUP BY key),
jobs AS (SELECT key, CASE WHEN result IS NOT NULL THEN 'succeeded' WHEN event = 'start' THEN 'running' WHEN event = 'fail' THEN 'failed' ELSE 'pending' END AS status, attempts, result,
  CASE WHEN result IS NULL AND event = 'fail' THEN e END AS error FROM last)"""


def _log(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("enqueue", "start", "succeed", "fail")])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kinds[(F.col("event_id") % 4).cast("int")].alias("event"),
        F.concat(F.lit("r"), F.col("event_id")).alias("result"), F.concat(F.lit("e"), F.col("event_id")).alias("error"),
    )


def _jobs(spark, sf):
    return journal.fold(_log(spark, sf))


@query(f"WITH {_FOLD} SELECT * FROM jobs")
def journal_fold(spark, sf):
    """The states of jobs from their events."""
    return _jobs(spark, sf)


@query(f"WITH {_FOLD} SELECT key::BIGINT AS key, status, attempts, result, error FROM jobs")
def job_stream(spark, sf):
    """The same states, kept by a stream: the events come in three parts, and the stream is started anew for each."""
    folder = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    log = _log(spark, sf).withColumns({"key": F.col("key").cast("string"), "ts": F.timestamp_seconds("seq")})
    for part in range(3):
        log.where(F.col("seq") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
        streams.write_batches(streams.job_states(stream, "10000 days", "10000 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return streams.latest_states(spark, f"{folder}/out").withColumn("key", F.col("key").cast("long"))


@query(f"WITH {_FOLD} SELECT CASE status WHEN 'running' THEN 'pending' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")
def status_counts(spark, sf):
    """Jobs by state after a recovery."""
    return journal.recover(_jobs(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT answer, count(*) AS n FROM (SELECT CASE WHEN w IN ('daytime', 'night') THEN w END AS answer FROM (SELECT trim(lower(trim(CASE turn % 4 WHEN 0 THEN ' Daytime. ' WHEN 1 THEN '"night"' WHEN 2 THEN role ELSE 'not night' END)), '."'' ') AS w FROM conversations)) GROUP BY answer""")
def parse_answers(spark, sf):
    """One-word answers, cleaned and checked."""
    t = F.col("turn") % 4
    text = F.when(t == 0, " Daytime. ").when(t == 1, '"night"').when(t == 2, F.col("role")).otherwise("not night")
    return table(spark, sf, "conversations").groupBy(S.tag(text).alias("answer")).agg(F.count("*").alias("n"))


@query("""WITH plans AS (SELECT doc_id, 'long' AS plan FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 'third' FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, string_agg(plan, ',' ORDER BY plan) AS selected_by, 'unreviewed' AS status FROM plans GROUP BY doc_id""")
def review_queue(spark, sf):
    """Which plans have chosen a sample."""
    docs = table(spark, sf, "documents")
    plans = [("long", "n_chars > 2000"), ("english", "lang = 'en'"), ("third", "doc_id % 3 = 0")]
    chosen = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in plans]))).alias("plan"))
    return chosen.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("plan")), ",").alias("selected_by"), F.lit("unreviewed").alias("status"))


@query("""SELECT doc_id, quality, CASE WHEN n_chars > 20000 THEN NULL ELSE (n_chars > 300)::INT END AS answer FROM documents JOIN labels USING (doc_id)
WHERE CASE WHEN n_chars > 20000 THEN NULL ELSE (n_chars > 300)::INT END IS DISTINCT FROM quality""")
def disagreement(spark, sf):
    """Answers that are invalid or differ from the reference."""
    answer = F.when(F.col("n_chars") <= 20000, (F.col("n_chars") > 300).cast("int"))
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", answer.alias("answer"))
    return rows.where(~F.col("answer").eqNullSafe(F.col("quality")))


_FILES = """SELECT 'doc-' || doc_id AS path, sha256(coalesce(text, '')) AS sha256, doc_id FROM documents"""


@query(f"""WITH f AS ({_FILES}), want AS (SELECT path, sha256 AS w FROM f WHERE doc_id % 10 <> 3), got AS (SELECT path, CASE WHEN doc_id % 10 = 4 THEN sha256(sha256) ELSE sha256 END AS g FROM f WHERE doc_id % 10 <> 5)
SELECT 'artifact' AS rule, path AS key, CASE WHEN g IS NULL THEN 'gone' WHEN w IS NULL THEN 'not listed' ELSE 'changed' END AS detail FROM want FULL JOIN got USING (path) WHERE g IS DISTINCT FROM w""")
def artifact_diff(spark, sf):
    """Files against an allow-list of digests."""
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), (F.col("doc_id") % 10).alias("d")
    )
    changed = F.when(F.col("d") == 4, F.sha2(F.col("sha256").cast("binary"), 256)).otherwise(F.col("sha256"))
    return contracts.allow_list(files.where("d <> 5").withColumn("sha256", changed), files.where("d <> 3"))


@query("""SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM nation WHERE n_nationkey <> 3 EXCEPT ALL SELECT * FROM nation WHERE n_nationkey <> 5)
UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM nation WHERE n_nationkey <> 5 EXCEPT ALL SELECT * FROM nation WHERE n_nationkey <> 3)""")
def immutable_check(spark, sf):
    """What two versions of a table have on their own."""
    a, b = (table(spark, sf, "nation").where(f"n_nationkey <> {k}") for k in (3, 5))
    sides = [x.exceptAll(y).agg(F.lit(n).alias("side"), F.count("*").alias("n")) for n, x, y in (("left", a, b), ("right", b, a))]
    return sides[0].union(sides[1])


@query("""WITH s AS (SELECT row_number() OVER () AS k, s FROM (SELECT DISTINCT string_split(text, ' ') AS s FROM conversations WHERE text IS NOT NULL)),
t AS (SELECT k, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS token FROM s),
c AS (SELECT *, ('0x' || substr(h, 1, 15))::BIGINT AS x, ('0x' || substr(h, 16, 15))::BIGINT AS y FROM (SELECT *, md5(token || ':' || i) AS h FROM t)),
r AS (SELECT *, bit_xor(x) OVER w AS a, bit_xor(y) OVER w AS b FROM c WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT i - 1 AS depth, xor(a, x) AS a, xor(b, y) AS b, token FROM r UNION ALL SELECT i, a, b, NULL FROM r WHERE i = n)
SELECT depth::INT AS depth, a, b, count(*) AS sequences, count(DISTINCT token) AS tokens, bool_or(token IS NULL) AS may_end FROM p GROUP BY ALL""")
def label_trie(spark, sf):
    """Every prefix of token sequences: how many tokens may follow, and whether a sequence ends there."""
    rows = table(spark, sf, "conversations").where("text is not null").select(F.split("text", " ").alias("tokens")).distinct()
    steps = trie.transitions(rows.withColumn("k", F.sha2(F.to_json("tokens").cast("binary"), 256)), "k", "tokens")
    return steps.groupBy("depth", "a", "b").agg(F.sum("n").alias("sequences"), F.count("token").alias("tokens"), F.bool_or(F.col("token").isNull()).alias("may_end"))


@query("""WITH p AS (SELECT DISTINCT conv_id, string_split(text, ' ') AS s FROM conversations WHERE text IS NOT NULL AND turn = 0),
q AS (SELECT conv_id, s, CASE WHEN s = string_split('', ' ') THEN [] ELSE s[1:len(s) // 2] END AS pre FROM p),
n AS (SELECT DISTINCT a.conv_id, coalesce(b.s[len(a.pre) + 1], '<end>') AS token FROM q a JOIN (SELECT DISTINCT s FROM p) b ON b.s[1:len(a.pre)] = a.pre)
SELECT conv_id, count(*) AS choices, string_agg(token, ' ' ORDER BY token) AS allowed FROM n WHERE conv_id % 20 = 0 GROUP BY conv_id""")
def constrained_next(spark, sf):
    """The words that may follow the first half of every twentieth conversation's first turn, among all first turns."""
    turns = table(spark, sf, "conversations").where("text is not null and turn = 0").select("conv_id", F.split("text", " ").alias("tokens"))
    steps = trie.transitions(turns.select("tokens").distinct().withColumn("k", F.sha2(F.to_json("tokens").cast("binary"), 256)), "k", "tokens")
    half = F.when(F.col("tokens") == F.array(F.lit("")), F.array().cast("array<string>")).otherwise(F.slice("tokens", 1, F.floor(F.size("tokens") / 2).cast("int")))
    asked = turns.where("conv_id % 20 = 0").select("conv_id", half.alias("tokens")).distinct()
    then = trie.allowed_next(steps, asked, "conv_id", "tokens").select("conv_id", F.coalesce("token", F.lit("<end>")).alias("token")).distinct()
    return then.groupBy("conv_id").agg(F.count("*").alias("choices"), F.array_join(F.array_sort(F.collect_list("token")), " ").alias("allowed"))


@query("""SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def union_by_name(spark, sf):
    """Rows of two schemas; what one lacks is null."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT a.s AS strategy, b.k AS seed, count(*) FILTER (o_custkey % 4 = b.k) AS n FROM (SELECT unnest(['random', 'diverse']) AS s) a, range(0, 4) b(k), orders GROUP BY ALL""")
def plan_grid(spark, sf):
    """The grid of strategies and seeds, with the orders of each seed."""
    seeds = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("seed")).agg(F.count("*").alias("n"))
    return seeds.select(F.explode(F.array(F.lit("random"), F.lit("diverse"))).alias("strategy"), "seed", "n")


@query("""SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS attempt FROM events WHERE event_id % 4 = 1""")
def attempt_numbers(spark, sf):
    """Starts of jobs, numbered."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 1, "start").alias("event"))
    return journal.attempts_in_order(log).select("key", "seq", "attempt")


@query(_MATCHED + " SELECT image, objects, fn FROM counts ORDER BY fn DESC, image LIMIT 50")
def failure_list(spark, sf):
    """The images with most misses."""
    gold, predictions = boxes(spark, sf)
    rows = matching.counts(gold, predictions, matching.match(gold, predictions))
    return rows.orderBy(F.desc("fn"), "image").limit(50).select("image", "objects", "fn")


@query("""WITH o AS (SELECT o_custkey AS g, o_orderpriority AS a, o_orderkey % 3 AS k, sum(o_totalprice) AS s, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL),
u AS (SELECT replicate, a, k, s, n, (('0x' || substr(sha256('pair:' || replicate || ':' || g), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u FROM o, range(1, 41) t(replicate)),
b AS (SELECT k AS i, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS b FROM range(0, 11) t(k)),
m AS (SELECT replicate, a, k, s, n, (SELECT count(*) FROM b WHERE u > b) AS m FROM u),
d AS (SELECT replicate, k, sum(m * s) FILTER (a = '1-URGENT') / sum(m * n) FILTER (a = '1-URGENT') - sum(m * s) FILTER (a = '5-LOW') / sum(m * n) FILTER (a = '5-LOW') AS delta FROM m GROUP BY ALL),
r AS (SELECT replicate, avg(delta) AS delta FROM d GROUP BY 1)
SELECT round(avg(delta), 4) AS mean, round(quantile_cont(delta, 0.025::DOUBLE), 4) AS lo, round(quantile_cont(delta, 0.975::DOUBLE), 4) AS hi, count(*) AS replicates FROM r""")
def paired_bootstrap(spark, sf):
    """The interval of the difference of two arms, over resamples of customers that both arms and all seeds share."""
    rows = table(spark, sf, "orders").withColumn("seed", F.col("o_orderkey") % 3)
    out = statistics.paired_bootstrap(rows, "o_custkey", "o_orderpriority", ("1-URGENT", "5-LOW"), "seed", "o_totalprice", 40, "pair")
    return out.withColumns({c: _r(c, 4) for c in ("mean", "lo", "hi")})


@query(_MATCHED + """ SELECT count(*) AS images, count(*) FILTER (coalesce(objects, 0) + coalesce(tp + fp, 0) = 0) AS empty_images, sum(coalesce(objects, 0))::BIGINT AS objects,
  sum(coalesce(tp, 0))::BIGINT AS tp, sum(coalesce(fp, 0))::BIGINT AS fp, sum(coalesce(fn, 0))::BIGINT AS fn, round(sum(coalesce(tp, 0)) / greatest(1, sum(coalesce(tp + fp, 0))), 6) AS micro_precision
FROM part LEFT JOIN counts ON image = p_partkey""")
def manifest_evaluation(spark, sf):
    """Sums over all images of the manifest, those without any box as well; micro precision with a floor of one."""
    gold, predictions = boxes(spark, sf)
    samples = matching.counts(gold, predictions, matching.match(gold, predictions))
    all_ = matching.with_manifest(table(spark, sf, "part").select(F.col("p_partkey").alias("image")), samples)
    empty = F.count(F.when(F.col("objects") + F.col("tp") + F.col("fp") == 0, 1)).alias("empty_images")
    sums = all_.agg(F.count("*").alias("images"), empty, *[F.sum(c).alias(c) for c in ("objects", "tp", "fp", "fn")])
    return sums.withColumn("micro_precision", _r(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))))


@query(f"""WITH {_RANKED}, used AS (SELECT DISTINCT label FROM embeddings WHERE vec_id < 5),
top AS (SELECT * FROM full_ WHERE label NOT IN (SELECT label FROM used) ORDER BY score DESC, vec_id LIMIT 36),
one AS (SELECT *, sha256('target:' || vec_id) AS h, row_number() OVER (PARTITION BY label ORDER BY sha256('target:' || vec_id)) AS r FROM top)
SELECT vec_id, label, round(mass, 6) AS mass FROM one WHERE r = 1 ORDER BY h LIMIT 3""")
def targeted_sample(spark, sf):
    """Three samples of different groups from the 36 best, without the groups of samples that are used."""
    rows = _ranked(spark, sf)
    used = table(spark, sf, "embeddings").where("vec_id < 5")
    return selection.targeted(rows, used, "vec_id", "label", "target", 3).select("vec_id", "label", _r("mass").alias("mass"))


@query("""WITH r AS (SELECT sha256(concat_ws('|', doc_id, coalesce(lang, ''), coalesce(source, ''), sha256(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM b""")
def manifest_digest(spark, sf):
    """One digest of a table in no order: the root of the tree of its rows' digests."""
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    line = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), text)
    rows = table(spark, sf, "documents").select(F.sha2(line.cast("binary"), 256).alias("h"))
    return digests.root(digests.tree(rows))


@query("""SELECT split_part(c_name, '#', 1) AS kind, regexp_full_match(split_part(c_name, '#', 2), '[0-9]*') AS plain, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'unknown') AS segment, count(*) AS n
FROM customer GROUP BY ALL""")
def derived_keys(spark, sf):
    """A key's part before a mark, whether the rest has allowed characters only, and a default for a missing field."""
    rest = F.split_part("c_name", F.lit("#"), F.lit(2)).rlike("^[0-9]*$")
    segment = F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("unknown"))
    return table(spark, sf, "customer").groupBy(F.split_part("c_name", F.lit("#"), F.lit(1)).alias("kind"), rest.alias("plain"), segment.alias("segment")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
SELECT (step // 14)::INT AS epoch, count(*) AS steps, round(avg(value), 6) AS mean_loss, count(*) FILTER (step % 14 = 0) AS reported, round(count(*) / sum(value), 6) AS per_second FROM e GROUP BY 1""")
def epoch_means(spark, sf):
    """Losses by epoch of fourteen steps, the steps that are reported, and the throughput."""
    step = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf, "events").select("value", step.alias("step"))
    return rows.groupBy(F.floor(F.col("step") / 14).cast("int").alias("epoch")).agg(
        F.count("*").alias("steps"), _r(F.avg("value")).alias("mean_loss"), F.count(F.when(F.col("step") % 14 == 0, 1)).alias("reported"),
        _r(F.count("*") / F.sum("value")).alias("per_second"),
    )


@query("""SELECT o_orderpriority || ' in ' || o_orderstatus AS detail, count(*) AS n FROM orders
WHERE NOT coalesce((o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'P')) OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'F'), false) GROUP BY 1""")
def role_contract(spark, sf):
    """Rows whose split their role must not use: training from two, control from one, others from none."""
    allowed = {"1-URGENT": ["F", "P"], "2-HIGH": ["F", "P"], "5-LOW": ["F"]}
    bad = contracts.roles(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "o_orderstatus", allowed)
    return bad.groupBy("detail").agg(F.count("*").alias("n"))


@query("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN e IS NULL OR len(e) = 0 THEN 'embedding is empty' WHEN list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) = false THEN 'embedding is not finite'
  WHEN NOT coalesce(isfinite(t), false) OR t < 0 THEN 'latency is out of range' END AS error
FROM (SELECT CASE WHEN label = 0 THEN [] ELSE embedding END AS e, CASE WHEN label <> 1 THEN embedding[1]::DOUBLE END AS t FROM embeddings)) GROUP BY 1""")
def prediction_contract(spark, sf):
    """The first broken rule of predictions; some are made without a vector or a time."""
    vector = F.when(F.col("label") == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    time = F.when(F.col("label") != 1, F.col("embedding")[0].cast("double"))
    rows = table(spark, sf, "embeddings").select(vector.alias("e"), time.alias("t"))
    return rows.groupBy(contracts.prediction_errors(F.col("e"), F.col("t")).alias("error")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, sha256(event_type || event_id) AS cur FROM events),
s AS (SELECT *, lag(cur) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM e)
SELECT user_id::VARCHAR AS key, count(*) AS broken FROM s WHERE (CASE WHEN event_type = 'error' THEN 'lost' ELSE was END) IS DISTINCT FROM was GROUP BY 1""")
def digest_chain(spark, sf):
    """Steps that do not start from the digest that the step before left; errors lose theirs."""
    digest = F.sha2(F.concat("event_type", F.col("event_id").cast("string")).cast("binary"), 256)
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", digest.alias("current"))
    before = F.lag("current").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("previous", F.when(F.col("event_type") == "error", "lost").otherwise(before))
    return contracts.chain(rows, "user_id", "event_id", "previous", "current").groupBy("key").agg(F.count("*").alias("broken"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1),
r AS (SELECT CASE WHEN o_orderkey IS NULL THEN 'not recorded' WHEN l_orderkey IS NULL THEN 'not recomputed' WHEN NOT coalesce(abs(o_totalprice - total) <= 50000, false) THEN 'differs' END AS detail
FROM orders FULL JOIN l ON o_orderkey = l_orderkey) SELECT detail, count(*) AS n FROM r WHERE detail IS NOT NULL GROUP BY 1""")
def metric_replay(spark, sf):
    """Totals that differ by more than a tolerance when they are summed again from their parts."""
    recorded = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key_"), F.col("o_totalprice").alias("total"))
    again = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key_")).agg(F.sum("l_extendedprice").alias("total"))
    return contracts.replay(recorded, again, "key_", "total", 50000.0).groupBy("detail").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, sha256('{"balance":' || c_acctbal || ',"key":' || c_custkey || ',"map":{"a":' || (c_custkey % 5) || ',"b":null},"names":["' || c_name || '","' || c_mktsegment || '"]}') AS digest FROM customer""")
def canonical_digest(spark, sf):
    """Digests of nested values by their canonical JSON: keys sorted, no blanks, numbers in their shortest form."""
    nested = F.struct(
        F.array("c_name", "c_mktsegment").alias("names"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("balance"),
        F.create_map(F.lit("b"), F.lit(None).cast("long"), F.lit("a"), F.col("c_custkey") % 5).alias("map"),
    )
    return table(spark, sf, "customer").select("c_custkey", digests.digest(nested).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN 'gone' ELSE 'changed' END AS detail FROM documents WHERE doc_id % 101 = 0 OR (doc_id % 97 = 0 AND text IS DISTINCT FROM text || '.')
UNION ALL SELECT doc_id + 1000000000, 'new' FROM documents WHERE doc_id % 89 = 0""")
def digest_changes(spark, sf):
    """Documents that were taken out, changed or added since their digests were recorded; found by the trees of digests."""
    rows = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    added = rows.where("doc_id % 89 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    now = rows.where("doc_id % 101 <> 0").withColumn("text", text).union(added)
    side = lambda df: df.select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.coalesce("text", F.lit("null"))).cast("binary"), 256).alias("h"))
    return digests.changes(side(rows), side(now), "doc_id")


@query("""SELECT unnest(['other partitions', 'one value', 'one row twice']) AS run, unnest([true, false, false]) AS same, count(*) AS n FROM orders""")
def engine_parity(spark, sf):
    """Whether two runs gave the same rows: the same in other partitions, with one value changed, with a row twice."""
    rows = table(spark, sf, "orders")
    first = rows.agg(F.min("o_orderkey")).first()[0]
    bent = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") == first, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    runs = {"other partitions": rows.repartition(7, "o_custkey").sortWithinPartitions("o_comment" if "o_comment" in rows.columns else "o_orderdate"), "one value": bent, "one row twice": rows.union(rows.where(F.col("o_orderkey") == first))}
    told = spark.createDataFrame([(name, digests.parity(rows, df)) for name, df in runs.items()], "run string, same boolean")
    return told.join(F.broadcast(rows.agg(F.count("*").alias("n"))))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_nationkey IN (3, 7) AS bad, c_custkey % 50 = 0 AS own FROM customer),
o AS (SELECT o_orderkey, bad OR own AS below, own, o_orderkey % 1000 = 1 AS other FROM orders JOIN c ON o_custkey = c_custkey),
t AS (SELECT 'changed' AS reason, 0 AS distance FROM nation WHERE n_nationkey IN (3, 7) UNION ALL
  SELECT CASE WHEN own THEN 'changed' ELSE 'made from it' END, CASE WHEN own THEN 0 ELSE 1 END FROM c WHERE own OR bad UNION ALL
  SELECT CASE WHEN other THEN 'made from another version' ELSE 'made from it' END, CASE WHEN own OR other THEN 1 ELSE 2 END FROM o WHERE below OR other)
SELECT reason, distance, count(*) AS n FROM t GROUP BY ALL""")
def provenance_drift(spark, sf):
    """Orders made from customers made from nations: what is out of date when two nations and some customers change, and
    some orders were made from another version of their customer."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nations = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("artifact"), (F.col("n_nationkey").isin(3, 7)).alias("bent"))
    customers = table(spark, sf, "customer").select(name("c", "c_custkey").alias("artifact"), name("n", "c_nationkey").alias("input"), (F.col("c_custkey") % 50 == 0).alias("bent"))
    orders = table(spark, sf, "orders").select(name("o", "o_orderkey").alias("artifact"), name("c", "o_custkey").alias("input"), F.lit(False).alias("bent"), (F.col("o_orderkey") % 1000 == 1).alias("other"))
    everything = nations.union(customers.select("artifact", "bent")).union(orders.select("artifact", "bent"))
    recorded = everything.select("artifact", F.sha2(F.col("artifact").cast("binary"), 256).alias("digest"))
    current = everything.select("artifact", F.sha2(F.concat("artifact", F.when(F.col("bent"), "!").otherwise("")).cast("binary"), 256).alias("digest"))
    seen = F.when(F.col("other"), F.lit("another")).cast("string")
    edges = customers.select("artifact", "input", F.lit(None).cast("string").alias("input_digest")).union(orders.select("artifact", "input", seen))
    return provenance.stale(edges, recorded, current).groupBy("reason", "distance").agg(F.count("*").alias("n"))


_THUMBS = """v AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_concat([embedding[2], embedding[1]], embedding[3:])::DOUBLE[] FROM embeddings
  UNION ALL SELECT vec_id + 2000000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 3 = 0),
b AS (SELECT k, e, list_transform(range(0, 56), lambda i: (e[i + i // 7 + 2] > e[i + i // 7 + 1])::INT) AS h, list_filter(e, lambda x, i: i % 8 <> 0) AS l FROM v),
near AS (SELECT a.k AS a, b.k AS b FROM b a JOIN b ON a.k <> b.k AND list_sum(list_transform(range(1, 57), lambda i: (a.h[i] <> b.h[i])::INT)) <= 6
  WHERE a.e = b.e OR list_sum(list_transform(range(1, 57), lambda i: abs(a.l[i] - b.l[i]))) / 56 < 0.005)"""


def _thumbs(spark, sf):
    """Vectors as thumbnails of 8 rows of 8, their copies with two values changed over, and exact copies of a third."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("e"))
    turned = F.concat(F.array(F.get("e", F.lit(1)), F.get("e", F.lit(0))), F.slice("e", F.lit(3), F.size("e") - 2))
    return rows.union(rows.select(F.col("k") + 1_000_000_000, turned)).union(rows.where("k % 3 = 0").select(F.col("k") + 2_000_000_000, "e"))


@query(f"""WITH {_THUMBS}, m AS (SELECT k, min(k) OVER (PARTITION BY e) AS class FROM b),
l AS (SELECT DISTINCT x.class AS a, y.class AS b FROM near JOIN m x ON x.k = near.a JOIN m y ON y.k = near.b WHERE x.class <> y.class)
SELECT k, class, (SELECT count(*) FROM l WHERE l.a = m.class) AS links FROM m""")
def thumbnail_classes(spark, sf):
    """Equal thumbnails by class, and the number of other classes that each class is near, by hash and by values."""
    members, links = neighbours.thumbnail_links(_thumbs(spark, sf), "k", "e", 8, 8, 6, 0.005)
    n = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count("*").alias("links"))
    return members.join(n, "class", "left").na.fill(0, ["links"])


@query(f"""WITH RECURSIVE {_THUMBS}, o AS (SELECT k, row_number() OVER (ORDER BY h, k) AS n FROM (SELECT k, ('0x' || substr(sha256('fresh:' || k), 1, 13))::BIGINT AS h FROM v)),
f AS (SELECT o.n, o.k, list(p.n) FILTER (p.n IS NOT NULL) AS near FROM o LEFT JOIN near ON near.a = o.k LEFT JOIN o p ON p.k = near.b AND p.n < o.n GROUP BY ALL),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS got UNION ALL
  SELECT f.n, CASE WHEN list_has_any(coalesce(f.near, []), got) THEN got ELSE list_append(got, f.n) END FROM walk JOIN f ON f.n = walk.n + 1 WHERE len(got) < 150),
last AS (SELECT got FROM walk ORDER BY n DESC LIMIT 1)
SELECT k, true AS accepted, NULL::BIGINT AS neighbour FROM f WHERE list_contains((SELECT got FROM last), n)
UNION ALL SELECT f.k, false, o.k FROM f, (SELECT k, n FROM o WHERE list_contains((SELECT got FROM last), n)) o
WHERE f.n < (SELECT max(n) FROM walk) AND NOT list_contains((SELECT got FROM last), f.n) AND list_contains(f.near, o.n)""")
def fresh_sample(spark, sf):
    """The first 150 thumbnails in hash order that are near none before them, and those turned down, with the neighbours
    that they were turned down for."""
    rows = _thumbs(spark, sf).withColumn("h", F.conv(F.substring(S.digest(F.lit("fresh"), F.col("k")), 1, 13), 16, 10).cast("double"))
    near = lambda df: neighbours.thumbnail_links(df, "k", "e", 8, 8, 6, 0.005)
    kept, turned = neighbours.accept_until(rows, "k", "h", near, 150)
    return kept.select("k", F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("neighbour")).union(turned.select("k", F.lit(False), "neighbour"))


@query(f"""WITH RECURSIVE {_UNIT}, v AS (SELECT vec_id, any_value(vec_id % 250) AS label, (vec_id % 11)::DOUBLE / 11 AS f, list(u ORDER BY i) AS u FROM e GROUP BY vec_id),
pick AS (SELECT 1 AS rank, vec_id, [label] AS used, [vec_id] AS ids, round(f, 12) AS score FROM (SELECT * FROM v ORDER BY round(f, 12) DESC, vec_id LIMIT 1)
  UNION ALL SELECT rank, vec_id, used, ids, score FROM (SELECT p.rank + 1 AS rank, v.vec_id, list_append(p.used, v.label) AS used, list_append(p.ids, v.vec_id) AS ids,
      round(0.5 * v.f + 0.5 * (SELECT min((1 - list_dot_product(v.u, o.u)) / 2) FROM v o WHERE list_contains(p.ids, o.vec_id)), 12) AS score
    FROM pick p, v WHERE p.rank < 60 AND NOT list_contains(p.used, v.label) ORDER BY score DESC, v.vec_id LIMIT 1))
SELECT rank, vec_id, round(score, 6) AS score FROM pick""")
def diverse_budget(spark, sf):
    """Sixty samples of different groups, uncertain and far from each other."""
    rows = table(spark, sf, "embeddings").withColumns({"factor": (F.col("vec_id") % 11).cast("double") / 11, "group": F.col("vec_id") % 250})
    return selection.diverse(rows, 60, "vec_id", "group", "factor", "embedding").withColumn("score", _r("score"))


def _estimate(row: dict) -> dict:
    """Stands in for a model: a score by the row, and errors for some."""
    if row["sample_id"] % 13 == 0:
        raise ArithmeticError("no estimate")
    return {"sample_id": row["sample_id"], "sha256": row["sha256"], "score": row["sample_id"] * 7 % 100 / 100}


@query("""WITH r AS (SELECT p_partkey AS k, (row_number() OVER (ORDER BY p_partkey) - 1) // (SELECT greatest(1, count(*) // 4) FROM part) AS wave FROM part)
SELECT CASE WHEN k % 13 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN k % 13 = 0 THEN CASE wave WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END ELSE CASE wave WHEN 1 THEN 2 ELSE 1 END END::BIGINT AS attempts,
  CASE WHEN k % 13 = 0 THEN 'ArithmeticError' END AS error, count(*) AS n, round(sum(CASE WHEN k % 13 <> 0 THEN k * 7 % 100 / 100 END), 4) AS total FROM r GROUP BY ALL""")
def inference_flow(spark, sf):
    """A function over all parts in waves: the first run stops after it has claimed the second wave, the next one takes that
    up. Rows that fail are tried twice in each run that gets to them."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"))
    root, config = f"{shared_dir(spark)}/inference-{uuid.uuid4().hex}", {"model": "estimate"}
    go = lambda **more: inference.infer(
        rows, _estimate, config, root, "parts", "sample_id long, sha256 string, score double", wave_rows=max(1, rows.count() // 4), order="sample_id", strict=False, **more
    )
    try:
        go(interrupt_after=1)
    except inference.Interrupted:
        pass
    jobs = inference.jobs(spark, root, go().run_id)
    score = F.from_json("result", "score double")["score"]
    return jobs.groupBy("status", "attempts", "error").agg(F.count("*").alias("n"), _r(F.sum(score), 4).alias("total"))


@query(_MATCHED + """, m AS (SELECT p_partkey AS image, CASE WHEN b < 15 THEN 'seed' WHEN b < 55 THEN 'pool' WHEN b < 75 THEN 'dev' ELSE 'test' END AS split, p_brand AS brand
  FROM (SELECT *, ('0x' || substr(sha256('split-v1:' || p_partkey), 1, 8))::BIGINT % 100 AS b FROM part)),
k AS (SELECT split, brand, coalesce(objects, 0) AS objects, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM m LEFT JOIN counts USING (image) WHERE split IN ('dev', 'test')),
o AS (SELECT split, g.image, (x.j IS NOT NULL)::INT AS hit FROM gold g JOIN m USING (image) LEFT JOIN matched x ON x.image = g.image AND x.cls = g.cls AND x.j = g.j
  WHERE split IN ('dev', 'test') AND (x2 - x1) * (y2 - y1) < 300)
SELECT split, tag, count(*) AS images, sum(objects)::BIGINT AS objects, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / nullif(sum(objects), 0), 6) AS recall,
  round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS precision FROM (SELECT *, unnest(['all', 'brand:' || brand]) AS tag FROM k) GROUP BY ALL
UNION ALL SELECT split, 'object:small', count(DISTINCT image), count(*), sum(hit)::BIGINT, NULL, (count(*) - sum(hit))::BIGINT, round(avg(hit), 6), NULL FROM o GROUP BY split""")
def checked_evaluation(spark, sf):
    """Slices of two splits of a manifest after all checks: images without a box count, and none is left out."""
    gold, predictions = boxes(spark, sf)
    manifest = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), S.split_of(F.col("p_partkey")).alias("split"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), F.col("p_brand").alias("brand"))
    labelled = manifest.join(evaluation.labels_digests(gold), "image", "left").withColumn("labels_sha256", F.coalesce("labels_sha256", evaluation.no_labels_digest(gold)))
    predicted = manifest.select("image", "sha256", F.lit("v1").alias("version"))
    small = {"small": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < 300}
    found = evaluation.evaluate(labelled, gold, predicted, predictions, ["dev", "test"], "v1", ["brand"], small, with_metrics=False)
    return found.slices.withColumns({c: _r(c) for c in ("recall", "precision")})


_DIAGNOSED = MATCH_SQL.format(least="0.05") + """, m AS (SELECT p_partkey AS image, p_partkey // 20 AS grp, CASE WHEN b < 15 THEN 'seed' WHEN b < 55 THEN 'pool' WHEN b < 75 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(sha256('split-v1:' || p_partkey), 1, 8))::BIGINT % 100 AS b FROM part)),
low AS (SELECT image, count(*) FILTER (score >= 0.05 AND score < 0.5) AS low_count, coalesce(sum(score * (1 - score)) FILTER (score >= 0.05 AND score < 0.5), 0) AS mass,
  count(*) FILTER (score >= 0.05) AS n_low, count(*) FILTER (score >= 0.5) AS n_high FROM pred GROUP BY image),
hit AS (SELECT image, count(*) AS tp_low, count(*) FILTER (score >= 0.5) AS tp_high FROM matched GROUP BY image),
obj AS (SELECT image, count(*) AS objects FROM gold GROUP BY image),
rec AS (SELECT image, grp, split, coalesce(objects, 0) AS objects, coalesce(tp_low, 0) AS tp_low, coalesce(tp_high, 0) AS tp_high, coalesce(n_low, 0) AS n_low, coalesce(n_high, 0) AS n_high,
  coalesce(low_count, 0) AS low_count, coalesce(mass, 0) AS mass FROM m LEFT JOIN obj USING (image) LEFT JOIN hit USING (image) LEFT JOIN low USING (image)),
x AS (SELECT image, grp, i, e.x FROM m JOIN (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) e ON e.vec_id = image % 40),
fail AS (SELECT x.image, x.grp, i, x.x FROM x JOIN rec USING (image) WHERE split = 'dev' AND tp_low > tp_high)"""


def _diagnosis(spark, sf):
    """Images of the parts, the vectors that stand for their embeddings, gold boxes and predictions."""
    gold, predictions = boxes(spark, sf)
    key = F.col("p_partkey")
    images = table(spark, sf, "part").select(key.alias("image"), F.floor(key / 20).alias("group"), S.split_of(key).alias("split"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"))
    vectors = table(spark, sf, "embeddings").where("vec_id < 40").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    predicted = images.join(vectors, F.col("image") % 40 == F.col("vec_id")).select("image", "sha256", "embedding")
    return images, gold, predictions, predicted


@query("WITH RECURSIVE " + _DIAGNOSED + """, t AS (SELECT i, sum(x) AS s, count(*) AS n FROM fail GROUP BY i), o AS (SELECT grp, i, sum(x) AS s, count(*) AS n FROM fail GROUP BY grp, i),
p AS (SELECT grp, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY grp)), 1e-12) AS v FROM (SELECT g.grp, t.i, (t.s - coalesce(o.s, 0)) / (t.n - coalesce(o.n, 0)) AS v
  FROM (SELECT DISTINCT grp FROM rec WHERE split = 'dev') g CROSS JOIN t LEFT JOIN o ON o.grp = g.grp AND o.i = t.i)),
sim AS (SELECT image, greatest(0, sum(x.x * p.v)) AS similarity FROM x JOIN p USING (grp, i) GROUP BY image)
SELECT image, objects, tp_high, tp_low, n_high - tp_high AS fp_high, n_low - tp_low AS fp_low, tp_low - tp_high AS recoverable, objects - tp_low AS unrecovered, low_count,
  round(mass, 6) AS mass, round(similarity, 6) AS similarity, round(similarity * ln(1 + mass), 6) AS score FROM rec JOIN sim USING (image) WHERE split = 'dev'""")
def development_diagnosis(spark, sf):
    """Development images: matches, recoverable misses, and their likeness to the failures of all other groups."""
    images, gold, predictions, predicted = _diagnosis(spark, sf)
    found = diagnosis.leave_group_out(diagnosis.records(images.where("split = 'dev'"), gold, predictions, predicted))
    return found.drop("group", "embedding").withColumns({c: _r(c) for c in ("mass", "similarity", "score")})


@query("WITH RECURSIVE " + _DIAGNOSED + """, p AS (SELECT i, v / greatest(sqrt(sum(v * v) OVER ()), 1e-12) AS v FROM (SELECT i, avg(x) AS v FROM fail GROUP BY i)),
sim AS (SELECT image, greatest(0, sum(x.x * p.v)) AS similarity FROM x JOIN p USING (i) GROUP BY image)
SELECT image AS sample_id, round(mass, 6) AS mass, round(similarity, 6) AS similarity, round(similarity * ln(1 + mass), 6) AS score FROM rec JOIN sim USING (image) WHERE split = 'pool'""")
def failure_ranking(spark, sf):
    """The pool's likeness to the development images with recoverable misses, and its low-confidence mass."""
    images, gold, predictions, predicted = _diagnosis(spark, sf)
    proto = diagnosis.prototype(diagnosis.records(images.where("split = 'dev'"), gold, predictions, predicted))
    pool = images.where("split = 'pool'").select(F.col("image").alias("sample_id"), F.col("group").alias("group_id"), "split", F.lit("p").alias("image_path"), "sha256")
    return diagnosis.rank_pool(pool, predicted, predictions, proto).select("sample_id", *[_r(c).alias(c) for c in ("mass", "similarity", "score")])


@query(f"""WITH {BOXES_SQL}, plans AS (SELECT p_partkey AS k, 'even' AS plan FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'brand' FROM part WHERE p_size % 10 = 3 UNION ALL SELECT p_partkey, 'even' FROM part WHERE p_partkey % 12 = 0)
SELECT k AS sample_id, 'unreviewed' AS status, string_agg(DISTINCT plan, ',' ORDER BY plan) AS selected_by, (SELECT count(*) FROM pred WHERE image = k AND score >= 0.5) AS proposals,
  (SELECT string_agg(cls || ':' || x1::INT || ':' || y1::INT, ',' ORDER BY score DESC, j) FROM pred WHERE image = k AND score >= 0.5) AS boxes FROM plans GROUP BY k""")
def review_proposals(spark, sf):
    """Samples that plans chose, with the boxes that the model proposes for review."""
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "sample_id")
    plan = lambda where, name: part.where(where).select("sample_id", F.lit(name).alias("plan"))
    plans = plan("sample_id % 6 = 0", "even").union(plan("p_size % 10 = 3", "brand")).union(plan("sample_id % 12 = 0", "even"))
    queue = diagnosis.review_queue(plans, boxes(spark, sf)[1])
    told = F.transform("proposed_boxes", lambda b: F.concat_ws(":", b["label"], b["box"][0].cast("int"), b["box"][1].cast("int")))
    return queue.select("sample_id", "status", F.array_join("selected_by", ",").alias("selected_by"), F.size("proposed_boxes").cast("long").alias("proposals"), F.nullif(F.array_join(told, ","), F.lit("")).alias("boxes"))


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_discount * 12 - 0.1::DOUBLE AS x, l_tax * 8 AS y, l_quantity / 45 - 0.1::DOUBLE AS w, l_linenumber::DOUBLE / 5 AS h,
  CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 1 END AS cls FROM lineitem),
b AS (SELECT cls, least(greatest(x * 640, 0), 640) AS x1, least(greatest(y * 360, 0), 360) AS y1, least(greatest((x + w) * 640, 0), 640) AS x2, least(greatest((y + h) * 360, 0), 360) AS y2, w, h FROM r WHERE cls IS NOT NULL),
e AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'invalid box' WHEN x2 <= x1 OR y2 <= y1 THEN 'outside of the image' END AS error FROM b)
SELECT cls, error, count(*) AS n, round(avg((x2 - x1) * (y2 - y1)), 4) AS mean_area FROM e GROUP BY ALL""")
def label_conversion(spark, sf):
    """Nested annotations, an image a part, to boxes in pixels: by class, how many are boxes, and why others aren't."""
    rows = table(spark, sf, "lineitem")
    label = F.when(F.col("l_returnflag") == "N", "car").when(F.col("l_returnflag") == "R", "rider").otherwise("lane")
    box = F.array(F.col("l_discount") * 12 - 0.1, F.col("l_tax") * 8, F.col("l_quantity") / 45 - 0.1, F.col("l_linenumber").cast("double") / 5)
    objects = F.struct(label.alias("label"), box.alias("bounding_box"), F.lit(None).cast("boolean").alias("occluded"), F.lit(None).cast("boolean").alias("truncated"))
    samples = rows.groupBy("l_partkey").agg(F.collect_list(objects).alias("d")).select(
        F.concat(F.lit("parts/"), "l_partkey", F.lit(".jpg")).alias("filepath"), F.struct(F.lit(640).alias("width"), F.lit(360).alias("height")).alias("metadata"), F.struct(F.col("d").alias("detections")).alias("detections")
    )
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return labels.converted(samples).groupBy("cls", "error").agg(F.count("*").alias("n"), _r(F.avg(area), 4).alias("mean_area"))
