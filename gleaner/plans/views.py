"""Detection-like views that queries derive from the plain tables, in both dialects.

boxes: from lineitem. Image l_partkey, class l_linenumber % 3, ordinal j within the image, a box from the row's
quantities, score l_discount * 10; rows with returnflag N are gold, the others predictions.
samples: from embeddings, group label, with the scores that events of the same number give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table

BOXES_SQL = """
boxes AS (SELECT l_partkey AS image, (l_linenumber % 3)::INT AS cls, x AS x1, y AS y1, x + w AS x2, y + h AS y2,
    l_discount * 10 AS score, l_returnflag = 'N' AS is_gold, j
  FROM (SELECT *, ((l_suppkey * 7 + l_linenumber * 3) % 12)::DOUBLE AS x, ((l_orderkey * 5) % 9)::DOUBLE AS y,
    (14 + l_quantity::BIGINT % 12)::DOUBLE AS w, (12 + l_linenumber)::DOUBLE AS h,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag)::BIGINT AS j
    FROM lineitem)),
gold AS (SELECT image, cls, j, x1, y1, x2, y2 FROM boxes WHERE is_gold),
pred AS (SELECT image, cls, j, x1, y1, x2, y2, score FROM boxes WHERE NOT is_gold),
pairs AS (SELECT image, cls, j, p, score, iou FROM (SELECT g.image, g.cls, g.j, p.j AS p, p.score,
    greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS common,
    (g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS areas, common / (areas - common) AS iou
  FROM gold g JOIN pred p ON g.image = p.image AND g.cls = p.cls) WHERE iou >= 0.5)"""

#: The matching as a recursive query: the state is the list of used gold boxes and the matched pairs of an image and class.
MATCH_SQL = BOXES_SQL + """,
cand AS (SELECT image, cls, p, score, list(j ORDER BY iou DESC, j DESC) AS free,
    row_number() OVER (PARTITION BY image, cls ORDER BY score DESC, p) AS n FROM pairs WHERE score >= {least} GROUP BY image, cls, p, score),
walk AS (SELECT image, cls, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS p, NULL::BIGINT AS j, NULL::DOUBLE AS score
    FROM (SELECT DISTINCT image, cls FROM cand)
  UNION ALL
  SELECT w.image, w.cls, c.n, CASE WHEN len(f) > 0 THEN list_append(w.used, f[1]) ELSE w.used END, c.p, f[1], c.score
  FROM (SELECT w.*, c.p AS cp FROM walk w JOIN cand c ON w.image = c.image AND w.cls = c.cls AND c.n = w.n + 1) w
    JOIN (SELECT * FROM cand) c ON w.image = c.image AND w.cls = c.cls AND c.n = w.n + 1,
    LATERAL (SELECT list_filter(c.free, lambda x: NOT list_contains(w.used, x)) AS f)),
matched AS (SELECT image, cls, p, j, score FROM walk WHERE j IS NOT NULL)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """gold and predictions."""
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag"]
    x, y = ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 3) % 12).cast("double"), ((F.col("l_orderkey") * 5) % 9).cast("double")
    w, h = (14 + F.col("l_quantity").cast("long") % 12).cast("double"), (12 + F.col("l_linenumber")).cast("double")
    all_ = rows.select(
        F.col("l_partkey").alias("image"), (F.col("l_linenumber") % 3).cast("int").alias("cls"),
        F.row_number().over(W.partitionBy("l_partkey").orderBy(*order)).cast("long").alias("j"),
        x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
        (F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "N").alias("is_gold"),
    )
    return all_.where("is_gold").drop("score", "is_gold"), all_.where("not is_gold").drop("is_gold")


SCORES_SQL = """scores AS (SELECT user_id AS sample, (event_id % 97)::DOUBLE / 97 AS score FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, score: from events, by user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), ((F.col("event_id") % 97).cast("double") / 97).alias("score"))
