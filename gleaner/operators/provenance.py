"""Drift: which of the artifacts that depend on each other are out of date.

An artifact is drifted if its digest isn't the recorded one, and stale if it was made from an input that is drifted or
stale now, or whose digest at the time was another. Staleness is carried along the edges of the graph a step at a time, to
a fixed point; each step is a join of what became stale last with the edges, so a chain of n steps takes n of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def drifted(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """artifact, reason (changed, gone, not recorded). recorded, current: artifact, digest."""
    now = current.select("artifact", F.col("digest").alias("now"))
    both = recorded.select("artifact", F.col("digest").alias("was")).join(now, "artifact", "full")
    reason = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "not recorded").when(F.col("now") != F.col("was"), "changed")
    return both.select("artifact", reason.alias("reason")).where("reason is not null")


def stale(edges: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """artifact, reason, distance: what has drifted (0), and what was made from it, by the fewest steps. edges: artifact,
    input, and input_digest, the digest that the input had when the artifact was made (null: not noted)."""
    first = drifted(recorded, current).withColumn("distance", F.lit(0))
    now = current.select(F.col("artifact").alias("input"), F.col("digest").alias("now"))
    other = edges.where("input_digest is not null").join(now, "input").where("now <> input_digest").select("artifact").distinct()
    later = other.withColumn("reason", F.lit("made from another version"))
    links = written(edges.select("artifact", "input").distinct())
    known = front = written(first)
    distance = 0
    while True:
        distance += 1
        reached = front.select(F.col("artifact").alias("input")).join(links, "input").select("artifact").distinct().withColumn("reason", F.lit("made from it"))
        if distance == 1:
            reached = reached.join(later, "artifact", "left_anti").unionByName(later)
        front = written(reached.join(known, "artifact", "left_anti").withColumn("distance", F.lit(distance)))
        if not front.take(1):
            return known
        known = written(known.unionByName(front))
