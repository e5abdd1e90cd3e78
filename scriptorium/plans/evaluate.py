"""Evaluation: what graph expansion displaces, and how well a distance threshold separates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def displacement(off: DataFrame, on: DataFrame) -> DataFrame:
    """(qid, n_hits, n_expanded, n_displaced): off and on are (qid, id, source) results without and with the graph."""
    n = on.groupBy("qid").agg(F.count("*").alias("n_hits"), F.count_if(F.col("source") == "graph").alias("n_expanded"))
    lost = off.select("qid", "id").join(on.select("qid", "id"), ["qid", "id"], "left_anti").groupBy("qid").agg(F.count("*").alias("n_displaced"))
    return n.join(lost, "qid", "left").select("qid", "n_hits", "n_expanded", F.coalesce("n_displaced", F.lit(0)).alias("n_displaced"))


def totals(each: DataFrame) -> DataFrame:
    fired = F.count_if(F.col("n_expanded") > 0)
    return each.agg(
        F.count("*").alias("n_questions"), fired.alias("n_fired"), (fired * 100 / F.count("*")).alias("fired_percent"),
        F.sum("n_expanded").alias("n_expanded"), F.sum("n_displaced").alias("n_displaced"), F.max("n_displaced").alias("worst"),
    )


def calibrate(nearest: DataFrame) -> DataFrame:
    """One row from (covered, distance): ranges of both groups, the midpoint, and how many it puts on the wrong side."""
    edge = nearest.agg(
        F.min(F.when(F.col("covered"), F.col("distance"))).alias("covered_min"), F.max(F.when(F.col("covered"), F.col("distance"))).alias("covered_max"),
        F.min(F.when(~F.col("covered"), F.col("distance"))).alias("uncovered_min"), F.max(F.when(~F.col("covered"), F.col("distance"))).alias("uncovered_max"),
    ).withColumn("midpoint", (F.col("covered_max") + F.col("uncovered_min")) / 2)
    wrong = nearest.join(F.broadcast(edge)).agg(F.count_if(F.col("covered") != (F.col("distance") <= F.col("midpoint"))).alias("misclassified"))  # one row
    return edge.withColumn("separated", F.col("covered_max") < F.col("uncovered_min")).join(F.broadcast(wrong))
