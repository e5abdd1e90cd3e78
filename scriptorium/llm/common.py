"""What several operators share: tables, whole-word rules, scratch tables (``materialize``), linking.

Scratch tables go to the folder the session names in ``spark.checkpoint.dir``, which driver and
executors share, so that work done once survives the loss of executors. Arrow batches of whole texts are bounded by
Spark's own limit of bytes a batch; no operator changes the session's settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write as materialize

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "broadcast_if_small", "components", "kept", "materialize", "table", "unused", "word_count", "words"]

#: White space that separates words, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows up to which a side may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has been counted and holds at most ``rows`` rows.

    Otherwise unchanged, and the join shuffles. Counting stops after ``rows`` + 1 rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, since workers go on from operator to operator and would hold what all of them left."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores until it is none of the columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: one (node, root) row per node, root the smallest node.

    Alternates large-star and small-star steps; each round is a written table, so a lost
    executor costs one round at most. A hub is a skewed join key with one row on the other side,
    which adaptive execution splits. Self links give a node of its own. An empty table gives none.
    """
    spark = edges.sparkSession
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    mark = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
