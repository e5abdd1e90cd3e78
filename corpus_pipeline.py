"""A training-corpus pipeline: filter, deduplicate, redact, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages
the rows are written as Parquet and read again, so a lost executor costs part of one stage.

Edge cases, for every stage: an empty table gives no rows; columns beside those of documents stay and change nothing,
whatever their names; very long texts are worked on whole. Rows are decided on one by one, so null and repeated ids lose
nothing. Null and empty texts fail the quality rules; in the later stages they are one group of near duplicates, hold no personal
data, are drawn 0 words and so leave the mix; packing would give them the end id alone. Of equal candidates for the survivor of a group, that of the
smallest id, then of the smallest digest of its text, then any of the equal rows stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import mixing, packing, pii, quality_rules, simhash
from scriptorium.llm.common import broadcast_if_small, materialize, table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_names(stage: Stage) -> Stage:
    """Columns beside those of documents are renamed while a stage runs, so that none clashes with its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"extra_{i}_" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run


@own_names
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep."""
    return quality_rules.judge(docs, quality_rules.trusted_ids(spark, sf_dir)).where("rules.kept").select(*docs.columns)


@own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts alike (5-word shingles, Jaccard 0.8 or more): that of the smallest id.

    Rows are told apart by a key of their own, so null and repeated ids lose nothing; only keys are joined back.
    """
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()))
    groups = simhash.row_groups(rows.select("row", "text"))
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"), "row")
    named = groups.join(rows.select("row", first.alias("first")), "row")
    kept = materialize(named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first.row"))
    drop = groups.join(broadcast_if_small(kept.select("root")), "root", "left_semi").join(broadcast_if_small(kept.select("row")), "row", "left_anti")
    return rows.join(broadcast_if_small(materialize(drop.select("row"))), "row", "left_anti").select(*docs.columns)


@own_names
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind."""
    return pii.redact(docs)


@own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix: documents drawn twice are two rows, a document a quota ends in is cut."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: Hashing, fixed points and tokenization have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
