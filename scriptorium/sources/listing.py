"""The change-feed source: listing rows of a document store, and notes put together from leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LISTING

ENTRY_TYPES = ("plain", "newnote")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines dump."""
    return spark.read.schema(LISTING).json(path)


def prefix_end(prefix: str) -> str:
    """The end key of a prefix scan; it is inclusive."""
    p = prefix.lower()
    return p[:-1] + chr(ord(p[-1]) + 1) if p else "\ufff0"


def in_prefix(rows: DataFrame, prefix: str = "") -> DataFrame:
    """The key range of a prefix: a plain range predicate, so it reaches the scan."""
    return rows.where((F.col("id") >= prefix.lower()) & (F.col("id") <= prefix_end(prefix)))


def entries(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Note entries: no rows without id, no soft-deleted ones, no leaves; sorted by doc_id."""
    kept = in_prefix(rows.where(F.col("id").isNotNull()), prefix)
    kept = kept.where(~F.coalesce("doc.deleted", F.lit(False)) & F.col("doc.type").isin(*ENTRY_TYPES))
    return kept.select(
        F.col("id").alias("doc_id"), F.coalesce(F.nullif("doc.path", F.lit("")), "id").alias("path"), F.col("value.rev").alias("rev"),
        F.coalesce("doc.children", F.array().cast("array<string>")).alias("children"), F.coalesce("doc.mtime", F.lit(0)).cast("bigint").alias("mtime"),
    ).orderBy("doc_id")


def leaves(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").isNotNull() & ~F.coalesce("doc.deleted", F.lit(False))).select(F.col("id").alias("leaf"), F.coalesce("doc.data", F.lit("")).alias("data"), F.lit(True).alias("found"))


def reassemble(notes: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """notes with ``markdown``: the leaves' data in order, or null ("torn") if any is missing or there are none."""
    parts = notes.select("doc_id", F.posexplode("children").alias("pos", "leaf")).join(leaf_rows, "leaf", "left")
    whole = parts.groupBy("doc_id").agg(
        F.count_if(F.col("found").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts")
    )
    text = F.when(F.col("missing") == 0, F.array_join(F.transform("parts", lambda p: F.coalesce(p["data"], F.lit(""))), ""))
    return notes.join(whole.select("doc_id", text.alias("markdown")), "doc_id", "left")


def point_get(rows: DataFrame, doc_id: str | Column) -> DataFrame:
    """The row of one id, or none."""
    return rows.where(F.col("id") == doc_id)


def backfill(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Entries already known, for recomputing edges only."""
    return listing.join(known.select("doc_id"), "doc_id", "left_semi")
