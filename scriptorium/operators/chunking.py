"""Markdown to chunks: heading sections with breadcrumbs, runts merged, long sections split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

FLOOR = 80
_HEADING = r"\A(#{2,3})[ \t]+([^\n]*)"


def sections(bodies: DataFrame) -> DataFrame:
    """(doc_id, pos, heading_path, text) from (doc_id, body).

    Sections start at level 2 and 3 headings; the heading line is not part of the text. Empty
    sections are dropped after they have moved the breadcrumb. A level 3 heading before any level
    2 heading nests under the first such heading.
    """
    parts = bodies.select("doc_id", F.posexplode(F.split("body", r"(?m)(?=^#{2,3}[ \t]+\S)")).alias("pos", "part"))
    level = F.length(F.regexp_extract("part", _HEADING, 1))
    parts = parts.withColumn("level", level).withColumn("head", X.strip(F.regexp_extract("part", _HEADING, 2)))
    parts = parts.withColumn("text", X.strip(F.regexp_replace("part", r"\A#{2,3}[ \t]+[^\n]*", "")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    h2 = F.last(F.when(F.col("level") == 2, F.col("head")), ignorenulls=True).over(w)
    orphan = F.first(F.when(F.col("level") == 3, F.col("head")), ignorenulls=True).over(w)
    path = F.when(F.col("level") == 2, F.col("head")).when(F.col("level") == 3, F.concat_ws(" > ", F.coalesce(h2, orphan), "head")).otherwise(F.lit(""))
    return parts.withColumn("heading_path", path).where("text <> ''").select("doc_id", "pos", "heading_path", "text")


def merge_runts(sections_: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Sections below the floor join the one before them and take its heading; a leading one stands."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    starts = (F.row_number().over(w) == 1) | (X.tokens(F.col("text")) >= floor)
    marked = sections_.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("int")).over(w))
    merged = marked.groupBy("doc_id", "island").agg(
        F.min("pos").alias("pos"), F.min_by("heading_path", "pos").alias("heading_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n\n").alias("text"),
    )
    return merged.select("doc_id", "pos", "heading_path", "text")


def chunk(docs: DataFrame, target: int, hard: int) -> DataFrame:
    """CHUNKS rows from (doc_id, path, title, sensitivity, markdown)."""
    bodies = docs.select("doc_id", X.strip_frontmatter(F.col("markdown")).alias("body"))
    merged = merge_runts(sections(bodies))
    pieces = merged.select("doc_id", "pos", "heading_path", F.posexplode(X.hard_split(target, hard)(F.col("text"))).alias("k", "body"))
    pieces = pieces.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")) - 1)
    out = pieces.join(docs.select("doc_id", "path", "title", "sensitivity"), "doc_id")
    return out.select(
        X.chunk_id(F.col("doc_id"), F.col("heading_path"), F.col("ordinal")).alias("chunk_id"), "doc_id", F.col("ordinal").cast("int").alias("ordinal"), "heading_path",
        X.prelude(F.col("title"), F.col("path"), F.col("heading_path")).alias("prelude"), "body", "sensitivity",
    )
