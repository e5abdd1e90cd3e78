"""Change detection between a listing and the stored documents, and its application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .sizes import ROWS


class MassDeletion(RuntimeError):
    pass


def classify(listing: DataFrame, docs: DataFrame, rebuild: bool = False) -> DataFrame:
    """(doc_id, class): listing has (doc_id, rev, markdown), docs (doc_id, rev, content_hash).

    Same revision: unchanged, whatever the text. Torn notes (null markdown) are skipped, and stay
    indexed if they were. Unknown: new. Same hash: touched. Else changed. A rebuild neither trusts
    revisions nor hashes. Documents that are not listed are ``deleted``.

    Revisions are compared first: where the notes to read are few, only theirs are hashed.
    """
    old = docs.select("doc_id", F.col("rev").alias("old_rev"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    read = F.col("read") if (to_read := None if rebuild else _to_read(listing, docs)) is not None else F.lit(True)
    rows = listing if to_read is None else listing.join(F.broadcast(to_read.withColumn("read", F.lit(True))), "doc_id", "left")
    # Hashes travel, not texts.
    new = rows.select("doc_id", "rev", F.when(read, X.content_hash(F.col("markdown"))).alias("hash"), F.lit(True).alias("listed"))
    both = new.join(old, "doc_id", "full_outer")
    known, trust = F.col("known").isNotNull(), F.lit(not rebuild)
    kind = (
        F.when(F.col("listed").isNull(), "deleted")
        .when(known & trust & F.col("rev").eqNullSafe(F.col("old_rev")), "unchanged")
        .when(F.col("hash").isNull(), "skipped")
        .when(~known, "new")
        .when(trust & (F.col("hash") == F.col("old_hash")), "touched")
        .otherwise("changed")
    )
    return both.select("doc_id", kind.alias("class"))


def _to_read(listing: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(doc_id,) of listed notes without a stored document of their revision; None if they are too many to broadcast."""
    known = docs.select("doc_id", F.col("rev").alias("old_rev"), F.lit(True).alias("known"))
    open_ = listing.select("doc_id", "rev").join(known, "doc_id", "left").where(F.col("known").isNull() | ~F.col("rev").eqNullSafe(F.col("old_rev")))
    ids = open_.select("doc_id").distinct()
    return ids if ids.limit(ROWS + 1).count() <= ROWS else None


def deletions(listing: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(listing.select("doc_id"), "doc_id", "left_anti")


def report(classified: DataFrame) -> DataFrame:
    """One row: the number of each class, and how many notes had to be read."""
    n = lambda *c: F.count_if(F.col("class").isin(*c))
    return classified.agg(
        n("new").alias("n_new"), n("changed").alias("n_changed"), n("touched").alias("n_touched"), n("unchanged").alias("n_unchanged"),
        n("deleted").alias("n_deleted"), n("skipped").alias("n_skipped"), n("new", "changed", "touched").alias("n_reads"),
    )


def deletion_guard(classified: DataFrame, docs: DataFrame, floor: int = 25, fraction: float = 0.2) -> DataFrame:
    """One row (n_cached, n_deleted, refused): refused if a large part of a non-trivial index would go."""
    cached = docs.agg(F.count("*").alias("n_cached"))
    gone = classified.agg(F.count_if(F.col("class") == "deleted").alias("n_deleted"))
    refused = (F.col("n_cached") >= floor) & (F.col("n_deleted") >= F.col("n_cached") * fraction)
    return cached.join(F.broadcast(gone)).select("n_cached", "n_deleted", refused.alias("refused"))  # one row each


def check_deletions(classified: DataFrame, docs: DataFrame, allow: bool = False, **kw) -> None:
    row = deletion_guard(classified, docs, **kw).first()
    if row["refused"] and not allow:
        raise MassDeletion(f"{row['n_deleted']} of {row['n_cached']} documents would be deleted")


def upsert(old: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``fresh`` replace rows of the same key, all columns; others stay."""
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def touch(docs: DataFrame, revs: DataFrame) -> DataFrame:
    """Only the revision of touched documents changes."""
    new = revs.select("doc_id", F.col("rev").alias("new_rev"))
    return docs.join(new, "doc_id", "left").withColumn("rev", F.coalesce("new_rev", "rev")).drop("new_rev").select(*docs.columns)


def document_rows(notes: DataFrame, personal: tuple[str, ...]) -> DataFrame:
    """DOCS rows of (doc_id, path, rev, mtime, markdown)."""
    front = F.coalesce(X.frontmatter_json(X.frontmatter_block(F.col("markdown"))), F.lit("{}"))
    d = notes.withColumn("frontmatter", front)
    return d.select(
        "doc_id", "path", X.title(F.get_json_object("frontmatter", "$.title"), F.col("path")).alias("title"), "rev", X.content_hash(F.col("markdown")).alias("content_hash"),
        X.sensitivity(F.col("path"), F.get_json_object("frontmatter", "$.sensitivity"), personal).alias("sensitivity"), "mtime", "frontmatter",
    )


def reclassify(docs: DataFrame, personal: tuple[str, ...]) -> DataFrame:
    """docs with visibility computed again, and ``changed``; contents and vectors are not touched."""
    now = X.sensitivity(F.col("path"), F.get_json_object("frontmatter", "$.sensitivity"), personal)
    return docs.withColumn("now", now).withColumn("changed", F.col("now") != F.col("sensitivity")).withColumn("sensitivity", F.col("now")).drop("now")


def spread_sensitivity(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    new = docs.select("doc_id", F.col("sensitivity").alias("now"))
    return chunks.join(new, "doc_id", "left").withColumn("sensitivity", F.coalesce("now", "sensitivity")).select(*chunks.columns)


def unmatched_globs(spark, paths: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """(glob,) of the patterns that match no path: one aggregation, a flag for each pattern."""
    if not globs:
        return spark.createDataFrame([], "glob string")
    flags = [F.coalesce(F.max(F.col("path").rlike(X.glob_regex(g)).cast("int")), F.lit(0)).alias(f"g{i}") for i, g in enumerate(globs)]
    hit = paths.agg(*flags)
    named = F.array(*[F.struct(F.lit(g).alias("glob"), F.col(f"g{i}").alias("hit")) for i, g in enumerate(globs)])
    return hit.select(F.explode(named).alias("g")).where("g.hit = 0").select("g.glob")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.join(vectors.where("embedding IS NOT NULL").select(key), key, "left_anti")
