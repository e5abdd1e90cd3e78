"""Questions about documents and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def topics(edges: DataFrame, docs: DataFrame, *, visible: str | None) -> DataFrame:
    """(doc_id, path, title, members): visible notes with resolved topic edges, largest first.

    Members are counted whether or not they are visible or exist.
    """
    n = edges.where("kind = 'topic' AND resolved").groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("members"))
    rows = docs.where(X.visible(F.col("sensitivity"), visible)).join(n, "doc_id")
    return rows.select("doc_id", "path", "title", "members").orderBy(F.desc("members"), "path")


def resolve_doc(docs: DataFrame, needle: str, *, visible: str | None) -> DataFrame:
    """The visible documents a path, file name or title names: by id first, else by title or path suffix.

    One row is the document, several are ambiguous, none is missing (or hidden, which looks the same).
    Lower case is Unicode's and the needle has no wildcards.
    """
    want = needle.strip().lower()
    as_id = want if want.endswith(".md") else f"{want}.md"
    rows = docs.where(X.visible(F.col("sensitivity"), visible))
    path = F.lower("path")
    by_id = (F.col("doc_id") == as_id) | (F.col("doc_id") == want)
    loose = (F.lower("title") == want) | path.endswith(f"/{as_id}") | (path == as_id)
    found = rows.where(by_id | loose).withColumn("exact", by_id)
    return found.where(F.col("exact") == found.agg(F.max("exact")).scalar()).drop("exact")


def resolve_docs(needles: DataFrame, docs: DataFrame, *, visible: str | None) -> DataFrame:
    """(needle, n, doc_id) for all needles at once, by the rule of ``resolve_doc``: 1 is found, more are ambiguous, 0 missing.

    Every document stands under its id, its title and each suffix of its path that begins at a folder, so a look-up is an
    equality join and no needle scans the documents. ``doc_id`` is the smallest one that fits, null if none does. Needles are
    distinct; null needles are missing.
    """
    path = F.split(F.lower("path"), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, i, F.size(path)), "/"))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    names = F.concat(F.array(key("id", F.col("doc_id").cast("string")), key("title", F.lower("title"))), F.transform(suffixes, lambda s: key("path", s)))
    known = docs.where(X.visible(F.col("sensitivity"), visible)).select("doc_id", F.explode(names).alias("k")).select("doc_id", "k.*")
    want = F.lower(F.trim("needle"))
    note = F.when(want.endswith(".md"), want).otherwise(F.concat(want, F.lit(".md")))
    tried = F.array(key("id", want), key("id", note), key("title", want), key("path", note))
    each = needles.select("needle").distinct()
    hits = each.select("needle", F.explode(F.array_distinct(tried)).alias("k")).select("needle", "k.*").join(known, ["kind", "key"])
    hits = hits.select("needle", (F.col("kind") == "id").alias("exact"), "doc_id").distinct()
    best = hits.groupBy("needle", "exact").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).groupBy("needle").agg(F.max_by(F.struct("n", "doc_id"), "exact").alias("best"))
    return each.join(best, "needle", "left").select("needle", F.coalesce("best.n", F.lit(0)).alias("n"), "best.doc_id")


def read_document(chunks: DataFrame, docs: DataFrame, *, visible: str | None) -> DataFrame:
    """(doc_id, text): title and link, then chunks in order, with heading lines where the heading changes."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    heading = F.coalesce("heading_path", F.lit(""))
    rows = chunks.where(X.visible(F.col("sensitivity"), visible)).withColumn("h", heading).withColumn("before", F.lag("h").over(w))
    part = F.concat(F.when((F.col("h") != "") & (F.col("before").isNull() | (F.col("before") != F.col("h"))), F.concat(F.lit("## "), "h", F.lit("\n\n"))).otherwise(F.lit("")), "body")
    bodies = rows.withColumn("part", part).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "part"))), lambda s: s["part"]), "\n\n").alias("whole"))
    named = docs.where(X.visible(F.col("sensitivity"), visible)).join(bodies, "doc_id", "left")
    head = F.concat(F.lit("# "), "title", F.lit("\n[["), "path", F.lit("]]"))
    return named.select("doc_id", F.concat(head, F.when(F.col("whole").isNotNull(), F.concat(F.lit("\n\n"), "whole")).otherwise(F.lit(""))).alias("text"))


def neighbors(edges: DataFrame, docs: DataFrame, *, visible: str | None) -> DataFrame:
    """(doc_id, direction, kind, neighbor) of every document.

    Outbound: tags by value, unresolved links as written, resolved ones if the target is visible.
    Inbound: resolved edges from visible documents.
    """
    seen = docs.where(X.visible(F.col("sensitivity"), visible)).select(F.col("doc_id").alias("id"), "path")
    out = edges.join(seen.withColumnRenamed("id", "dst"), "dst", "left")
    value = F.when(F.col("kind") == "tag", F.regexp_replace("dst", "^tag:", "")).when(~F.col("resolved"), F.col("dst")).otherwise(F.col("path"))
    outbound = out.select(F.col("src").alias("doc_id"), F.lit("out").alias("direction"), "kind", value.alias("neighbor"))
    back = edges.where("resolved").join(seen.withColumnRenamed("id", "src"), "src")
    inbound = back.select(F.col("dst").alias("doc_id"), F.lit("in").alias("direction"), "kind", F.col("path").alias("neighbor"))
    return outbound.unionByName(inbound).where("neighbor IS NOT NULL").join(seen.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
