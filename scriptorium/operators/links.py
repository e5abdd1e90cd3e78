"""The link graph: extraction, resolution, edges.

Targets are resolved once against all documents. Two effects of resolving row by row while a
batch is applied are therefore absent on purpose: a link written exactly as a later document's id
resolves at once, and a title that becomes ambiguous later is not resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The link syntax and the markers of a topic note's region.
_LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
_REGION = r"(?s)<!--\s*begin:clippings\s*-->(.*?)<!--\s*end:clippings\s*-->"


def wikilinks(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LINK), F.lit(1))
    return F.filter(F.transform(found, X.strip), lambda t: t != "")


def topic_links(text: Column, region: str = _REGION) -> Column:
    """Links inside the marked regions only."""
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(region), F.lit(1)), wikilinks))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]+)"'), F.lit(1))


def name_index(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n): lower-case file names and titles, how many documents share each, and the smallest id of them.

    Counts are summed before the shuffle, so a name that very many notes share is one row a task.
    """
    names = F.array_distinct(F.array(*[F.lower(X.strip(c)) for c in (F.regexp_replace(X.file_name(F.col("path")), r"\.md\z", ""), F.col("title"))]))
    keys = docs.select("doc_id", F.explode(names).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def resolve(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """targets with ``dst`` and ``resolved``: the id with .md (added where it is missing), the id as written, a unique file name or title, else as written."""
    ids = docs.select(F.col("doc_id").alias("id"))
    want = F.lower(X.strip(F.col("target")))
    note = F.when(want.endswith(".md"), want).otherwise(F.concat(want, F.lit(".md")))
    keyed = targets.withColumn("k1", note).withColumn("k2", want).withColumn("k3", F.lower(X.strip(X.file_name(F.col("target")))))
    unique = name_index(docs).where("n = 1").select(F.col("key").alias("k3"), F.col("doc_id").alias("by_name"))
    found = keyed.join(ids.withColumnRenamed("id", "k1").withColumn("a", F.col("k1")), "k1", "left").join(ids.withColumnRenamed("id", "k2").withColumn("b", F.col("k2")), "k2", "left").join(unique, "k3", "left")
    dst = F.coalesce("a", "b", "by_name")
    return found.select(*targets.columns, F.coalesce(dst, "target").alias("dst"), dst.isNotNull().alias("resolved"))


def edges(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """EDGES rows of notes (doc_id, markdown, frontmatter) against all docs."""
    body = F.col("markdown")
    links = notes.select(F.col("doc_id").alias("src"), F.explode(wikilinks(body)).alias("target"), F.lit("wikilink").alias("kind"))
    topics = notes.select(F.col("doc_id").alias("src"), F.explode(topic_links(body)).alias("target"), F.lit("topic").alias("kind"))
    tagged = notes.select(F.col("doc_id").alias("src"), F.explode(F.transform(X.tags(F.col("frontmatter")), lambda t: F.concat(F.lit("tag:"), t))).alias("dst"), F.lit("tag").alias("kind"), F.lit(False).alias("resolved"))
    both = resolve(links.unionByName(topics), docs).select("src", "dst", "kind", "resolved")
    return both.unionByName(tagged).dropDuplicates(["src", "dst", "kind"])


def resolve_pending(known: DataFrame, docs: DataFrame) -> DataFrame:
    """All edges after another attempt at the unresolved links; an edge that exists already wins."""
    pending = known.where(~F.col("resolved") & F.col("kind").isin("wikilink", "topic"))
    again = resolve(pending.select("src", F.col("dst").alias("target"), "kind"), docs).select("src", "dst", "kind", "resolved")
    rest = known.join(pending.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    return rest.unionByName(again).groupBy("src", "dst", "kind").agg(F.max("resolved").alias("resolved"))
