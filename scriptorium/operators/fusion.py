"""Reciprocal-rank fusion, the cap per document, one-hop graph expansion, the quota merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K = 60


def fuse(vec: DataFrame, fts: DataFrame, top_k: int, cap: DataFrame | None = None, max_per_doc: int = 0) -> DataFrame:
    """(qid, ord, id, score, source, distance) from two ranked lists (qid, rank, id, …).

    score = sum of 1 / (60 + rank). Ties keep the vector list's order, then the keyword list's.
    cap: (id, doc_id); at most ``max_per_doc`` rows of a document are kept, before the limit.
    """
    v = vec.select("qid", "id", F.col("rank").alias("vr"), "distance")
    t = fts.select("qid", "id", F.col("rank").alias("tr"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(K) + F.col(r)), F.lit(0.0))
    both = v.join(t, ["qid", "id"], "full_outer").withColumn("score", part("vr") + part("tr"))
    source = F.when(F.col("vr").isNull(), "fts").when(F.col("tr").isNull(), "vector").otherwise("vector+fts")
    both = both.withColumn("source", source)
    order = [F.desc("score"), F.col("vr").isNull(), F.col("vr"), F.col("tr")]
    if max_per_doc and cap is not None:
        w = Window.partitionBy("qid", "doc_id").orderBy(*order)
        both = both.join(cap, "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_per_doc).drop("n", "doc_id")
    w = Window.partitionBy("qid").orderBy(*order)
    return both.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top_k).select("qid", "ord", "id", "score", "source", "distance")


def lead_chunks(chunks: DataFrame, *, visible: str | None) -> DataFrame:
    """The first visible chunk of every document."""
    rows = chunks.where(X.visible(F.col("sensitivity"), visible))
    return rows.groupBy("doc_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"))


def topic_edges(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'topic' AND resolved").select("src", "dst").distinct()


def siblings(hits: DataFrame, edges: DataFrame, docs: DataFrame, leads: DataFrame, max_siblings: int, *, visible: str | None) -> DataFrame:
    """(qid, ord, score, topic, k, cand): every hit's topics (k = 0) and their first visible members (k from 1).

    A topic without a visible lead chunk is not traversed. The limit counts members before those
    already present are dropped. hits: (qid, ord, doc_id, score).
    """
    t = topic_edges(edges)
    ht = hits.select("qid", "ord", "doc_id", "score").join(t.select(F.col("dst").alias("doc_id"), F.col("src").alias("topic")), "doc_id")
    ht = ht.join(leads.select(F.col("doc_id").alias("topic")), "topic", "left_semi")
    seen = docs.where(X.visible(F.col("sensitivity"), visible)).select(F.col("doc_id").alias("cand"))
    # Members of a topic are ranked once; leaving out the hit itself moves later ones up by one.
    members = t.select(F.col("src").alias("topic"), F.col("dst").alias("cand")).join(seen, "cand", "left_semi")
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("cand"))).where(F.col("n") <= max_siblings + 1)
    sb = ht.join(members, "topic").where("cand <> doc_id")
    sb = sb.withColumn("k", F.row_number().over(Window.partitionBy("qid", "ord", "topic").orderBy("cand"))).where(F.col("k") <= max_siblings)
    return ht.select("qid", "ord", "score", "topic", F.lit(0).alias("k"), F.col("topic").alias("cand")).unionByName(sb.select("qid", "ord", "score", "topic", "k", "cand"))


def expand(hits: DataFrame, edges: DataFrame, docs: DataFrame, chunks: DataFrame, max_siblings: int, discount: float, *, visible: str | None) -> DataFrame:
    """(qid, ord, doc_id, id, score): documents one hop away from hits, in the order they are reached.

    Documents present among the hits are left out, each other one is reached by its first hit; its
    score is that hit's, discounted, and its chunk the document's first visible one.
    """
    leads = lead_chunks(chunks, visible=visible)
    cands = siblings(hits, edges, docs, leads, max_siblings, visible=visible)
    fresh = cands.join(hits.select("qid", F.col("doc_id").alias("cand")).distinct(), ["qid", "cand"], "left_anti")
    first = Window.partitionBy("qid", "cand").orderBy("ord", "topic", "k", "cand")
    fresh = fresh.join(leads.select(F.col("doc_id").alias("cand"), F.col("chunk_id").alias("id")), "cand")
    kept = fresh.withColumn("n", F.row_number().over(first)).where("n = 1")
    w = Window.partitionBy("qid").orderBy("ord", "topic", "k", "cand")
    return kept.select("qid", F.row_number().over(w).cast("int").alias("ord"), F.col("cand").alias("doc_id"), "id", (F.col("score") * discount).alias("score"))


def merge(fused: DataFrame, expanded: DataFrame, final_k: int, slots: int) -> DataFrame:
    """(qid, ord, id, score, source): fused and expanded rows by score, at most ``slots`` of the graph.

    Graph rows beyond the slots are held back and fill what is left; a filled list is sorted again
    by score, held-back rows last among equals. With no slots, or nothing expanded for a
    question, only fused rows are returned.
    """
    f = fused.select("qid", "id", "score", "source", F.lit(0).alias("graph"), F.col("ord").alias("pos"))
    g = expanded.select("qid", "id", "score", F.lit("graph").alias("source"), F.lit(1).alias("graph"), F.col("ord").alias("pos"))
    rows = f.unionByName(g) if slots > 0 else f
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "graph", "pos")
    rows = rows.withColumn("o", F.row_number().over(order))
    rows = rows.withColumn("held", (F.sum("graph").over(order.rowsBetween(Window.unboundedPreceding, 0)) > slots) & (F.col("graph") == 1))
    rows = rows.withColumn("take", F.row_number().over(Window.partitionBy("qid").orderBy("held", "o"))).where(F.col("take") <= final_k)
    out = Window.partitionBy("qid").orderBy(F.desc("score"), "held", "o")
    return rows.select("qid", F.row_number().over(out).alias("ord"), "id", "score", "source")
