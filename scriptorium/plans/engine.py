"""The pipelines: indexing a listing into a store, and hybrid search over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..operators import cdc, chunking, context, fusion, grading, graph, keyword, links, vector
from ..operators.sizes import broadcast_if_small
from ..settings import Settings
from ..sources.external import Embedder, WebSearch, answer, check_space, embed, web_results
from ..sources.store import Store

#: The answer where nothing was found.
SILENT = "The notes hold nothing about this."


def gate(allow_web: bool) -> str | None:
    """With the web allowed only open rows are candidates, before any limit."""
    return "open" if allow_web else None


def index(store: Store, listing: DataFrame, settings: Settings, *, rebuild: bool = False, dry_run: bool = False, allow_mass_delete: bool = False, full: bool = True, removed: DataFrame | None = None) -> DataFrame:
    """Brings a store up to date with (doc_id, path, rev, mtime, markdown) notes; returns the one-row report.

    A full listing names all notes: those it lacks are deleted, and visibility is computed again for all. Otherwise it
    names changed notes only, and what is read and written besides the link names grows with them; ``removed`` (doc_id, mtime, rev) are then the notes
    that are deleted, which the store remembers. Raises ``store.Conflict`` if another writer changed one of these notes meanwhile.
    """
    notes = listing.where(X.in_corpus(F.col("path"), settings.include, settings.exclude))
    version = store.current()
    docs, chunks, edges = (store.read(t, version) for t in ("docs", "chunks", "edges"))

    def held(df: DataFrame) -> DataFrame:
        """Written once: what is computed from it has a short plan, and a lost executor costs one step."""
        return scratch.write(df)

    named = notes.select("doc_id") if removed is None else notes.select("doc_id").union(removed.select("doc_id"))
    known = docs if full else docs.join(named, "doc_id", "left_semi")
    classified = held(cdc.classify(notes, known, rebuild))
    cdc.check_deletions(classified, docs, allow_mass_delete, floor=settings.delete_floor, fraction=settings.delete_fraction)
    summary = store.spark.createDataFrame([cdc.report(classified).first()])
    if dry_run:
        return summary
    of = lambda *kinds: classified.where(F.col("class").isin(*kinds)).select("doc_id")
    fresh = notes.join(of("new", "changed"), "doc_id", "left_semi")
    rows = held(cdc.document_rows(fresh, settings.personal))
    gone = of("deleted", "changed", "new")
    kept = docs.join(gone, "doc_id", "left_anti")

    # Kept documents whose row changes: their revision, or their visibility (which their chunks follow).
    touched = cdc.touch(kept.join(of("touched"), "doc_id", "left_semi"), notes.join(of("touched"), "doc_id", "left_semi"))
    rest = kept.join(of("touched"), "doc_id", "left_anti") if full else kept.limit(0)
    moved = held(cdc.reclassify(rest.withColumn("touched", F.lit(False)).unionByName(touched.withColumn("touched", F.lit(True))), settings.personal).where("changed OR touched"))
    now = rows.unionByName(moved.drop("changed", "touched"))
    after = docs.join(gone, "doc_id", "left_anti").join(moved.select("doc_id"), "doc_id", "left_anti").unionByName(now)
    turned = moved.where("changed").select("doc_id")
    made = held(chunking.chunk(rows.join(fresh.select("doc_id", "markdown"), "doc_id"), settings.target_tokens, settings.hard_tokens))
    shifted = cdc.spread_sensitivity(chunks.join(turned, "doc_id", "left_semi"), moved)

    # Links: of the fresh notes, and of notes that had unresolved ones which now resolve.
    standing = edges.join(gone.withColumnRenamed("doc_id", "src"), "src", "left_anti")
    new_edges = links.edges(fresh.join(rows.select("doc_id", "frontmatter"), "doc_id"), after)
    waiting = standing.join(standing.where("NOT resolved AND kind IN ('wikilink', 'topic')").select("src").distinct(), "src", "left_semi")
    settled = held(links.resolve_pending(waiting, after))
    again = settled.where("resolved").join(waiting.where("NOT resolved"), ["src", "kind"], "left_semi").select("src").distinct()

    entries = held(keyword.entries(made))
    old = held(chunks.join(gone, "doc_id", "left_semi"))
    stale = old.select("chunk_id")
    listed = held(keyword.blocked(keyword.postings(entries)))
    # What stale chunks had counted is taken back, term by term: blocks of no bounds of their own.
    back = keyword.postings(keyword.entries(old)).select("term", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("n"), F.lit(None).cast("long").alias("most_tf"), F.lit(None).cast("long").alias("least_dl"), F.col("id").alias("chunk_id"))
    # Ids that are remembered as deleted: those of this run, but for notes that have come back.
    hide_gone = {} if removed is None else {"gone": named.distinct()}
    store.commit(
        ({} if removed is None else {"gone": removed}) | {
            "docs": now, "chunks": made.unionByName(shifted), "edges": new_edges.unionByName(settled.join(again, "src", "left_semi")),
            "postings": listed.withColumnRenamed("id", "chunk_id"), "blocks": keyword.bounds(listed).withColumn("chunk_id", F.lit(None).cast("string")).unionByName(back), "lengths": entries.select(F.col("id").alias("chunk_id"), "dl"),
        },
        {"docs": gone.union(moved.select("doc_id")), "chunks": gone.union(turned), "edges": gone.union(again), "vectors": stale, "postings": stale, "lengths": stale} | hide_gone if version is not None else {},
        base=-1 if version is None else version, touched=gone.union(moved.select("doc_id")).union(again.withColumnRenamed("src", "doc_id")),
    )
    return summary


def embed_pending(store: Store, embedder: Embedder, model: str, dim: int, rebuild: bool = False) -> int:
    """Vectors for all chunks without one, in the recorded space; returns how many chunks failed."""
    version = store.current()
    meta = {r["key"]: r["value"] for r in store.read("meta", version).collect()}  # two rows
    reset = check_space(meta, model, dim, rebuild) == "reset"
    vectors, chunks = store.read("vectors", version), store.read("chunks", version)
    made = embed(chunks if reset else cdc.missing_vectors(chunks, vectors), embedder).persist()
    try:
        failed = made.where("embedding IS NULL").count()
        new = made.where("embedding IS NOT NULL").select("chunk_id", "embedding")
        recorded = store.spark.createDataFrame([("embedding_model", model), ("embedding_dim", str(dim))], "key string, value string")
        store.commit({"vectors": new, "meta": recorded}, {"meta": recorded.select("key")} | ({"vectors": vectors.select("chunk_id")} if reset else {}), base=version, touched=chunks.join(new, "chunk_id", "left_semi").select("doc_id"))
        return failed
    finally:
        made.unpersist()


def retrieve(
    questions: DataFrame, docs: DataFrame, chunks: DataFrame, edges: DataFrame, index_: keyword.Index, vectors: DataFrame | vector.PivotIndex | None, settings: Settings,
    *, allow_web: bool, top_k: int | None = None, grader: grading.Grader | None = None,
) -> DataFrame:
    """(qid, ord, id, score, source, distance): hybrid search for (qid, text, embedding) questions.

    Both arms see only rows that pass the gate; without vectors the keyword arm answers alone. With reranking on, a
    grader reorders more candidates than are returned; without one their fused order stands.
    Ids and scores travel through the plan; texts are joined by ``with_texts`` at the end.
    """
    visible = gate(allow_web)
    fts = keyword.search(questions, index_, chunks, settings.fts_top_k, visible=visible)
    vec = vector.search_or_nothing(questions.where("embedding IS NOT NULL"), vectors, chunks, settings.vec_top_k, visible=visible) if vectors is not None else None
    if vec is None:
        vec = fts.limit(0).select("qid", "rank", "id", F.lit(None).cast("double").alias("distance"))
    owner = chunks.select(F.col("chunk_id").alias("id"), "doc_id")
    fused = scratch.write(fusion.fuse(vec, fts, settings.fusion_top_k, owner, settings.max_per_doc))
    if settings.graph_enabled:
        expanded = fusion.expand(fused.join(owner, "id"), edges, docs, chunks, settings.graph_siblings, settings.graph_discount, visible=visible)
    else:
        expanded = fused.limit(0)
    k = settings.final_top_k if top_k is None else top_k
    near = fused.select("qid", "id", "distance")
    hits = fusion.merge(fused, expanded, max(settings.rerank_top_k, k) if settings.rerank else k, settings.graph_slots).join(near, ["qid", "id"], "left")
    if settings.rerank and grader is not None:
        hits = scratch.write(hits)
        graded = grading.rerank(questions, with_texts(hits, chunks, docs), grader, k)
        hits = graded.select("qid", F.col("new_ord").alias("ord"), F.col("chunk_id").alias("id"), "score", "source", "distance")
    return hits.where(F.col("ord") <= k).select("qid", "ord", "id", "score", "source", "distance")


def with_texts(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with the columns a reader needs; the hits are few and are broadcast if they are."""
    small = broadcast_if_small(hits.withColumnRenamed("id", "chunk_id"))
    rows = chunks.join(small, "chunk_id")
    return rows.join(docs.select("doc_id", "path", "title"), "doc_id")


class Engine:
    """A pinned snapshot of a store, and what can be asked of it."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        self.store, self.settings = Store(spark, root), settings or Settings()
        version = self.store.current()
        self.docs, self.chunks, self.vectors, self.edges = (self.store.read(t, version) for t in ("docs", "chunks", "vectors", "edges"))
        postings = self.store.read("postings", version).withColumnRenamed("chunk_id", "id")
        self.index = keyword.Index(postings, self.store.read("blocks", version), keyword.statistics(self.store.read("lengths", version)))

    def alive(self) -> bool:
        """Whether the cluster answers and the snapshot can be read."""
        return self.store.spark.range(1).count() == 1 and len(self.docs.columns) > 0

    def search(self, questions: DataFrame, *, allow_web: bool = False, k: int | None = None, grader: grading.Grader | None = None) -> DataFrame:
        asked = questions if "embedding" in questions.columns else questions.withColumn("embedding", F.lit(None).cast("array<float>"))
        vectors = self.vectors if "embedding" in questions.columns else None
        hits = retrieve(asked, self.docs, self.chunks, self.edges, self.index, vectors, self.settings, allow_web=allow_web, top_k=k, grader=grader)
        return with_texts(hits, self.chunks, self.docs)

    def answer_context(self, questions: DataFrame, *, allow_web: bool = True) -> DataFrame:
        """(qid, context) for a model; questions without hits are absent."""
        return context.assemble(self.search(questions, allow_web=allow_web), gate(allow_web))

    def ask(
        self, questions: DataFrame, generate: Callable[[str, str], str] | None = None, *, web: WebSearch | None = None, grader: grading.Grader | None = None, allow_web: bool = True, dry_run: bool = False
    ) -> DataFrame:
        """(qid, answer, generated): one answer for each question.

        Questions for which neither notes nor web give anything are answered ``SILENT`` without a call of the model. A dry run
        lists the hits instead of answering.
        """
        hits = scratch.write(self.search(questions, allow_web=allow_web, grader=grader))
        found = None
        if web is not None and allow_web and self.settings.web:
            thin = context.thin(questions, hits, self.settings.thin_hits, self.settings.thin_distance, allow_web).where("search_web")
            found = scratch.write(web_results(questions.join(thin.select("qid"), "qid", "left_semi"), web))
        if dry_run or generate is None:
            said = context.as_text(hits).select("qid", F.col("listing").alias("answer"), F.lit(False).alias("generated"))
        else:
            asked = context.messages(questions, context.assemble(hits, gate(allow_web)), None if found is None else context.web_context(found))
            said = answer(asked, generate).withColumn("generated", F.lit(True))
        rows = questions.select("qid").join(said, "qid", "left")
        return rows.select("qid", F.coalesce("answer", F.lit(SILENT)).alias("answer"), F.coalesce("generated", F.lit(False)).alias("generated"))

    def read(self, needle: str, *, allow_web: bool = False) -> DataFrame:
        found = graph.resolve_doc(self.docs, needle, visible=gate(allow_web))
        return graph.read_document(self.chunks, found, visible=gate(allow_web))

    def neighbors(self, needle: str, *, allow_web: bool = False) -> DataFrame:
        found = graph.resolve_doc(self.docs, needle, visible=gate(allow_web))
        return graph.neighbors(self.edges, self.docs, visible=gate(allow_web)).join(found.select("doc_id"), "doc_id", "left_semi")

    def topics(self, *, allow_web: bool = False) -> DataFrame:
        return graph.topics(self.edges, self.docs, visible=gate(allow_web))
