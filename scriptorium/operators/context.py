"""What is handed to a model or a reader: context, JSON, citations; and when to search the web."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ordered(order: str, value):
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


def guarded(hits: DataFrame, allowed: str | None) -> DataFrame:
    """hits, failing when run if a row's visibility is not the allowed one.

    The check is part of the body, which the context needs, so the optimizer cannot drop it.
    """
    if allowed is None:
        return hits
    bad = F.coalesce(F.col("sensitivity"), F.lit("")) != allowed
    return hits.withColumn("body", F.when(bad, F.raise_error(F.concat(F.lit("hidden row in context: "), F.col("chunk_id").cast("string")))).otherwise(F.col("body")))


def assemble(hits: DataFrame, allowed: str | None = None) -> DataFrame:
    """(qid, context): cited blocks in score order, from hits (qid, ord, chunk_id, path, title, heading_path, body, sensitivity)."""
    block = F.concat(F.lit("### "), _cited(), F.lit("\n"), F.col("body"))
    return guarded(hits, allowed).groupBy("qid").agg(F.array_join(_ordered("ord", block), "\n\n").alias("context"))


def _cited():
    """``[[path|title]]`` and the heading, if there is one, in brackets."""
    heading = F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit(" ("), "heading_path", F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("[["), F.col("path"), F.lit("|"), F.col("title"), F.lit("]]"), heading)


#: The fields of a hit for machines, in order; ``rank`` is its place.
FIELDS = ("score", "source", "path", "title", "heading_path", "doc_id", "chunk_id", "sensitivity")


def as_json(hits: DataFrame, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """(qid, hits): a JSON array of the hits in order; null fields are left out."""
    return hits.groupBy("qid").agg(F.to_json(_ordered("ord", F.struct(F.col("ord").alias("rank"), *columns))).alias("hits"))


def as_text(hits: DataFrame) -> DataFrame:
    """(qid, listing): how many hits, and a line for each with its score, source and citation."""
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("  ["), "source", F.lit("]"))).otherwise(F.lit(""))
    line = F.concat(F.lit("  "), F.format_string("%.6f", "score"), source, F.lit("  "), _cited())
    count = F.concat(F.count("*").cast("string"), F.lit(" hit(s):\n"))
    return hits.groupBy("qid").agg(F.concat(count, F.array_join(_ordered("ord", line), "\n")).alias("listing"))


def web_citation(url):
    """How a web result is cited: by its URL, never as a link between notes."""
    return F.trim(url)


WEB_HEADING = "## Web results: outside the collection, cited by address"

#: What every call of a model is told before its question.
RULES = (
    "Answer from the passages below.\n"
    "- Put the [[path|title]] of its passage, letter for letter, behind each statement taken from one; where several statements in a row rest on one passage, once is enough.\n"
    "- Statements from web results stand under a heading of their own and are cited by address, never in double brackets.\n"
    "- Where notes and web results contradict each other, report both.\n"
    "- If no passage bears on the question, answer only that the notes hold nothing about it.\n"
    "- Make up no source, note or quotation, and mark what you are unsure of."
)


def web_context(results: DataFrame) -> DataFrame:
    """(qid, web): a heading of its own and a block per result (qid, ord, title, url, snippet)."""
    block = F.concat(F.lit("### "), "title", F.lit("\n"), web_citation(F.col("url")), F.lit("\n"), "snippet")
    return results.groupBy("qid").agg(F.concat(F.lit(f"{WEB_HEADING}\n\n"), F.array_join(_ordered("ord", block), "\n\n")).alias("web"))


def messages(questions: DataFrame, contexts: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """(qid, system, message): the rules; the question and its context, then what the web gave. For questions that have either."""
    rows = questions.select("qid", "text").join(contexts, "qid", "left")
    rows = rows.join(web, "qid", "left") if web is not None else rows.withColumn("web", F.lit(None).cast("string"))
    body = F.concat(F.lit("Question: "), "text", F.lit("\n\nContext from the notes:\n\n"), F.coalesce("context", F.lit("")))
    rows = rows.where("context IS NOT NULL OR web IS NOT NULL")
    return rows.select("qid", F.lit(RULES).alias("system"), F.concat(body, F.when(F.col("web").isNotNull(), F.concat(F.lit("\n\n"), "web")).otherwise(F.lit(""))).alias("message"))


def thin(questions: DataFrame, hits: DataFrame, thin_hits: int, thin_distance: float, allow_web: bool = True, enabled: bool = True) -> DataFrame:
    """(qid, n_hits, min_distance, search_web): few hits, or the nearest one too far, call for the web."""
    stats = hits.groupBy("qid").agg(F.count("*").alias("n"), F.min("distance").alias("min_distance"))
    out = questions.select("qid").join(stats, "qid", "left").withColumn("n_hits", F.coalesce("n", F.lit(0)))
    want = F.when(F.lit(not (allow_web and enabled)), F.lit(False)).when(F.col("n_hits") < thin_hits, F.lit(True)).when(F.col("min_distance").isNull(), F.lit(False)).otherwise(F.col("min_distance") > thin_distance)
    return out.select("qid", "n_hits", "min_distance", want.alias("search_web"))


def last_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, question): the text of the last turn of role user."""
    rows = messages.where("role = 'user'")
    return rows.groupBy("conv_id").agg(F.max_by("content", F.struct("turn", "content")).alias("question"))
