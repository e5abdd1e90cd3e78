"""Reranking by grades: the prompts, an external grader, reading its replies, applying the grades."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

BODY_CHARS = 500
MOST = 3

#: What a grader is told once; its replies are lines of ``number: grade``, or ``none``.
INSTRUCTION = (
    "Below are a question and passages with numbers. Write one line, `number: grade`, for every passage that helps: "
    "3 where it holds the answer, 2 where it holds a part, 1 where it only mentions the matter. Leave out all others; write `none` if that leaves no line."
)

Grader = Callable[[str, str], str]


class RateLimited(RuntimeError):
    pass


def prompt_lines(hits: DataFrame) -> DataFrame:
    """(qid, ord, line) of hits (qid, ord, title, heading_path, body)."""
    body = F.substring(F.trim(F.regexp_replace("body", r"\s+", " ")), 1, BODY_CHARS)
    head = F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), F.col("title"), F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit(" > "), "heading_path")).otherwise(F.lit("")))
    return hits.select("qid", "ord", F.concat(head, F.lit("\n"), body).alias("line"))


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, n, prompt): the question, then its numbered candidates in order."""
    lines = prompt_lines(hits).groupBy("qid").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("lines"))
    listed = F.array_join(F.transform("lines", lambda s: s["line"]), "\n")
    return questions.select("qid", "text").join(lines, "qid").select("qid", "n", F.concat(F.lit("Question: "), "text", F.lit("\n\nCandidates:\n"), listed).alias("prompt"))


def parse_grades(reply: Column, n: Column) -> Column:
    """Grades of hits 1 to n, 0 where none is given; null if the reply cannot be trusted.

    ``label: grade`` pairs count anywhere in the reply. Refused: labels outside 1 to n, two grades for a
    label, grades that are not whole numbers from 0 to 3. Without pairs, ``none`` grades all 0, and a bare list counts
    if it has exactly n whole grades.
    """
    text = F.coalesce(reply, F.lit(""))
    # The grammar of replies.
    pair, number = F.lit(r"([0-9]+)\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(r"-?[0-9]+(?:\.[0-9]+)?")
    numbers = lambda a: F.transform(a, lambda x: x.try_cast("double"))
    labels, values = numbers(F.regexp_extract_all(text, pair, F.lit(1))), numbers(F.regexp_extract_all(text, pair, F.lit(2)))
    none = F.array_repeat(F.lit(0), n)
    whole = lambda v: v.isNotNull() & (v >= 0) & (v <= MOST) & (v == F.floor(v))

    def labelled(p: Column) -> Column:
        sound = F.forall(p, lambda x: x["label"].between(1, n) & whole(x["value"])) & (F.size(F.array_distinct(p)) == F.size(F.array_distinct(F.transform(p, lambda x: x["label"]))))
        given = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(F.filter(p, lambda x: x["label"] == i), F.lit(0))["value"], F.lit(0.0)).cast("int"))
        return F.when(sound, given)

    def bare(v: Column) -> Column:
        return F.when((F.size(v) == n) & F.forall(v, whole), F.transform(v, lambda x: x.cast("int")))

    def read(p: Column) -> Column:
        return F.when(F.size(p) > 0, labelled(p)).when(text.rlike(r"(?i)\A[^0-9a-z_]*none[^0-9a-z_]*\z"), none).otherwise(X.let(numbers(F.regexp_extract_all(text, number, F.lit(0))), bare))

    return F.when(n > 0, X.let(F.arrays_zip(labels.alias("label"), values.alias("value")), read))


def apply_grades(hits: DataFrame, grades: DataFrame, k: int | None = None) -> DataFrame:
    """hits (qid, ord, …) reordered by grades (qid, ord, grade); a question without any grade above 0 stays."""
    g = hits.join(grades.select("qid", "ord", "grade"), ["qid", "ord"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    g = g.withColumn("top", F.max("grade").over(Window.partitionBy("qid")))
    kept = g.where("top = 0 OR grade > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "ord")
    out = kept.withColumn("new_ord", F.row_number().over(w)).drop("top")
    return out if k is None else out.where(F.col("new_ord") <= k)


def _asked(grader: Grader, wait: float):
    def ask(prompt: str) -> str | None:
        for attempt in (1, 2):
            try:
                return grader(INSTRUCTION, prompt)
            except RateLimited:
                if attempt == 1:
                    time.sleep(wait)
            except Exception:
                logging.getLogger(__name__).warning("a grader failed", exc_info=True)
                return None
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"qid": df["qid"], "n": df["n"], "reply": [ask(p) for p in df["prompt"]]})

    return run


def rerank(questions: DataFrame, hits: DataFrame, grader: Grader, k: int | None = None, wait: float = 2.0) -> DataFrame:
    """hits (qid, ord, title, heading_path, body, …) with ``new_ord``, by the grades of an external grader.

    The grader is called once a question, where the question's row is; a rate limit is waited for once. Questions of one
    candidate are not asked about. Where a call fails or a reply cannot be read, the order stays.
    """
    asked = prompts(questions, hits).where("n >= 2").mapInPandas(_asked(grader, wait), f"qid {hits.schema['qid'].dataType.simpleString()}, n int, reply string")
    grades = asked.select("qid", F.posexplode(parse_grades(F.col("reply"), F.col("n"))).alias("at", "grade"))
    return apply_grades(hits, grades.select("qid", (F.col("at") + 1).alias("ord"), "grade"), k)
