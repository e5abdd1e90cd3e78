"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio, natively in Spark.

Words and adjacent word pairs are hashed into 2**16 buckets. Bucket counts over all documents
(raw) and over the documents labelled quality 1 (target) give two smoothed multinomials; a
document's score is the sum of log(target / raw) over its n-grams, divided by their number. It is
kept if no base rule fails and its score reaches a fixed threshold. Every document is counted
and judged; the weights, one number for each bucket, are a scalar subquery of the plan.

Edge cases: null and empty texts have no words, fail the base rules and score 0; a repeated row
is judged (and counted) each time; without labels, or without any target document that is
present, every score is 0, so the base rules alone decide; an empty table gives no rows.
Rows with null ids are counted and judged like others, but are no target; labels with null ids count not at all, repeated ones once.
Very long texts are read whole. A score that equals the threshold is kept, so ties share a verdict. Extra columns stay
and change nothing, but for one named ``rules``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, table, unused, words

BUCKETS = 1 << 16
#: Raw occurrences that a bucket is credited with on both sides, so that rare n-grams tell little.
SMOOTHING = 30.0
LEAST_SCORE = -0.2
#: Ids of the target that may be broadcast: longs, so 100 MB or less.
MOST_TRUSTED = 4_000_000
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(a: Column, step: int) -> Column:
    """Hashes of elements and their step-th successors."""
    return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + step)))


def _hashes(text: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body(words, their hashes, hashes of adjacent pairs)."""
    return let(words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(_joined(h, 1), lambda p: body(w, h, p))))


def _covered(windows: Column) -> Column:
    """Words in windows that occur at least twice, from the hashes of all windows in order."""

    def count(d: Column) -> Column:
        again = F.filter(d, lambda x, k: (F.get(d, k - 1)["h"] == x["h"]) | (F.get(d, k + 1)["h"] == x["h"]))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        gaps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(repeated, let(ordered, count)).otherwise(F.lit(0)).cast("long")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, one column: the array of the buckets' log ratios. trusted: the doc_ids of the target."""
    ids = broadcast_if_small(trusted.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("target", F.lit(1)), MOST_TRUSTED)
    grams = _hashes(F.col("text"), lambda w, h, p: F.transform(F.concat(h, p), _bucket))
    each = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("target", F.explode(grams).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    packed = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    log_ratio = F.transform("c", lambda x: F.log((x["target"] * F.col("r") / F.col("t") + SMOOTHING) / (x["raw"] + SMOOTHING)))
    return packed.select(F.when(F.col("t") > 0, log_ratio).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("weights"))


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs' columns and a struct ``rules`` of the statistics, the score and the verdict."""
    weight, judged = unused("weights", docs.columns), unused("judged", docs.columns)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, h: s + F.get(F.col(weight), _bucket(h)))

    def of(w: Column, h: Column, p: Column) -> Column:
        n_grams = F.size(h) + F.size(p)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(_joined(p, 2), lambda q: let(_joined(q, 4), _covered)).alias("n_repeat_words"),
            F.when(n_grams > 0, (total(h) + total(p)) / n_grams).otherwise(F.lit(0.0)).alias("score"),
        )

    lines = let(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    s = F.col(judged)
    failed = (s["n_words"] < LEAST_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MOST_REPEATED)
    rules = F.struct(
        s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (s["score"] >= LEAST_SCORE)).alias("kept"), s["score"].alias("score"),
    )
    # A generator of one row: filters on the verdict stay above it, so a text is judged once.
    once = F.explode(F.array(_hashes(F.col("text"), of)))
    return docs.withColumn(weight, weights(docs, trusted).scalar()).withColumn(judged, once).withColumn("rules", rules).drop(judged, weight)


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir)).select("doc_id", "rules.*")
