"""Keyword search: an inverted index in blocks and BM25, for many questions at once.

The score is that of SQLite's full-text index: k1 = 1.2, b = 0.75, an idf floored at a millionth,
statistics over the whole table whatever the visibility filter lets through, negative so that smaller is
better. A term asked twice counts twice. An underscore separates terms, so ``foo_bar`` asks for
both terms, not for the phrase.

Index. Terms are counted within a row (sorted, then the lengths of runs), so counting moves nothing. Postings are written once, where
their texts were read, each part sorted by term; nothing is shuffled but the numbers of each term. A term's postings lie in blocks by the leading bits of a hash of their chunk, as many bits (the level) as make about ``BLOCK`` postings each; a block is known by
its number of postings, its largest tf and its least chunk length, which bound the score of all its postings whatever the average length is.

Search, in three steps that read blocks and not lists:

1. Floor. What the rarest terms of each question alone add up to, over at least ``LEAD`` times k postings if there are as many: the
   k-th of these sums is a floor that the k best must reach.
2. Candidates. Terms whose bounds together stay below a share (``PASSIVE``) of the floor cannot make a result by themselves, so if their lists are long they give no
   candidates (MaxScore). Of the other terms only blocks are read whose bound plus the best of all further terms reaches the floor: every chunk of a
   block left out misses it.
3. Scores. Chunks whose sum so far plus what the passive terms may add reaches the floor are looked up in the blocks of those terms that their hash
   names, and ranked.

What is joined and shuffled is thus bounded by the blocks that can matter, not by the postings of a stop word. Where more blocks are left than a broadcast
holds, each posting is judged by its own share, which never exceeds its block's bound. Postings are dealt by chunk before they meet the questions, so sums of a
chunk and the best of a task are made where its postings are: a posting moves once, pairs of questions and chunks never.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from .sizes import broadcast_if_small, is_small

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Asked terms up to which they are a filter of the scan, which skips row groups of postings sorted by term.
PUSHED = 1_000
#: Postings of a block, about.
BLOCK = 128
#: Postings of a question's rarest terms that give its floor, as a multiple of k.
LEAD = 20
#: A passive term's list is at least so many times as long as all lists that give candidates: looking up a chunk costs more than reading a posting.
LOOKED_UP = 3
#: The share of the floor that passive terms may make up: larger, and more chunks are looked up; smaller, and more postings are read.
PASSIVE = 0.3
#: What sums of other orders may differ by.
ROUNDING = 1e-6


@dataclass(frozen=True)
class Index:
    """postings (term, block, id, tf, dl), blocks (term, block, n, most_tf, least_dl; several rows of a block add up) and stats, one row (n, avgdl).

    terms: what is known of whole terms (term, nt, most_tf, least_dl, levels), so that blocks are counted only for terms of which some can be left out.
    """

    postings: DataFrame
    blocks: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None


#: A term and its repetitions, in the text of sorted terms.
_RUN = r"([^ ]+)(?: \1(?= |$))*"


def runs(terms: Column) -> Column:
    """The runs of equal terms among the sorted terms, each as text: ``a``, ``fox fox``, ``the``."""
    return F.regexp_extract_all(F.array_join(F.sort_array(terms), " "), F.lit(_RUN), F.lit(0))


def entries(chunks: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("prelude", "body")) -> DataFrame:
    """(id, dl, runs) of every chunk over the given text columns."""
    found = chunks.select(F.col(key).alias("id"), F.concat(*[X.terms(F.col(c)) for c in columns]).alias("terms"))
    return found.select("id", F.size("terms").cast("long").alias("dl"), runs(F.col("terms")).alias("runs"))


def postings(entries_: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of entries."""
    each = entries_.select("id", "dl", F.explode("runs").alias("run"))
    term, once = F.substring_index("run", " ", 1), F.locate(" ", F.col("run")) == 0  # Most terms occur once.
    tf = F.when(once, F.lit(1)).otherwise((F.length("run") + 1) / (F.length(term) + 1)).cast("long")
    return each.select(F.when(once, F.col("run")).otherwise(term).alias("term"), "id", tf.alias("tf"), "dl")


def _prefix(id_: Column, level: Column) -> Column:
    """The leading ``level`` bits of a chunk's hash, below the level: the block it lies in."""
    bits = F.shiftrightunsigned(F.xxhash64(id_.cast("string")), 32)
    return level * F.lit(1 << 32) + F.floor(bits / F.pow(F.lit(2.0), 32 - level)).cast("long")


def _level(nt: Column) -> Column:
    return F.greatest(F.ceil(F.log2(nt / BLOCK)), F.lit(0)).cast("long")


def blocked(rows: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(term, block, id, tf, dl) of postings: a term of n postings has the level that makes ``BLOCK`` of them a block. numbers: (term, nt), if they are counted already."""
    frequent = scratch.write(rows.groupBy("term").agg(F.count("*").alias("nt")).where(F.col("nt") > BLOCK)) if numbers is None else numbers.where(F.col("nt") > BLOCK).select("term", "nt")
    level = F.coalesce(_level(F.col("nt")), F.lit(0))
    return rows.join(broadcast_if_small(frequent), "term", "left").select("term", _prefix(F.col("id"), level).alias("block"), "id", "tf", "dl")


def bounds(rows: DataFrame) -> DataFrame:
    """What is known of each block of postings (term, block, tf, dl)."""
    return rows.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))


def statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build_index(chunks: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("prelude", "body")) -> Index:
    """An index in the scratch folder: the texts are read once. A store keeps its own."""
    texts, parallel = chunks.select(key, *columns), chunks.sparkSession.sparkContext.defaultParallelism
    if len(texts.inputFiles()) < parallel:
        # A few files may be as few tasks, for counting terms and for scoring later.
        texts = texts.repartition(parallel, key)
    # A posting of the empty term tells the length of every chunk, of those without terms too.
    rows = entries(texts, key, columns).withColumn("runs", F.concat("runs", F.array(F.lit(""))))
    made = scratch.write(postings(rows).sortWithinPartitions("term"))
    listed = made.where("term <> ''")
    known = listed.groupBy("term").agg(F.count("*").alias("nt"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
    terms = scratch.write(known).withColumn("levels", F.array(_level(F.col("nt"))))
    listed = blocked(listed, terms)
    return Index(listed, bounds(listed), scratch.write(statistics(made.where("term = ''"))), terms)


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _part(tf: Column, dl: Column) -> Column:
    """A posting's share of a score, for a weight of one; the largest tf and the least dl of several postings bound it."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _of_terms(rows: DataFrame, names: DataFrame, few: list[str] | None) -> DataFrame:
    """The rows of the terms ``names``, which are ``few`` if they can be a filter of the scan."""
    return rows.join(broadcast_if_small(names), "term", "left_semi") if few is None else rows.where(F.col("term").isin(few))


def _active(judged: DataFrame) -> DataFrame:
    """(qid, term, weight, avgdl, need) of the terms that give candidates: what a posting adds at least if its chunk reaches the floor."""
    return judged.where("NOT passive").select("qid", "term", "weight", "avgdl", (F.col("floor") + F.col("top") - F.col("all") - ROUNDING).alias("need"))


def _least(asked: DataFrame) -> DataFrame:
    """(term, least, avgdl) of (qid, term, weight, avgdl, need) rows: the least share, for a weight of one, that any question needs of a posting."""
    return asked.groupBy("term").agg(F.min(F.col("need") / F.col("weight")).alias("least"), F.first("avgdl").alias("avgdl"))


@dataclass(frozen=True)
class Search:
    """One batch of questions over an index: the steps above, each a table that can be looked at."""

    index: Index
    k: int
    #: (qid, term, weight, top, nt, levels, avgdl) and (term, block, most_tf, least_dl) of the asked terms, and the terms themselves if they are few.
    terms: DataFrame
    blocks: DataFrame
    few: list[str] | None
    only: DataFrame | None

    @classmethod
    def of(cls, questions: DataFrame, index: Index, k: int, only: DataFrame | None = None) -> Search:
        asked = scratch.write(question_terms(questions))
        names = asked.select("term").distinct()
        few = [r["term"] for r in names.limit(PUSHED + 1).collect()]
        few = few if len(few) <= PUSHED else None
        if index.terms is not None:
            blocks, of_term = _of_terms(index.blocks, names, few), _of_terms(index.terms, names, few)
        else:
            known = scratch.write(_of_terms(index.blocks, names, few).select("term", "block", "n", "most_tf", "least_dl"))
            # Rows without bounds only take back numbers.
            blocks = scratch.write(known.where("most_tf IS NOT NULL").groupBy("term", "block").agg(F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl")))
            of_term = known.groupBy("term").agg(F.sum("n").alias("nt"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"), F.collect_set(F.when(F.col("most_tf").isNotNull(), F.shiftright("block", 32))).alias("levels")).where("nt > 0")
        idf = F.log((F.col("n") - F.col("nt") + 0.5) / (F.col("nt") + 0.5))
        weight = F.col("qtf") * F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        rows = asked.join(of_term, "term").join(F.broadcast(index.stats)).withColumn("weight", weight)  # stats: one row
        terms = rows.select("qid", "term", "weight", (F.col("weight") * _part(F.col("most_tf"), F.col("least_dl"))).alias("top"), "nt", "levels", "avgdl")
        return cls(index, k, scratch.write(terms), blocks, few, None if only is None else scratch.write(only))

    def _postings(self) -> DataFrame:
        return _of_terms(self.index.postings, self.terms.select("term").distinct(), self.few)

    def _seen(self, rows: DataFrame) -> DataFrame:
        return rows if self.only is None else rows.join(broadcast_if_small(self.only), "id", "left_semi")

    def _added(self, found: DataFrame, terms: DataFrame) -> DataFrame:
        """(qid, id, added): what the given terms add to the scores of (qid, id) rows, from the blocks that hold them."""
        want = found.select("qid", "id").join(broadcast_if_small(terms.select("qid", "term", "weight", "levels", "avgdl")), "qid")
        want = want.select("qid", "id", "term", "weight", "avgdl", F.explode("levels").alias("level"))
        want = scratch.write(want.select("qid", "id", "term", "weight", "avgdl", _prefix(F.col("id"), F.col("level")).alias("block")))
        held = self._postings().join(broadcast_if_small(want.select("term", "block").distinct()), ["term", "block"], "left_semi")
        met = want.join(held, ["term", "block", "id"])
        return met.groupBy("qid", "id").agg(F.sum(F.col("weight") * _part(F.col("tf"), F.col("dl"))).alias("added"))

    def _scored(self, asked: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """(qid, id, part): sums over the postings of (qid, term, weight, avgdl, need) rows, without those that add less than ``need``.

        Before they move, postings are left out that add too little to every question, and, of terms with a need, those outside the blocks ``held``.
        """
        rows = self._postings().join(broadcast_if_small(_least(asked)), "term").where(_part(F.col("tf"), F.col("dl")) >= F.col("least"))
        if held is not None:
            rows = rows.where("least <= 0").union(rows.where("least > 0").join(F.broadcast(held), ["term", "block"], "left_semi").select(*rows.columns))
        rows = rows.select("term", "id", "tf", "dl")
        if is_small(asked):
            rows = rows.repartition("id")
        hit = self._seen(rows).join(broadcast_if_small(asked), "term").withColumn("added", F.col("weight") * _part(F.col("tf"), F.col("dl")))
        return hit.where("added >= need").groupBy("qid", "id").agg(F.sum("added").alias("part"))

    def floors(self) -> DataFrame:
        """(qid, floor): a score that the k-th best of each question reaches; questions with fewer candidates have none."""
        rarest = Window.partitionBy("qid").orderBy(F.desc("weight"), "term").rowsBetween(Window.unboundedPreceding, -1)
        lead = self.terms.withColumn("before", F.coalesce(F.sum("nt").over(rarest), F.lit(0))).where(F.col("before") < LEAD * self.k)
        lead = scratch.write(lead.select("qid", "term", "weight", "avgdl", F.lit(0.0).alias("need")))
        best = Window.partitionBy("qid").orderBy(F.desc("part"), "id")
        kth = self._scored(lead).withColumn("place", F.row_number().over(best)).where(F.col("place") == self.k)
        return scratch.write(kth.select("qid", (F.col("part") - ROUNDING).alias("floor")))

    def judged(self, floors: DataFrame) -> DataFrame:
        """The terms with their question's floor, whether they are passive, and what all terms and the passive ones may add."""
        every = Window.partitionBy("qid")
        upward = every.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        terms = self.terms.join(broadcast_if_small(floors), "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        terms = terms.withColumn("weak", F.sum("top").over(upward) < F.col("floor") * PASSIVE).withColumn("all", F.sum("top").over(every))
        active = F.coalesce(F.sum(F.when(~F.col("weak"), F.col("nt"))).over(every), F.lit(0))
        terms = terms.withColumn("passive", F.col("weak") & (F.col("nt") > LOOKED_UP * active))
        return terms.withColumn("rest", F.coalesce(F.sum(F.when(F.col("passive"), F.col("top"))).over(every), F.lit(0.0)))

    def chosen(self, judged: DataFrame) -> DataFrame:
        """(qid, term, block, weight, avgdl): the blocks that can hold a result."""
        rows = judged.where("NOT passive").join(self.blocks, "term")
        reach = F.col("weight") * _part(F.col("most_tf"), F.col("least_dl")) + F.col("all") - F.col("top")
        return rows.where(reach >= F.col("floor")).select("qid", "term", "block", "weight", "avgdl")

    def reaching(self, needed: DataFrame) -> DataFrame:
        """(term, block): of terms with a need (term, least, avgdl), the blocks that are chosen for any question."""
        rows = self.blocks.join(broadcast_if_small(needed), "term")
        return rows.where(_part(F.col("most_tf"), F.col("least_dl")) >= F.col("least")).select("term", "block")

    def results(self) -> DataFrame:
        """(qid, id, score): whole scores of all chunks that may be among the k best, larger is better."""
        judged = scratch.write(self.judged(self.floors()))
        ends = judged.select("qid", "floor", "rest").distinct()
        needed = scratch.write(_least(_active(judged)).where("least > 0"))
        held = None if needed.isEmpty() else scratch.write(self.reaching(needed))
        parts = self._scored(_active(judged), held if held is not None and is_small(held) else None).join(broadcast_if_small(ends), "qid")
        parts, passive = parts.where("part + rest >= floor").select("qid", "id", "part"), judged.where("passive")
        if passive.isEmpty():
            return parts.withColumnRenamed("part", "score")
        parts = scratch.write(parts)
        added = self._added(parts, passive)
        return parts.join(added, ["qid", "id"], "left").select("qid", "id", (F.col("part") + F.coalesce("added", F.lit(0.0))).alias("score"))


def bm25(questions: DataFrame, index: Index) -> DataFrame:
    """(qid, id, score) of every chunk that has a term of the question, exhaustively; smaller is better."""
    s = Search.of(questions, index, 1)
    scored = s._postings().join(broadcast_if_small(s.terms.select("qid", "term", "weight", "avgdl")), "term")
    return scored.groupBy("qid", "id").agg((-F.sum(F.col("weight") * _part(F.col("tf"), F.col("dl")))).alias("score"))


def search(questions: DataFrame, index: Index, chunks: DataFrame, k: int, *, visible: str | None, key: str = "chunk_id") -> DataFrame:
    """(qid, rank, id, score): the k best visible chunks of each question, ties by id.

    The filter stands below the limit. Scores are compared rounded to nine digits, so that equal
    texts tie whatever the order of summation.
    """
    seen = None if visible is None else chunks.where(X.visible(F.col("sensitivity"), visible)).select(F.col(key).alias("id"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9), "id")
    found = Search.of(questions, index, k, seen).results().withColumn("score", -F.col("score"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")
