"""Block-max search against exhaustive scores, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import keyword


@pytest.fixture(scope="module")
def corpus(spark):
    """4,000 chunks with a stop word in each, words of falling frequency, many equal texts, and visibility."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = ["the " + " ".join(rng.choices(words, weights, k=rng.randrange(3, 40))) for _ in range(3900)] + ["the w0 w7 rare"] * 100
    rows = [(i, t, "open" if i % 3 else "personal") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, body string, sensitivity string").repartition(3)
    return chunks, keyword.build_index(chunks, columns=("body",))


QUESTIONS = [(0, "the w0 w200 w250"), (1, "the the w1"), (2, "rare the"), (3, "w299 w0 w0 w120 absent"), (4, "absent"), (5, ""), (7, "w250 the"), (6, "the w0 w1 w2 w3 w4 w5 w250 w251 w252 w253")]


def test_results_are_those_of_exhaustive_scores(spark, corpus):
    chunks, index = corpus
    q = spark.createDataFrame(QUESTIONS, "qid long, text string")
    sensitivity = {r["chunk_id"]: r["sensitivity"] for r in chunks.select("chunk_id", "sensitivity").collect()}
    every = keyword.bm25(q, index).collect()
    for k, visible in ((5, None), (40, "open"), (5000, None)):
        want = {}
        for i, _ in QUESTIONS:
            best = sorted((round(r["score"], 9), r["id"]) for r in every if r["qid"] == i and (visible is None or sensitivity[r["id"]] == visible))[:k]
            want |= {(i, n + 1): (d, s) for n, (s, d) in enumerate(best)}
        got = {(r["qid"], r["rank"]): (r["id"], round(r["score"], 9)) for r in keyword.search(q, index, chunks, k, visible=visible).collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in want)


def test_blocks_that_cannot_reach_the_floor_are_not_read(spark, corpus):
    _, index = corpus
    blocks = {(r["term"], r["block"]): r["n"] for r in index.blocks.collect()}
    assert sum(blocks.values()) == index.postings.count() and max(blocks.values()) < 3 * keyword.BLOCK
    assert len([b for b in blocks if b[0] == "the"]) == 32 and len([b for b in blocks if b[0] == "rare"]) == 1
    q = spark.createDataFrame(QUESTIONS, "qid long, text string")
    search = keyword.Search.of(q, index, 5)
    read = search.chosen(search.judged(search.floors())).collect()
    asked = {i: {b for b in blocks if b[0] in text.split()} for i, text in QUESTIONS}
    # The stop word gives no candidates beside words that tell more (where other lists are as long, it is read).
    assert all(asked[i] for i in (0, 1, 2, 6, 7)) and not {r["qid"] for r in read if r["term"] == "the"} & {2, 7}
    for i, least in ((2, 0.9), (7, 0.9)):
        left_out = 1 - sum(blocks[r["term"], r["block"]] for r in read if r["qid"] == i) / sum(blocks[b] for b in asked[i])
        assert left_out > least


def test_a_block_may_be_known_in_parts(spark, corpus):
    """Rows of a block add up, as those of a store's segments do, and a block whose postings are all taken back is none."""
    chunks, index = corpus
    gone = index.postings.where("id % 2 = 0")
    parts = keyword.bounds(index.postings).union(keyword.bounds(gone).withColumn("n", -F.col("n")).withColumn("most_tf", F.lit(None)).withColumn("least_dl", F.lit(None)))
    left = keyword.Index(index.postings.where("id % 2 = 1"), parts, index.stats)
    whole = keyword.Index(left.postings, keyword.bounds(left.postings), index.stats)
    q = spark.createDataFrame(QUESTIONS, "qid long, text string")
    rows = [[(r["qid"], r["rank"], r["id"], round(r["score"], 8)) for r in keyword.search(q, i, chunks, 7, visible=None).orderBy("qid", "rank").collect()] for i in (left, whole)]
    assert rows[0] == rows[1] != []


def test_pairs_of_questions_and_chunks_do_not_move(spark, corpus):
    """Postings are dealt by chunk before they meet the questions, and the index's own are written where they are read."""
    import re

    _, index = corpus
    # No passive terms here, whose look-ups are joined by question and chunk.
    search = keyword.Search.of(spark.createDataFrame([(0, "w100 w101"), (1, "w200")], "qid long, text string"), index, 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan(search.results()))
    dealt = [re.findall(r"(\w+)#", e) for e in exchanges]
    assert ["id"] in dealt and ["qid", "id"] not in dealt
    # Chunks without terms have a length too.
    made = keyword.build_index(spark.createDataFrame([(1, "a b a"), (2, "c"), (3, ""), (4, None)], "chunk_id long, body string"), columns=("body",))
    assert made.stats.first() == (4, 1.0) and made.postings.where("term = ''").count() == 0
    numbers = {r["term"]: (r["nt"], r["most_tf"], r["least_dl"]) for r in index.terms.collect()}
    counted = index.blocks.groupBy("term").agg(F.sum("n"), F.max("most_tf"), F.min("least_dl")).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in counted} == numbers


def test_a_kept_index_reads_documents_alone(spark, sf):
    from scriptorium import catalog

    files = catalog._index(spark, sf).postings.inputFiles() + catalog._index(spark, sf).stats.inputFiles()
    assert files and catalog._index(spark, sf).stats.first()["n"] == spark.read.parquet(f"{sf}/documents.parquet").count()
