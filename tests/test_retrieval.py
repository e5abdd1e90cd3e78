import sqlite3

from pyspark.sql import functions as F

from scriptorium.operators import context, fusion, grading, graph, keyword, vector


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, ordinal int, prelude string, body string, sensitivity string")


def test_bm25_equals_sqlite(spark):
    texts = [("a", "Title", "red fox red"), ("b", "Other", "a fox jumps over the dog"), ("c", "Red", "nothing here"), ("d", "x", "the the the dog fox Übung")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, prelude, body, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", texts)
    c = chunks(spark, [(i, i, 0, p, b, "open") for i, p, b in texts])
    q = spark.createDataFrame([(0, "red fox"), (1, "ubung dog the"), (2, "...")], "qid long, text string")
    got = {(r["qid"], r["id"]): r["score"] for r in keyword.bm25(q, keyword.build_index(c)).collect()}
    for qid, match in ((0, '"red" OR "fox"'), (1, '"ubung" OR "dog" OR "the"')):
        want = dict(db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        mine = {i: s for (k, i), s in got.items() if k == qid}
        assert mine.keys() == want.keys() and all(abs(mine[i] - want[i]) < 1e-12 for i in want)
    assert not [k for k in got if k[0] == 2]


def test_the_filter_stands_before_the_limit(spark):
    rows = [(f"h{i}", f"h{i}", 0, "", "fox " * 9, "personal") for i in range(10)] + [(f"v{i}", f"v{i}", 0, "", "fox and more words", "open") for i in range(3)]
    c = chunks(spark, rows)
    q = spark.createDataFrame([(0, "fox")], "qid long, text string")
    got = keyword.search(q, keyword.build_index(c), c, 5, visible="open").collect()
    assert [r["id"] for r in got] == ["v0", "v1", "v2"]
    v = spark.createDataFrame([(f"h{i}", [0.0, 0.1 * i]) for i in range(10)] + [(f"v{i}", [5.0, float(i)]) for i in range(3)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, embedding array<float>")
    near = vector.search(asked, v, c, 5, visible="open").orderBy("rank").collect()
    assert [r["id"] for r in near] == ["v0", "v1", "v2"] and near[0]["distance"] == 5.0
    assert vector.search_or_nothing(asked, v.drop("embedding"), c, 5, visible=None) is None


def ranked(spark, ids, **more):
    return spark.createDataFrame([(0, i + 1, x, 0.1 * i) for i, x in enumerate(ids)], "qid long, rank int, id string, distance double")


def test_fusion_and_cap(spark):
    vec, fts = ranked(spark, ["b", "a"]), ranked(spark, ["c", "a"]).drop("distance")
    got = fusion.fuse(vec, fts, 10).orderBy("ord").collect()
    assert [(r["id"], r["source"]) for r in got] == [("a", "vector+fts"), ("b", "vector"), ("c", "fts")]
    vec = ranked(spark, ["a1", "a2", "a3", "b1", "c1"])
    cap = spark.createDataFrame([(x, x[0]) for x in ("a1", "a2", "a3", "b1", "c1")], "id string, doc_id string")
    got = fusion.fuse(vec, fts.limit(0), 4, cap, 2).orderBy("ord").collect()
    assert [r["id"] for r in got] == ["a1", "a2", "b1", "c1"]


def expanded(spark, hits, edges, docs, slots, visible=None):
    h = spark.createDataFrame(hits, "qid long, ord int, doc_id string, score double")
    e = spark.createDataFrame([(s, d, "topic", True) for s, d in edges], "src string, dst string, kind string, resolved boolean")
    d = spark.createDataFrame(docs, "doc_id string, sensitivity string")
    c = d.select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", F.lit(0).alias("ordinal"), "sensitivity")
    return [(r["doc_id"], round(r["score"], 3)) for r in fusion.expand(h, e, d, c, slots, 0.5, visible=visible).orderBy("ord").collect()]


def test_expansion(spark):
    docs = [(x, "open") for x in ("hub", "hit", "sib", "far", "x1", "x2")]
    edges = [("hub", "hit"), ("hub", "sib"), ("far", "sib")]
    assert expanded(spark, [(0, 1, "hit", 1.0)], edges, docs, 5) == [("hub", 0.5), ("sib", 0.5)]
    assert expanded(spark, [(0, 1, "hit", 1.0)], edges, docs, 0) == [("hub", 0.5)]
    assert expanded(spark, [(0, 1, "hit", 1.0), (0, 2, "sib", 0.5)], edges, docs, 5) == [("hub", 0.5), ("far", 0.25)]
    hidden = [("hub", "personal"), ("hit", "open"), ("sib", "open")]
    assert expanded(spark, [(0, 1, "hit", 1.0)], edges[:2], hidden, 5, "open") == []
    # Hidden members take no slot; present ones do.
    many = [("hub", "open"), ("hit", "open"), ("a", "personal"), ("b", "open"), ("c", "open")]
    e = [("hub", x) for x in ("hit", "a", "b", "c")]
    assert expanded(spark, [(0, 1, "hit", 1.0)], e, many, 1, "open") == [("hub", 0.5), ("b", 0.5)]
    assert expanded(spark, [(0, 1, "hit", 1.0), (0, 2, "b", 0.9)], e, many, 1, "open") == [("hub", 0.5), ("c", 0.45)]


def merged(spark, direct, graph_rows, k, slots):
    f = spark.createDataFrame([(0, i + 1, f"d{i}", s, "fts") for i, s in enumerate(direct)], "qid long, ord int, id string, score double, source string")
    g = spark.createDataFrame([(0, i + 1, f"g{i}", s) for i, s in enumerate(graph_rows)], "qid long, ord int, id string, score double")
    return [r["id"] for r in fusion.merge(f, g, k, slots).orderBy("ord").collect()]


def test_quota(spark):
    assert sorted(merged(spark, [0.1] * 8, [0.9] * 6, 8, 2)) == [*(f"d{i}" for i in range(6)), "g0", "g1"]
    assert len(merged(spark, [0.1], [0.9] * 6, 8, 2)) == 7
    assert merged(spark, [0.3, 0.2, 0.1], [0.9], 8, 0) == ["d0", "d1", "d2"]


def test_grades(spark):
    good = [
        ("1: 3\n3: 1", 3, [3, 0, 1]), ("3 = 2\n1: 3 \n2 : 0", 3, [3, 0, 2]), ("```\n2: 2\n1: 0\n```", 2, [0, 2]), ("1: 2.0", 2, [2, 0]), ("1: 2\n1: 2.0", 2, [2, 0]),
        ("none", 2, [0, 0]), ("**None**.", 2, [0, 0]), ("- none", 1, [0]), ("3 1 0", 3, [3, 1, 0]), ("1.0, 0.0, 3.0", 3, [1, 0, 3]), ("[3, 0, 2]", 3, [3, 0, 2]), ("3 of 1: 1", 2, [1, 0]),
    ]
    bad = ["0: 1", "4: 1", "1: 1.5", "1: 9", "1: -1", "1: 2\n1: 3", "99999999999999999999: 1", "3 1", "", None, "nonesuch", "none of 3", "1 2 3.5", "-1 1 2", "[1, 2, 9]", '["a","b"]', "1: 3\n2: 1 4: x5: 1"]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(good)] + [(100 + i, t, 3) for i, t in enumerate(bad)], "i int, reply string, n int")
    got = {r["i"]: r["g"] for r in rows.select("i", grading.parse_grades(F.col("reply"), F.col("n")).alias("g")).collect()}
    assert [got[i] for i in range(len(good))] == [g for *_, g in good]
    assert [t for i, t in enumerate(bad) if got[100 + i] is not None] == []
    hits = spark.createDataFrame([(0, i, x) for i, x in enumerate("abcd", 1)] + [(1, 1, "z")], "qid long, ord int, id string")
    g = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (0, 3, 3), (0, 4, 1)], "qid long, ord int, grade int")
    got = grading.apply_grades(hits, g).orderBy("qid", "new_ord").collect()
    assert [r["id"] for r in got] == ["c", "a", "d", "z"]


def test_reranking_asks_once_a_question(spark):
    rows = [(q, i, x, None if i < 3 else "part", f" {x}\n {x} ") for q in (0, 1, 2, 3) for i, x in enumerate("abc", 1)] + [(4, 1, "a", None, "a")]
    hits = spark.createDataFrame(rows, "qid long, ord int, title string, heading_path string, body string")
    q = spark.createDataFrame([(i, f"ask {i}") for i in range(5)], "qid long, text string")
    asked = {r["qid"]: r["prompt"] for r in grading.prompts(q, hits).collect()}
    assert asked[1] == "Question: ask 1\n\nCandidates:\n[1] a\na a\n[2] b\nb b\n[3] c > part\nc c"

    def grader(instruction, prompt):
        which = int(prompt.split("\n")[0][-1])
        if which == 2:
            raise ValueError("down")
        if which == 4:
            raise AssertionError("one candidate")
        return ("1: 1\n3: 2", "what?", "", "none")[which]

    got = {}
    for r in grading.rerank(q, hits, grader).orderBy("qid", "new_ord").collect():
        got.setdefault(r["qid"], []).append(r["title"])
    assert got == {0: ["c", "a"], 1: ["a", "b", "c"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a"]}
    tries = []

    def limited(instruction, prompt):
        tries.append(1)
        raise grading.RateLimited

    run = grading._asked(limited, 0.0)
    import pandas as pd

    assert next(run(iter([pd.DataFrame({"qid": [0], "n": [2], "prompt": ["x"]})])))["reply"].tolist() == [None] and len(tries) == 2


def test_web_trigger(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "qid long")
    hits = spark.createDataFrame([(1, 0.5)] * 3 + [(2, 1.5)] * 3 + [(3, None)] * 3, "qid long, distance double")
    got = {r["qid"]: r["search_web"] for r in context.thin(q, hits, 3, 1.0).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}
    assert not any(r["search_web"] for r in context.thin(q, hits, 3, 1.0, allow_web=False).collect())


def test_context_refuses_hidden_rows(spark):
    import pytest

    hits = spark.createDataFrame([(0, 1, "c", "p.md", "t", "b", "open", None), (0, 2, "d", "q.md", "t", "hidden", "personal", "H")], "qid long, ord int, chunk_id string, path string, title string, body string, sensitivity string, heading_path string")
    assert context.assemble(hits).first()["context"] == "### [[p.md|t]]\nb\n\n### [[q.md|t]] (H)\nhidden"
    with pytest.raises(Exception, match="hidden row"):
        context.assemble(hits, "open").collect()


def test_a_vector_of_another_space_leaves_the_arm_out(spark):
    c = chunks(spark, [("a", "a", 0, "", "x", "open"), ("b", "b", 0, "", "x", "open")])
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    assert vector.search_or_nothing(asked, v, c, 5, visible=None) is None
    assert [r["id"] for r in vector.search(asked, v, c, 5, visible=None).collect()] == ["a"]
    assert vector.search_or_nothing(asked, v.where("chunk_id = 'a'"), c, 5, visible=None).count() == 1


def plain_nearest(vectors, q, k):
    """The k nearest of {id: vector} by nine decimals of the distance, ties to the smaller id."""
    import math

    return sorted((round(math.dist(v, q), 9), i) for i, v in vectors.items() if len(v) == len(q))[:k]


def test_nearest_in_a_block():
    """Ties go to the smaller id; strings and numbers are ids; limits hold."""
    import numpy as np

    rng = np.random.default_rng(2)
    x, q = rng.integers(0, 4, (500, 3)).astype(float), rng.integers(0, 4, (70, 3)).astype(float)
    for ids in (rng.permutation(500), np.array([f"c{i:03}" for i in rng.permutation(500)])):
        rows = dict(zip(ids.tolist(), x.tolist()))
        for limit in (np.inf, 1.0):
            got = vector.nearest_in(x, ids, np.arange(70), q, np.full(70, limit), 5)
            for k in range(70):
                mine = got[got["qid"] == k]
                assert list(zip(mine["distance"].round(9), mine["id"])) == [p for p in plain_nearest(rows, q[k], 5) if p[0] <= limit]


def test_pivots_change_no_row_and_spare_vectors(spark):
    """Clusters, a third of all vectors in one, copies, ties, two lengths, and vectors that take no part."""
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (12, 8))
    x = [centres[0 if i % 3 == 0 else i % 12] + rng.normal(0, 0.5, 8) for i in range(1500)]
    rows = {f"v{i:04}": [float(c) for c in v] for i, v in enumerate(x)}
    rows |= {f"w{i:04}": rows["v0000"] for i in range(150)} | {f"s{i}": [float(i % 3), 1.0] for i in range(20)}
    odd = [("o1", None), ("o2", []), ("o3", [1.0, None]), ("o4", [float("nan")] * 8), ("o5", [float("inf"), 0.0]), (None, [0.0] * 8)]
    v = spark.createDataFrame([*rows.items(), *odd], "chunk_id string, embedding array<double>").repartition(5)
    c = spark.createDataFrame([(i, "personal" if i and i.endswith("7") else "open") for i in [*rows, *(o[0] for o in odd)]], "chunk_id string, sensitivity string")
    questions = [(i, rows[f"v{37 * i:04}"]) for i in range(30)] + [(30, [0.0] * 8), (31, [1.0, 1.0]), (32, [5.0]), (33, None), (34, [float("nan")] * 8), (35, [])]
    asked = spark.createDataFrame(questions, "qid long, embedding array<double>")
    for visible, seen in ((None, rows), ("open", {i: e for i, e in rows.items() if not i.endswith("7")})):
        got = {}
        index = vector.build_index(v, c, visible=visible, block=32)
        for r in vector.nearest(asked, index, 7).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((round(r["distance"], 9), r["id"]))
        assert got == {k: near for k, q in questions if q and q[0] == q[0] and (near := plain_nearest(seen, q, 7))}
    index = vector.build_index(v, c, visible=None, block=32)
    assert sorted(i for r in index.blocks.select("ids").collect() for i in r[0]) == sorted(rows) and index.blocks.where("n > 32 OR n <> size(ids) OR low > high").isEmpty()
    share = {r["qid"]: (r["n_scored"], r["n_vectors"]) for r in vector.scored(asked.where("qid < 32"), index, 7).collect()}
    # Questions of the large cluster may need all of it; no other needs more than a fifth of the table.
    assert all(n == 1650 for k, (_, n) in share.items() if k < 31) and share[31][1] == 20
    assert all(share[k][0] <= 1650 * 0.2 for k in range(30) if (37 * k) % 3) and sum(s for k, (s, _) in share.items() if k < 30) < 30 * 1650 * 0.3


def test_nearest_of_nothing(spark):
    v = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    c = spark.createDataFrame([], "chunk_id long, sensitivity string")
    asked = spark.createDataFrame([(0, [1.0])], "qid long, embedding array<float>")
    assert vector.search(asked, v, c, 3, visible=None).isEmpty()
    v, c = spark.createDataFrame([(1, [1.0])], v.schema), spark.createDataFrame([(1, "open")], c.schema)
    assert vector.search(asked.limit(0), v, c, 3, visible=None).isEmpty() and vector.search(asked, v, c, 3, visible=None).count() == 1


def test_document_tools(spark):
    docs = spark.createDataFrame([("a/x.md", "A/X.md", "Ex", "open"), ("b/x.md", "B/x.md", "Ex", "open"), ("c/y.md", "c/y.md", "Why", "personal")], "doc_id string, path string, title string, sensitivity string")
    name = lambda n, v=None: sorted(r["doc_id"] for r in graph.resolve_doc(docs, n, visible=v).collect())
    assert name("A/X") == ["a/x.md"] and name("ex") == ["a/x.md", "b/x.md"] and name("why") == ["c/y.md"] and name("why", "open") == [] == name("nope", "open")
    needles = spark.createDataFrame([(n,) for n in ("A/X", "ex", "why", "nope", "x.md", "y", "ex", None)], "needle string")
    got = {r["needle"]: (r["n"], r["doc_id"]) for r in graph.resolve_docs(needles, docs, visible="open").collect()}
    assert got == {"A/X": (1, "a/x.md"), "ex": (2, "a/x.md"), "why": (0, None), "nope": (0, None), "x.md": (2, "a/x.md"), "y": (0, None), None: (0, None)}
    c = spark.createDataFrame([("a/x.md", 0, "", "one", "open"), ("a/x.md", 1, "H", "two", "open"), ("a/x.md", 2, "H", "three", "open")], "doc_id string, ordinal int, heading_path string, body string, sensitivity string")
    got = graph.read_document(c, docs.where("doc_id = 'a/x.md'"), visible=None).first()["text"]
    assert got == "# Ex\n[[A/X.md]]\n\none\n\n## H\n\ntwo\n\nthree"


def test_more_questions_than_a_block(spark, monkeypatch):
    from scriptorium.operators import vector

    monkeypatch.setattr(vector, "QUESTIONS", 3)
    vectors = spark.createDataFrame([(f"c{i}", [float(i), 0.0]) for i in range(10)], "chunk_id string, embedding array<float>")
    chunks = spark.createDataFrame([(f"c{i}", "open") for i in range(10)], "chunk_id string, sensitivity string")
    asked = spark.createDataFrame([(i, [float(i) + 0.1, 0.0]) for i in range(8)], "qid long, embedding array<float>")
    got = vector.search_or_nothing(asked, vectors, chunks, 1, visible=None)
    assert got is not None and sorted((r["qid"], r["id"]) for r in got.collect()) == [(i, f"c{i}") for i in range(8)]
