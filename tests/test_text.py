import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import chunking, links


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_frontmatter(spark):
    cases = ["---\ntitle: A\ntags: [x, 3]\n---\nbody", "no", "---\nopen", "---\n: [\n---\nb", "---\n- a\n---\nb", "---\n---\nb", "---\ndate: 2024-01-02\n---\n"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, md string")
    out = rows.select("i", X.frontmatter_block(F.col("md")).alias("b"), X.strip_frontmatter(F.col("md")).alias("s")).withColumn("j", X.frontmatter_json("b")).orderBy("i").collect()
    assert [r["s"] for r in out] == ["body", "no", "---\nopen", "b", "b", "---\n---\nb", ""]
    assert [r["j"] for r in out] == ['{"title": "A", "tags": ["x", 3]}', "{}", "{}", "{}", "{}", "{}", '{"date": "2024-01-02"}']


def test_tags(spark):
    rows = [('{"tags": ["a", "", "b"]}',), ('{"tags": "one"}',), ("{}",), ('{"tags": 3}',), ('{"tags": ["x", 3]}',)]
    assert values(spark, X.tags(F.col("f")), rows, "f string") == [["a", "b"], ["one"], [], [], ["x", "3"]]


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.*?[]!-^x", max_size=8), st.text("ab/.x-^", max_size=8))
def test_globs_read_as_fnmatch_does(pattern, path):
    import re

    rx = X.glob_regex(pattern).replace("\\z", "\\Z")
    try:
        compiled = re.compile(rx)
    except re.error:
        return  # a reversed range, which the one refuses and the other never matches
    if "--" not in pattern:
        assert bool(compiled.match(path)) == fnmatch.fnmatchcase(path, pattern)


def test_sensitivity(spark):
    rows = [("Tastings/x.md", None), ("tastings/x.md", None), ("Tastings/x.md", "open"), ("a/b.md", "personal"), ("a/b.md", "secret")]
    assert values(spark, X.sensitivity(F.col("p"), F.col("o"), ("Tastings/*",)), rows, "p string, o string") == ["personal", "open", "open", "personal", "open"]


def test_fold_and_terms(spark):
    assert values(spark, X.terms(F.col("t")), [("Übung foo_bar, ça 3",), (None,)], "t string") == [["ubung", "foo", "bar", "ca", "3"], []]
    assert values(spark, X.fts_query(F.col("t")), [("a-b OR c",), ("  ",)], "t string") == ['"a" OR "b" OR "OR" OR "c"', ""]


def test_sections_and_breadcrumbs(spark):
    body = "intro\n## A\nx\n### B\ny\n## C\n### D\nz\n# H1\nmore"
    orphan = "### A\none\n### B\ntwo"
    rows = chunking.sections(spark.createDataFrame([("d", body), ("o", orphan), ("e", "")], "doc_id string, body string"))
    got = [(r["doc_id"], r["heading_path"], r["text"]) for r in rows.orderBy("doc_id", "pos").collect()]
    assert got == [("d", "", "intro"), ("d", "A", "x"), ("d", "A > B", "y"), ("d", "C > D", "z\n# H1\nmore"), ("o", "A", "one"), ("o", "A > B", "two")]


def test_runts_join_the_section_before(spark):
    rows = [("d", 0, "A", "w " * 90), ("d", 1, "B", "short"), ("e", 0, "C", "short"), ("e", 1, "D", "w " * 85)]
    got = chunking.merge_runts(spark.createDataFrame(rows, "doc_id string, pos int, heading_path string, text string")).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["heading_path"]) for r in got] == [("d", "A"), ("e", "C"), ("e", "D")]
    assert got[0]["text"].endswith("\n\nshort")


def test_hard_split_loses_nothing(spark):
    paragraphs = [f"p{i} " + "w " * 8 + "w" for i in range(40)]
    big = " ".join(f"b{i}" for i in range(25))
    mixed = ["a b", "c d e", "", big, "f", "g h i j k l m", "n"]
    rows = [("\n\n".join(paragraphs),), ("w " * 200,), ("\n\n".join(mixed),), ("few\n\nwords",), (None,), ("",)]
    packs, cut, last, whole, none, empty = values(spark, X.hard_split(100, 150)(F.col("t")), rows, "t string")
    assert packs == ["\n\n".join(paragraphs[i : i + 10]) for i in range(0, 40, 10)]
    assert [len(p.split()) for p in cut] == [150, 50] and whole == ["few\n\nwords"] and none == [] and empty == [""]
    assert values(spark, X.hard_split(5, 10)(F.col("t")), rows[2:3], "t string")[0] == ["a b\n\nc d e", " ".join(big.split()[:10]), " ".join(big.split()[10:20]), " ".join(big.split()[20:]), "f", "g h i j k l m", "n"]


def test_links(spark):
    text = "[[a]] [[b|alias]] [[ ]] <!-- begin:clippings -->[[c]]<!-- end:clippings --> [[d]]"
    assert values(spark, links.wikilinks(F.col("t")), [(text,), (None,)], "t string") == [["a", "b", "c", "d"], []]
    assert values(spark, links.topic_links(F.col("t")), [(text,)], "t string") == [["c"]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("x/a.md", "x/a.md", "Alpha"), ("y/b.md", "y/b.md", "Dup"), ("z/c.md", "z/c.md", "Dup")], "doc_id string, path string, title string")


def test_resolution(spark, docs):
    t = spark.createDataFrame([("s", t) for t in ("X/A", " x/a.md ", "alpha", "a", "dup", "none")], "src string, target string")
    got = {r["target"]: (r["dst"], r["resolved"]) for r in links.resolve(t, docs).collect()}
    assert got == {"X/A": ("x/a.md", True), " x/a.md ": ("x/a.md", True), "alpha": ("x/a.md", True), "a": ("x/a.md", True), "dup": ("dup", False), "none": ("none", False)}
    twice = docs.union(spark.createDataFrame([("x/a.md.md", "x/a.md.md", None)], docs.schema))
    assert {r["dst"] for r in links.resolve(t.where("target LIKE '%x/a.md%'"), twice).collect()} == {"x/a.md"}


def test_edges_are_distinct_and_pending_ones_resolve_later(spark, docs):
    notes = spark.createDataFrame([("n.md", "[[alpha]] [[alpha]] [[later]] <!-- begin:clippings -->[[b]]<!-- end:clippings -->", '{"tags": ["t"]}')], "doc_id string, markdown string, frontmatter string")
    e = links.edges(notes, docs)
    got = {(r["dst"], r["kind"], r["resolved"]) for r in e.collect()}
    assert got == {("x/a.md", "wikilink", True), ("later", "wikilink", False), ("y/b.md", "topic", True), ("y/b.md", "wikilink", True), ("tag:t", "tag", False)}
    more = docs.union(spark.createDataFrame([("q/later.md", "q/later.md", "L")], docs.schema))
    assert ("q/later.md", "wikilink", True) in {(r["dst"], r["kind"], r["resolved"]) for r in links.resolve_pending(e, more).collect()}
