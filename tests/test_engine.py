import pytest
from pyspark.sql import functions as F

from scriptorium import settings
from scriptorium.operators import cdc, context
from scriptorium.plans import engine
from scriptorium.settings import Settings
from scriptorium.sources import external, listing
from scriptorium.sources import store as store_module
from scriptorium.sources.store import Conflict, Store

NOTE = "doc_id string, path string, rev string, mtime long, markdown string"


def notes(spark, rows):
    return spark.createDataFrame([(p.lower(), p, rev, 1, md) for p, rev, md in rows], NOTE)


def classes(df):
    return {r["doc_id"]: r["class"] for r in df.collect()}


def test_classes(spark):
    h = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([("same", "1", h("a")), ("rev", "1", h("a")), ("both", "1", h("a")), ("gone", "1", h("a")), ("torn", "1", h("a"))], "doc_id string, rev string, content_hash string")
    new = spark.createDataFrame([("same", "1", "changed unseen"), ("rev", "2", "a"), ("both", "2", "b"), ("new", "1", "n"), ("torn", "2", None), ("torn2", "1", None)], "doc_id string, rev string, markdown string")
    assert classes(cdc.classify(new, docs)) == {"same": "unchanged", "rev": "touched", "both": "changed", "new": "new", "gone": "deleted", "torn": "skipped", "torn2": "skipped"}
    assert sorted(r[0] for r in cdc._to_read(new, docs).collect()) == ["both", "new", "rev", "torn", "torn2"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cdc, "ROWS", 2)
        assert cdc._to_read(new, docs) is None and classes(cdc.classify(new, docs))["rev"] == "touched"
    again = classes(cdc.classify(new, docs, rebuild=True))
    assert again["same"] == again["rev"] == "changed" and again["gone"] == "deleted"


def test_mass_deletion(spark):
    docs = spark.range(30).selectExpr("CAST(id AS STRING) AS doc_id")
    gone = lambda n: spark.range(n).selectExpr("CAST(id AS STRING) AS doc_id", "'deleted' AS class")
    with pytest.raises(cdc.MassDeletion):
        cdc.check_deletions(gone(6), docs)
    cdc.check_deletions(gone(5), docs)
    cdc.check_deletions(gone(30), docs, allow=True)
    cdc.check_deletions(gone(10), docs.limit(20))


def test_listing(spark, tmp_path):
    import json

    rows = [
        {"id": "b.md", "value": {"rev": "1"}, "doc": {"type": "plain", "path": "B.md", "children": ["h:1", "h:2"], "mtime": 5}},
        {"id": "a.md", "value": {"rev": "2"}, "doc": {"type": "newnote", "children": []}},
        {"id": "gone.md", "value": {"rev": "1"}, "doc": {"type": "plain", "deleted": True, "children": ["h:1"]}},
        {"id": "h:1", "value": {"rev": "1"}, "doc": {"type": "leaf", "data": "one "}}, {"id": "h:2", "value": {"rev": "1"}, "doc": {"type": "leaf", "data": "two"}},
        {"id": "c.md", "value": {"rev": "1"}, "doc": {"type": "plain", "children": ["h:1", "h:9"]}}, {"value": {"rev": "1"}},
    ]
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, rows)))
    dump = listing.read_listing(spark, str(tmp_path / "rows.json"))
    e = listing.entries(dump)
    assert [(r["doc_id"], r["path"], r["mtime"]) for r in e.collect()] == [("a.md", "a.md", 0), ("b.md", "B.md", 5), ("c.md", "c.md", 0)]
    assert [r["doc_id"] for r in listing.entries(dump, "B").collect()] == ["b.md", "c.md"][:1]
    got = {r["doc_id"]: r["markdown"] for r in listing.reassemble(e, listing.leaves(dump)).collect()}
    assert got == {"a.md": None, "b.md": "one two", "c.md": None}


def test_settings():
    assert settings.load("final_top_k: 16\ngraph_slots: 3", '{"graph_slots": 1, "include": ["x"]}', rerank=True).graph_slots == 1
    assert settings.overrides("not json") == {}
    layered = settings.load(
        "final_top_k: 16\ngraph_slots: 3\nthin_hits: 7", '{"thin_hits": 9, "graph_slots": 1, "source_url": "no"}', rerank=False,
        dotenv_text="# note\nSCRIPTORIUM_GRAPH_SLOTS='4'\nexport SCRIPTORIUM_WEB=yes\nbroken", environment={"SCRIPTORIUM_GRAPH_SLOTS": "5", "SCRIPTORIUM_PERSONAL": "a/*, b/*", "OTHER": "1"},
    )
    assert (layered.final_top_k, layered.graph_slots, layered.thin_hits, layered.web, layered.personal, layered.source_url) == (16, 5, 9, True, ("a/*", "b/*"), "")
    with pytest.raises(settings.SettingsError, match="not a int"):
        settings.load(environment={"SCRIPTORIUM_FINAL_TOP_K": "many"})
    with pytest.raises(settings.SettingsError, match="source_password"):
        settings.load(environment={"SCRIPTORIUM_SOURCE_URL": "http://db"})
    for bad in ("target_tokens: 2000", "fusion_top_k: 90", "nonsense: 1"):
        with pytest.raises(settings.SettingsError):
            settings.load(bad)


def test_external(spark):
    assert external.check_space({}, "m", 4) == "record"
    meta = {"embedding_model": "m", "embedding_dim": "4"}
    assert external.check_space(meta, "m", 4) == "ok" and external.check_space(meta, "n", 4, rebuild=True) == "reset"
    with pytest.raises(ValueError, match="not of"):
        external.check_space(meta, "m", 8)
    assert external.provider_available("duckduckgo", {}) and not external.provider_available("brave", {}) and not external.provider_available("x", {"x": "k"})
    q = spark.createDataFrame([(0, "q"), (1, "r")], "qid long, text string")
    found = external.web_results(q, lambda q, n: [{"title": f" {q} ", "url": "u"}, {"title": "no url"}] if q == "q" else 1 / 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, "q", "u", "")]


def test_a_store_keeps_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    values = lambda version=None: {r["key"]: r["value"] for r in store.read("meta", version).collect()}
    assert store.current() is None and values() == {}
    first = store.commit({"meta": row(("a", "1"), ("b", "1"))})
    for i in range(2, 12):
        store.commit({"meta": row(("a", str(i)))}, {"meta": row(("a", "")).select("key")})
        assert values() == {"a": str(i), "b": "1"}
    assert values(first) == {"a": "1", "b": "1"} and len(store.segments()) <= 8
    store.commit({}, {"meta": row(("b", "")).select("key")})
    assert values() == {"a": "11"}
    assert not store._publish({"segments": [], "log": []}, store.current())
    assert store.clean() > 0 and values() == {"a": "11"} and len(store.versions()) == 2
    store.compact()
    assert values() == {"a": "11"} and len(store.segments()) == 1


def test_index_search_and_refresh(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    chosen = Settings(personal=("Secret/*",))
    first = [
        ("Topics/T.md", "1", "---\ntitle: Topic\n---\n<!-- begin:clippings -->[[N/a]] [[Secret/s]]<!-- end:clippings -->\nhub"),
        ("N/a.md", "1", "the red fox"), ("N/b.md", "1", "a blue dog [[a]]"), ("Secret/s.md", "1", "red fox secret"), ("root.md", "1", "not in the corpus"),
    ]
    report = engine.index(store, notes(spark, first), chosen).first()
    assert report["n_new"] == 4
    assert engine.index(store, notes(spark, first), chosen).first()["n_unchanged"] == 4
    vectors = {"fox": [1.0, 0.0], "dog": [0.0, 1.0], "hub": [0.5, 0.5]}
    embedder = lambda texts: [next(v for w, v in vectors.items() if w in t) for t in texts]
    assert engine.embed_pending(store, embedder, "m", 2) == 0
    dry = engine.index(store, notes(spark, first[1:]), chosen, dry_run=True).first()
    assert dry["n_deleted"] == 1 and store.read("docs").count() == 4
    e = engine.Engine(spark, store.root, chosen)
    assert e.alive()
    q = spark.createDataFrame([(0, "red fox", [1.0, 0.0])], "qid long, text string, embedding array<float>")
    seen = {r["doc_id"]: r["source"] for r in e.search(q, allow_web=True).collect()}
    assert seen == {"n/a.md": "vector+fts", "n/b.md": "vector", "topics/t.md": "vector"}
    assert "secret/s.md" in {r["doc_id"] for r in e.search(q, allow_web=False).collect()}
    assert [(r["doc_id"], r["members"]) for r in e.topics().collect()] == [("topics/t.md", 2)]
    assert {(r["direction"], r["neighbor"]) for r in e.neighbors("N/a", allow_web=True).collect()} == {("in", "N/b.md"), ("in", "Topics/T.md")}
    assert e.read("n/b").first()["text"].endswith("a blue dog [[a]]")
    assert e.read("secret/s", allow_web=True).count() == 0
    two = spark.createDataFrame([(0, "red fox"), (1, "zebra")], "qid long, text string")
    said = {r["qid"]: (r["answer"], r["generated"]) for r in e.ask(two, lambda rules, m: m.upper()).collect()}
    assert said[1] == (engine.SILENT, False) and said[0][1]
    assert said[0][0].startswith("QUESTION: RED FOX\n\nCONTEXT FROM THE NOTES:\n\n### [[N/A.MD|A]]\nTHE RED FOX\n\n### [[TOPICS/T.MD|TOPIC]]\n")
    assert {r["qid"]: r["answer"] for r in e.ask(two, dry_run=True).collect()}[0] == "2 hit(s):\n  0.016393  [fts]  [[N/a.md|a]]\n  0.008197  [graph]  [[Topics/T.md|Topic]]"
    webbed = engine.Engine(spark, store.root, chosen.with_(web=True))
    found = lambda q, n: [{"title": "Z", "url": "http://z", "snippet": "stripes"}] if q == "zebra" else []
    said = {r["qid"]: r["answer"] for r in webbed.ask(two, lambda rules, m: f"{rules}\n{m}", web=found).collect()}
    assert said[1].endswith("### Z\nhttp://z\nstripes") and context.WEB_HEADING in said[1] and context.WEB_HEADING not in said[0]
    assert all(s.startswith(context.RULES) for s in said.values())
    graded = engine.Engine(spark, store.root, chosen.with_(rerank=True, rerank_top_k=8, graph_enabled=False))
    order = [r["doc_id"] for r in graded.search(q, allow_web=True, grader=lambda i, p: "2: 3\n1: 1").orderBy("ord").collect()]
    assert order == ["topics/t.md", "n/a.md"]

    from scriptorium.streaming import refresh

    (tmp_path / "in").mkdir()
    notes(spark, [("N/a.md", "2", "the red fox, changed"), ("N/c.md", "1", "new cat")]).write.mode("append").json(str(tmp_path / "in"))
    refresh.refresh(refresh.read_notes(spark, str(tmp_path / "in")), store, str(tmp_path / "progress"), chosen).awaitTermination()
    after = {r["doc_id"]: r["rev"] for r in store.read("docs").collect()}
    assert after == {"topics/t.md": "1", "n/a.md": "2", "n/b.md": "1", "secret/s.md": "1", "n/c.md": "1"}
    pending = cdc.missing_vectors(store.read("chunks"), store.read("vectors"))
    assert {r["doc_id"] for r in pending.collect()} == {"n/a.md", "n/c.md"}
    gone = engine.index(store, notes(spark, first[:2]), chosen).first()
    assert gone["n_deleted"] == 3 and store.read("docs").count() == 2 and store.read("edges").where(F.col("src") == "n/b.md").count() == 0


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string")


def test_two_writers(spark, tmp_path):
    """Of writers that start from one version the second is refused if both touch a key, and added if not."""
    store = Store(spark, str(tmp_path / "s"))
    put = lambda key, value, base: store.commit({"meta": keyed(spark, (key, value))}, {"meta": keyed(spark, (key, "")).select("key")}, base=base, touched=keyed(spark, (key, "")).select("key"))
    base = put("a", "1", -1)
    put("a", "2", base)
    put("b", "1", base)
    with pytest.raises(Conflict):
        put("a", "3", base)
    with pytest.raises(Conflict):
        store.commit({"meta": keyed(spark, ("c", "1"))}, base=base)
    store.compact()
    put("c", "1", store.current() - 1)  # a merge changes no key
    assert {r["key"]: r["value"] for r in store.read("meta").collect()} == {"a": "2", "b": "1", "c": "1"}


def test_bytes_are_written_again_once_a_size_class(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"meta": keyed(spark, *((f"k{i}", "v" * 50) for i in range(200)))})
    one = store.segments()[0]["bytes"]
    monkeypatch.setattr(store_module, "SMALL", 2 * one)
    written, merged = [], Store._merged
    monkeypatch.setattr(Store, "_merged", lambda self, *a: written.append(merged(self, *a)) or written[-1])
    n = 16
    for i in range(1, n):
        store.commit({"meta": keyed(spark, *((f"k{i}-{j}", "v" * 50) for j in range(200)))})
    assert store.read("meta").count() == 200 * n
    assert len(store.segments()) <= 3 * 4 and len(written) >= n // 4 - 2
    rows = sum(spark.read.parquet(f"{store.root}/{s['id']}/meta").count() for s in written) / (200 * n)
    assert rows <= 3.5  # log4 of 20 commits, and what the smallest class takes more


def test_an_interleaved_index_run_is_refused_and_leaves_no_orphans(spark, tmp_path, monkeypatch):
    chosen, many = Settings(), " ".join(f"word{i}" for i in range(200))
    store = Store(spark, str(tmp_path / "store"))
    engine.index(store, notes(spark, [("N/a.md", "1", "the red fox"), ("N/b.md", "1", "a blue dog")]), chosen)
    commit = Store.commit

    def late(self, rows, hidden=None, **kw):
        monkeypatch.setattr(Store, "commit", commit)
        engine.index(self, notes(spark, [("N/a.md", "2", "## x\n" + many + "\n## y\n" + many)]), chosen, full=False)
        return commit(self, rows, hidden, **kw)

    monkeypatch.setattr(Store, "commit", late)
    with pytest.raises(Conflict):
        engine.index(store, notes(spark, [("N/a.md", "3", "other"), ("N/c.md", "1", "c")]), chosen, full=False)
    monkeypatch.setattr(Store, "commit", late)
    engine.index(store, notes(spark, [("N/d.md", "1", "a fox")]), chosen, full=False)  # touches other notes: both stand
    assert {r["doc_id"]: r["rev"] for r in store.read("docs").collect()} == {"n/a.md": "2", "n/b.md": "1", "n/d.md": "1"}
    chunks = store.read("chunks").select("chunk_id")
    for t in ("postings", "lengths"):
        assert store.read(t).join(chunks, "chunk_id", "left_anti").count() == 0

    def numbers():
        return {r["term"]: r["n"] for r in store.read("blocks").groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").collect()}

    held = lambda: {r["term"]: r["n"] for r in store.read("postings").groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert numbers() == held()
    for i in (4, 5):
        engine.index(store, notes(spark, [("N/a.md", str(i), f"the fox number {i}"), ("N/b.md", str(i), "the dog" + " and dog" * i)][: 1 + i % 2]), chosen, full=False)
        assert numbers() == held()
    store.compact()
    assert numbers() == held() and store.read("blocks").where("n < 0").count() == 0


def test_late_and_deleted_notes_in_a_stream(spark, tmp_path):
    """Rows that come in the wrong order, a batch each: the store ends as the latest row of each note says."""
    from scriptorium.streaming import refresh

    change = "doc_id string, path string, rev string, mtime long, markdown string, deleted boolean"
    rows = [("n/a.md", "N/a.md", "1", 10, "first", None), ("n/a.md", "N/a.md", "2", 20, "second", False), ("n/b.md", "N/b.md", "1", 5, "b", None), ("n/b.md", "N/b.md", "2", 9, None, True)]
    for n, order in enumerate((rows[::-1],)):
        store = Store(spark, str(tmp_path / f"s{n}"))
        for row in order:
            refresh.merge_batch(store, spark.createDataFrame([row], change), Settings())
        assert [(r["doc_id"], r["rev"], r["mtime"]) for r in store.read("docs").collect()] == [("n/a.md", "2", 20)]
        assert {r["body"] for r in store.read("chunks").collect()} == {"second"}
    refresh.merge_batch(store, spark.createDataFrame([("n/b.md", "N/b.md", "3", 11, "back", None)], change), Settings())
    assert store.read("docs").count() == 2 and store.read("gone").count() == 0
