"""DuckDB SQL for the queries of ``catalog``."""

from __future__ import annotations

_NOTES = """
notes AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, source || '/' || lang || '/' || d.doc_id || '.md' AS path, 'doc ' || d.doc_id AS title,
         CASE l.toxic WHEN 1 THEN 'personal' WHEN 0 THEN 'open' END AS override,
         CASE WHEN l.toxic = 1 THEN 'personal' WHEN l.toxic = 0 THEN 'open' WHEN regexp_matches(source || '/', '^src1./') OR (source = 'src7' AND lang = 'de') THEN 'personal' ELSE 'open' END AS sensitivity
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

_FTS = """
toks AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS terms FROM documents),
lens AS (SELECT id, len(terms) AS dl FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS nt FROM post GROUP BY term),
bm AS (
  SELECT qid, p.id, -sum(qtf * CASE WHEN ln((n - nt + 0.5) / (nt + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nt + 0.5) / (nt + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN dfs USING (term) JOIN post p USING (term) JOIN lens ON lens.id = p.id, stats GROUP BY qid, p.id
),
fts AS (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS rank
  FROM bm JOIN notes ON notes.doc_id = bm.id WHERE {seen} QUALIFY rank <= 40
)"""

_KNN = """
dist AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v JOIN notes ON notes.doc_id = v.vec_id WHERE {seen}
),
knn AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM dist QUALIFY rank <= 40)"""

_FUSE = """
joined AS (
  SELECT coalesce(v.qid, t.qid) AS qid, coalesce(v.id, t.id) AS id, v.rank AS vr, t.rank AS tr, distance,
         coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS score,
         CASE WHEN v.id IS NULL THEN 'fts' WHEN t.id IS NULL THEN 'vector' ELSE 'vector+fts' END AS source
  FROM knn v FULL JOIN fts t ON v.qid = t.qid AND v.id = t.id
),
fused AS (
  SELECT qid, id, score, source, distance, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr IS NULL, vr, tr) AS ord FROM joined QUALIFY ord <= 20
)"""

_EDGES = """
hubs AS (SELECT source, min(doc_id) AS src FROM documents GROUP BY source),
edges AS (SELECT src, doc_id AS dst FROM documents JOIN hubs USING (source) WHERE doc_id <> src)"""

_EXPAND = """
seen AS (SELECT doc_id FROM notes WHERE {seen}),
ht AS (SELECT qid, ord, id AS doc, score, src AS topic FROM fused JOIN edges ON dst = id WHERE src IN (SELECT doc_id FROM seen)),
sb AS (
  SELECT qid, ord, score, topic, dst AS cand, row_number() OVER (PARTITION BY qid, ord, topic ORDER BY dst) AS k
  FROM ht JOIN edges ON src = topic JOIN seen ON doc_id = dst WHERE dst <> doc QUALIFY k <= 5
),
cands AS (SELECT qid, ord, score, topic, 0 AS k, topic AS cand FROM ht UNION ALL SELECT qid, ord, score, topic, k, cand FROM sb),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY qid, cand ORDER BY ord, topic, k, cand) AS n FROM cands c
  WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.qid = c.qid AND f.id = c.cand) QUALIFY n = 1
),
expanded AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord, topic, k, cand) AS ord, cand AS id, score * 0.5::DOUBLE AS score FROM firsts)"""


def _merge(fused: str, expanded: str, name: str = "merged", k: int = 8) -> str:
    """CTEs of the quota merge: 2 slots, k rows."""
    return f"""
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, graph, pos) AS o,
         graph = 1 AND sum(graph) OVER (PARTITION BY qid ORDER BY score DESC, graph, pos ROWS UNBOUNDED PRECEDING) > 2 AS held
  FROM (SELECT qid, id, score, source, 0 AS graph, ord AS pos FROM {fused} UNION ALL SELECT qid, id, score, 'graph', 1, ord FROM {expanded})
),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY held, o) AS take FROM {name}_r QUALIFY take <= {k}),
{name} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, held, o) AS ord, id, score, source FROM {name}_k)"""


_ALL, _OPEN = "TRUE", "sensitivity = 'open'"


def _with(body: str, *parts: str, seen: str = _ALL) -> str:
    return "WITH " + ",".join(p.replace("{seen}", seen) for p in (_NOTES, *parts)) + "\n" + body


_SEARCH = (_FTS, _KNN, _FUSE)
_SHOWN = "SELECT qid, ord, id AS chunk_id, round(score, 9) AS score, source FROM "
_FTS_OUT = "SELECT qid, rank, id AS chunk_id, round(score, 6) AS score FROM fts"
_KNN_OUT = "SELECT qid, rank, id AS chunk_id, round(distance, 6) AS distance FROM knn"

_OLD = """
old AS (SELECT doc_id, CASE WHEN source > 'src15' THEN '1' ELSE '2' END AS rev, sha256(CASE WHEN lang = 'de' THEN text || 'x' ELSE text END) AS content_hash FROM documents WHERE lang <> 'es'),
new AS (SELECT doc_id, '2' AS rev, CASE WHEN source <> 'src4' THEN text END AS markdown FROM documents WHERE source <> 'src3'),
classed AS (
  SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.rev = n.rev THEN 'unchanged' WHEN markdown IS NULL THEN 'skipped'
    WHEN o.doc_id IS NULL THEN 'new' WHEN sha256(markdown) = o.content_hash THEN 'touched' ELSE 'changed' END AS class
  FROM new n FULL JOIN old o ON n.doc_id = o.doc_id
)"""

_MULTI = """
multi AS (SELECT doc_id AS chunk_id, source AS doc_id, doc_id AS ordinal, CASE WHEN lang = 'de' THEN '' ELSE lang END AS h, md5(text) AS body, sensitivity FROM notes WHERE sensitivity = 'open')"""

_NAMED = """
named AS (SELECT lower(path) AS doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 'n ' || n_chars ELSE title END AS title FROM notes UNION ALL SELECT lower(path) || '.md', path || '.md', NULL FROM notes WHERE doc_id % 8 = 1),
keys AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, lower(regexp_replace(split_part(path, '/', 3), '\\.md$', '')) AS key FROM named UNION ALL SELECT doc_id, lower(title) FROM named) WHERE key <> ''),
counted AS (SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM keys GROUP BY key)"""

_LINES = """
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
parts AS (SELECT doc_id, pos, source || '/' || pos AS heading_path, text, len(regexp_extract_all(text, '\\S+')) AS n FROM lines WHERE text <> ''),
islands AS (SELECT *, sum(CASE WHEN first OR n >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS first FROM parts))"""



def _split(source: str, target: int, hard: int) -> str:
    """CTEs that fold the paragraphs of source (doc_id, pos, h, t) into pieces (doc_id, pos, h, k, body)."""
    nothing = "[]::VARCHAR[]"
    return f"""
sized AS (SELECT *, len(regexp_extract_all(t, '\\S+')) AS n FROM {source}),
paragraphs AS (SELECT doc_id, pos, h, unnest(string_split_regex(t, '\\n{{2,}}')) AS p, generate_subscripts(string_split_regex(t, '\\n{{2,}}'), 1) AS i FROM sized WHERE n > {hard}),
counted_p AS (SELECT *, regexp_extract_all(p, '\\S+') AS w, len(regexp_extract_all(p, '\\S+')) AS n FROM paragraphs),
steps AS (
  SELECT doc_id, pos, h, i, 0 AS j, p AS pack, n, FALSE AS closed FROM counted_p WHERE n BETWEEN 1 AND {hard}
  UNION ALL SELECT doc_id, pos, h, i, j, array_to_string(w[j + 1 : j + {hard}], ' '), least({hard}, n - j), TRUE FROM (SELECT *, unnest(range(0, n, {hard})) AS j FROM counted_p WHERE n > {hard})
),
folded AS (
  SELECT doc_id, pos, h, list_reduce(
    list_prepend({{'out': {nothing}, 'pack': '', 'n': 0::BIGINT, 'closed': FALSE}}, list({{'out': {nothing}, 'pack': pack, 'n': n::BIGINT, 'closed': closed}} ORDER BY i, j)),
    lambda a, x: CASE
      WHEN x.closed THEN {{'out': list_concat(a.out, CASE WHEN a.n > 0 THEN [a.pack] ELSE {nothing} END, [x.pack]), 'pack': '', 'n': 0::BIGINT, 'closed': FALSE}}
      WHEN a.n = 0 THEN {{'out': a.out, 'pack': x.pack, 'n': x.n, 'closed': FALSE}}
      WHEN a.n + x.n > {target} THEN {{'out': list_append(a.out, a.pack), 'pack': x.pack, 'n': x.n, 'closed': FALSE}}
      ELSE {{'out': a.out, 'pack': a.pack || chr(10) || chr(10) || x.pack, 'n': a.n + x.n, 'closed': FALSE}} END) AS r
  FROM steps GROUP BY doc_id, pos, h
),
split_up AS (
  SELECT doc_id, pos, h, [t] AS bodies FROM sized WHERE n <= {hard}
  UNION ALL SELECT doc_id, pos, h, list_concat(r.out, CASE WHEN r.n > 0 THEN [r.pack] ELSE {nothing} END) FROM folded
),
pieces AS (SELECT doc_id, pos, h, unnest(bodies) AS body, generate_subscripts(bodies, 1) - 1 AS k FROM split_up)"""


_CONTEXT = """
blocks AS (
  SELECT qid, ord, title, path, text, score, fused.source, fused.id, sensitivity, CASE WHEN fused.id % 2 = 0 THEN 'part' END AS h,
         '[[' || path || '|' || title || ']]' || CASE WHEN fused.id % 2 = 0 THEN ' (part)' ELSE '' END AS cited
  FROM fused JOIN notes ON notes.doc_id = fused.id
),
contexts AS (SELECT qid, string_agg('### ' || cited || chr(10) || text, chr(10) || chr(10) ORDER BY ord) AS c FROM blocks GROUP BY qid)"""

_WEB = """
results AS (SELECT item_id AS qid, text, unnest(range(0, length(text) % 5)) AS i FROM benchmark),
webs AS (
  SELECT qid, '## Web results: outside the collection, cited by address' || chr(10) || chr(10) || string_agg('### about ' || rtrim(left(text, 9), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || 'http://w/' || length(text) || '/' || i || chr(10) || trim(left(text, 20), ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY i) AS w
  FROM results WHERE i <> 2 GROUP BY qid
)"""

_LINKED = """
linked AS (
  SELECT n.doc_id AS id, d.doc_id, d.path, d.title, n.lang, n.source, 'doc ' || (n.doc_id + 1) AS next, regexp_replace(n.path, '\\.md$', '') AS bare, 'n ' || n.n_chars AS chars
  FROM named d JOIN notes n ON d.doc_id = lower(n.path)
),
written AS (SELECT *, 'see [[' || next || ']] and [[ ' || bare || ' |an alias]], [[ ]], [[' || next || ']]' || chr(10) || '<!-- begin:clippings -->' || chr(10) || '- [[' || chars || ']]' || chr(10) || '<!-- end:clippings --> [[gone ' || id || ']]' AS md FROM linked),
wiki AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(md, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda t: trim(t)), lambda t: t <> '') AS ts FROM written),
topical AS (SELECT doc_id, [chars] AS ts FROM linked),
tagged AS (SELECT doc_id, unnest(CASE id % 4 WHEN 0 THEN [lang, source] WHEN 1 THEN [lang] ELSE [] END) AS tag FROM linked),
targets AS (SELECT doc_id AS src, unnest(ts) AS target, 'wikilink' AS kind FROM wiki UNION ALL SELECT doc_id, unnest(ts), 'topic' FROM topical)"""


def _resolved(name: str, targets: str, docs: str) -> str:
    """A CTE of targets resolved against some of the documents."""
    return f"""
{name}_keys AS (SELECT key, min(doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, lower(regexp_replace(split_part(path, '/', 3), '\\.md$', '')) AS key FROM {docs} UNION ALL SELECT doc_id, lower(title) FROM {docs}) WHERE key <> '') GROUP BY key HAVING count(*) = 1),
{name} AS (
  SELECT DISTINCT src, coalesce(a.doc_id, b.doc_id, c.doc_id, target) AS dst, kind, coalesce(a.doc_id, b.doc_id, c.doc_id) IS NOT NULL AS resolved
  FROM {targets} LEFT JOIN {docs} a ON a.doc_id = lower(target) || '.md' LEFT JOIN {docs} b ON b.doc_id = lower(target) LEFT JOIN {name}_keys c ON c.key = lower(split_part(target, '/', -1))
)"""


_FEED = """
feed AS (
  SELECT *, CASE WHEN doc_id % 11 <> 0 THEN lower(path) END AS id, CASE WHEN doc_id % 5 = 0 THEN 'leaf' ELSE 'note' END AS type FROM notes
)"""

#: Keyword search over a store's chunks: the prelude (title and path) and the whole text of each document.
_STORED = """
bodies AS (SELECT doc_id, path, trim(translate(text, chr(10) || chr(9) || chr(13) || '#', '    ')) AS body, regexp_matches(source || '/', '^src1./') OR (source = 'src7' AND lang = 'de') AS hidden FROM notes)"""

SQL: dict[str, str] = {
    "fts_bm25_topk": _with(_FTS_OUT, _FTS),
    "fts_bm25_open_only": _with(_FTS_OUT, _FTS, seen=_OPEN),
    "knn_l2_topk": _with(_KNN_OUT, _KNN),
    "knn_open_only": _with(_KNN_OUT, _KNN, seen=_OPEN),
    "rrf_fuse": _with(_SHOWN + "fused", *_SEARCH),
    "rrf_per_doc_cap": _with(
        _SHOWN + "capped",
        *_SEARCH,
        """
per AS (SELECT j.*, row_number() OVER (PARTITION BY qid, d.source ORDER BY score DESC, vr IS NULL, vr, tr) AS n FROM joined j JOIN documents d ON d.doc_id = j.id QUALIFY n <= 2),
capped AS (SELECT qid, id, score, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr IS NULL, vr, tr) AS ord FROM per QUALIFY ord <= 20)""",
    ),
    "graph_topics": _with("SELECT doc_id, path, title, count(*) AS members FROM notes JOIN edges ON src = doc_id WHERE sensitivity = 'open' GROUP BY ALL", _EDGES),
    "graph_siblings": _with("SELECT qid, ord, topic, k, cand AS doc_id FROM sb", *_SEARCH, _EDGES, _EXPAND, seen=_OPEN),
    "graph_expand": _with("SELECT qid, ord, id AS doc_id, round(score, 9) AS score FROM expanded", *_SEARCH, _EDGES, _EXPAND),
    "quota_merge": _with(_SHOWN + "merged", *_SEARCH, _EDGES, _EXPAND, "\nsix AS (SELECT * FROM fused WHERE ord <= 6), up AS (SELECT qid, ord, id, score * 3 AS score FROM expanded)", _merge("six", "up")),
    "hybrid_search_batch": _with(_SHOWN + "merged", *_SEARCH, _EDGES, _EXPAND, _merge("fused", "expanded"), seen=_OPEN),
    "rerank_apply": _with(
        "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, ord) AS ord, id AS chunk_id, grade FROM g WHERE top = 0 OR grade > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY grade DESC, ord) <= 8",
        *_SEARCH,
        "\ng AS (SELECT *, max(grade) OVER (PARTITION BY qid) AS top FROM (SELECT qid, ord, id, CASE WHEN qid % 5 = 0 THEN 0 ELSE (id + qid) % 4 END AS grade FROM fused))",
    ),
    "web_trigger": _with(
        "SELECT item_id AS qid, coalesce(n, 0) AS n_hits, round(m, 6) AS min_distance, CASE WHEN coalesce(n, 0) < 3 THEN TRUE WHEN m IS NULL THEN FALSE ELSE m > 1.2 END AS search_web FROM benchmark LEFT JOIN s ON qid = item_id",
        *_SEARCH,
        "\ns AS (SELECT qid, count(*) AS n, min(distance) AS m FROM fused GROUP BY qid)",
    ),
    "web_calibration": _with(
        """SELECT round(a, 6) AS covered_min, round(b, 6) AS covered_max, round(c, 6) AS uncovered_min, round(d, 6) AS uncovered_max, round((b + c) / 2, 6) AS midpoint, b < c AS separated,
  (SELECT count(*) FROM near, e WHERE covered <> (distance <= (b + c) / 2)) AS misclassified FROM e""",
        _KNN,
        """
near AS (SELECT distance, label % 2 = 0 AS covered FROM knn JOIN embeddings ON vec_id = qid WHERE rank = 2),
e AS (SELECT min(distance) FILTER (WHERE covered) AS a, max(distance) FILTER (WHERE covered) AS b, min(distance) FILTER (WHERE NOT covered) AS c, max(distance) FILTER (WHERE NOT covered) AS d FROM near)""",
    ),
    "classify_sensitivity": _with("SELECT doc_id, path, sensitivity FROM notes"),
    "corpus_filter": _with("SELECT doc_id, path FROM notes WHERE path LIKE 'src%/%' AND lang <> 'es' AND source <> 'src3'"),
    "unmatched_globs": _with(
        "SELECT g.\"glob\" FROM (VALUES ('src1/*', '^src1/'), ('src?/en/*', '^src./en/'), ('nowhere/*', '^nowhere/'), ('*/[x-z]*/*', '/[x-z].*/'), ('*.md', '[.]md$')) g(\"glob\", re) WHERE NOT EXISTS (SELECT 1 FROM notes WHERE regexp_matches(path, re))"
    ),
    "title_derivation": _with("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN title ELSE doc_id::VARCHAR END AS title FROM notes"),
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "chunk_ids": _with(
        "SELECT doc_id, left(sha256(path || source || n_chars), 16) AS chunk_id, title || chr(10) || CASE WHEN lang = 'de' THEN '' ELSE source || chr(10) END || path AS prelude FROM notes"
    ),
    "chunk_token_windows": """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t FROM documents), i AS (SELECT doc_id, t, unnest(range(0, len(t), 100)) AS a FROM w)
SELECT doc_id, CAST(a // 100 AS INTEGER) AS ordinal, least(100, len(t) - a) AS n_tokens, md5(array_to_string(t[a + 1 : a + 100], ' ')) AS digest FROM i""",
    "runt_merge": "WITH" + _LINES + "\nSELECT doc_id, min(pos) AS pos, arg_min(heading_path, pos) AS heading_path, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS digest FROM islands GROUP BY doc_id, island",
    "hard_split": "WITH whole AS (SELECT doc_id, 0 AS pos, '' AS h, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents)," + _split("whole", 60, 90) + "\nSELECT doc_id, k AS ordinal, md5(body) AS digest FROM pieces",
    "heading_chunks": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
heads AS (SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text, CASE WHEN pos % 3 = 0 THEN 'part ' || pos ELSE 'part ' || (pos - pos % 3) || ' > item ' || pos END AS h FROM l),
parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 OR len(regexp_extract_all(text, '\\S+')) >= 80 AS starts FROM heads WHERE text <> ''),
islands AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM parts),
merged AS (SELECT doc_id, min(pos) AS pos, arg_min(h, pos) AS h, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS t FROM islands GROUP BY doc_id, island),"""
    + _split("merged", 120, 200)
    + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS ordinal FROM pieces)
SELECT left(sha256(doc_id || h || ordinal), 16) AS chunk_id, doc_id::VARCHAR AS doc_id, ordinal, h AS heading_path, md5(body) AS digest FROM numbered""",
    "extract_links": "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), 1) - 1 AS pos FROM pages",
    "resolve_links": _with(
        """SELECT src, target, coalesce(a.doc_id, b.doc_id, c.doc_id, target) AS dst, coalesce(a.doc_id, b.doc_id, c.doc_id) IS NOT NULL AS resolved
FROM t LEFT JOIN named a ON a.doc_id = regexp_replace(lower(trim(target)), '\\.md$', '') || '.md' LEFT JOIN named b ON b.doc_id = lower(trim(target)) LEFT JOIN counted c ON c.n = 1 AND c.key = lower(split_part(target, '/', -1))""",
        _NAMED,
        "\nt AS (SELECT doc_id AS src, CASE doc_id % 4 WHEN 0 THEN ' ' || regexp_replace(path, '\\.md$', '') WHEN 1 THEN upper(path) WHEN 2 THEN 'x/' || upper(title) ELSE 'n ' || n_chars END AS target FROM notes)",
    ),
    "name_index": _with("SELECT key, n AS n_docs, doc_id AS first_doc FROM counted", _NAMED),
    "cdc_classify": "WITH" + _OLD + "\nSELECT * FROM classed",
    "cdc_report": "WITH" + _OLD + "\nSELECT "
    + ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS n_{c}" for c in ("new", "changed", "touched", "unchanged", "deleted", "skipped"))
    + ", count(*) FILTER (WHERE class IN ('new', 'changed', 'touched')) AS n_reads FROM classed",
    "cdc_deletions": "WITH" + _OLD + "\nSELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)",
    "mass_delete_guard": "WITH" + _OLD + "\nSELECT c AS n_cached, d AS n_deleted, c >= 25 AND d >= c * 0.2 AS refused FROM (SELECT count(*) AS c FROM old), (SELECT count(*) AS d FROM classed WHERE class = 'deleted')",
    "upsert_docs": "WITH" + _OLD + ", f AS (SELECT doc_id, rev, sha256(markdown) AS content_hash FROM new WHERE markdown IS NOT NULL) SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT * FROM f",
    "reclassify": _with(
        "SELECT doc_id, now AS sensitivity, now <> sensitivity AS changed FROM (SELECT *, CASE WHEN override IS NOT NULL AND doc_id % 2 = 0 THEN override WHEN source = 'src2' THEN 'personal' ELSE 'open' END AS now FROM notes)"
    ),
    "missing_embeddings": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "lead_chunk": _with("SELECT doc_id, min(chunk_id) AS chunk_id FROM multi GROUP BY doc_id", _MULTI),
    "read_document": _with(
        """SELECT s.doc_id, md5(t) AS digest, length(t) AS n_chars FROM (
  SELECT a.doc_id, '# Source ' || a.doc_id || chr(10) || '[[' || a.doc_id || '.md]]' || coalesce(chr(10) || chr(10) || string_agg(CASE WHEN h <> '' AND b IS DISTINCT FROM h THEN '## ' || h || chr(10) || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY ordinal), '') AS t
  FROM (SELECT DISTINCT source AS doc_id FROM documents) a LEFT JOIN (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY ordinal) AS b FROM multi) m ON m.doc_id = a.doc_id GROUP BY a.doc_id) s""",
        _MULTI,
    ),
    "neighbors": _with(
        """SELECT e.src AS doc_id, 'out' AS direction, 'topic' AS kind, t.path AS neighbor FROM edges e JOIN seen s ON s.doc_id = e.src JOIN seen t ON t.doc_id = e.dst
UNION ALL SELECT e.dst, 'in', 'topic', s.path FROM edges e JOIN seen s ON s.doc_id = e.src JOIN seen t ON t.doc_id = e.dst
UNION ALL SELECT doc_id, 'out', 'wikilink', 'raw ' || lang FROM seen UNION ALL SELECT doc_id, 'out', 'tag', lang FROM seen""",
        _EDGES,
        "\nseen AS (SELECT * FROM notes WHERE sensitivity = 'open')",
    ),
    "resolve_docs": _with(
        """SELECT needle, coalesce(n, 0) AS n, h.doc_id FROM needles LEFT JOIN (
  SELECT needle, count(*) AS n, min(doc_id) AS doc_id FROM (
    SELECT needle, doc_id, exact, bool_or(exact) OVER (PARTITION BY needle) AS any_exact FROM (
      SELECT needle, doc_id, bool_or(doc_id = want OR doc_id = note) AS exact FROM needles JOIN shown ON doc_id = want OR doc_id = note OR lower(title) = want OR lower(path) = note OR ends_with(lower(path), '/' || note) GROUP BY ALL)
  ) WHERE exact = any_exact GROUP BY needle
) h USING (needle)""",
        "\nshown AS (SELECT lower(path) AS doc_id, path, CASE WHEN doc_id % 2 = 0 THEN title ELSE 'n ' || n_chars END AS title FROM notes WHERE sensitivity = 'open')",
        "\nneedles AS (SELECT needle, lower(trim(needle)) AS want, CASE WHEN lower(trim(needle)) LIKE '%.md' THEN lower(trim(needle)) ELSE lower(trim(needle)) || '.md' END AS note FROM (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN upper(path) WHEN 1 THEN lang || '/' || doc_id WHEN 2 THEN upper(title) ELSE 'N ' || n_chars END AS needle FROM notes))",
    ),
    "resolve_doc": _with(
        "SELECT lower(path) AS doc_id, path, title FROM notes WHERE lower(title) = 'doc 3' UNION ALL SELECT lower(path), path, title FROM notes WHERE path LIKE '%/en/10.md' UNION ALL SELECT lower(path), path, title FROM notes WHERE path = 'src1/en/11.md' OR path LIKE '%/src1/en/11.md'"
    ),
    "last_user_message": "SELECT conv_id, arg_max(text, (turn, text)) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "assemble_context": _with(
        "SELECT qid, md5(c) AS digest, length(c) AS n_chars FROM contexts",
        *_SEARCH, _CONTEXT, seen=_OPEN,
    ),
    "hits_json": _with(
        """SELECT qid, '[' || string_agg('{"rank":' || ord || ',"score":' || round(score, 9) || ',"source":"' || source || '","path":"' || path || '","title":"' || title || '"' || coalesce(',"heading_path":"' || h || '"', '')
  || ',"doc_id":' || id || ',"chunk_id":' || id || ',"sensitivity":"' || sensitivity || '"}', ',' ORDER BY ord) || ']' AS hits FROM blocks GROUP BY qid""",
        *_SEARCH, _CONTEXT, seen=_OPEN,
    ),
    "hits_text": _with(
        "SELECT qid, count(*) || ' hit(s):' || chr(10) || string_agg('  ' || printf('%.6f', round(score, 9)) || '  [' || source || ']  ' || cited, chr(10) ORDER BY ord) AS listing FROM blocks GROUP BY qid", *_SEARCH, _CONTEXT, seen=_OPEN
    ),
    "web_context": "WITH" + _WEB + "\nSELECT qid, md5(w) AS digest FROM webs",
    "model_messages": _with(
        """SELECT item_id AS qid, md5('Question: ' || text || chr(10) || chr(10) || 'Context from the notes:' || chr(10) || chr(10) || coalesce(c, '') || coalesce(chr(10) || chr(10) || w, '')) AS digest
FROM benchmark LEFT JOIN (SELECT * FROM contexts WHERE qid % 3 > 0) x ON x.qid = item_id LEFT JOIN webs ON webs.qid = item_id WHERE c IS NOT NULL OR w IS NOT NULL""",
        *_SEARCH, _CONTEXT, _WEB, seen=_OPEN,
    ),
    "parse_grades": _with(
        "SELECT q.qid, CASE WHEN q.qid % 7 <> 0 THEN '[' || string_agg(coalesce((f.id + f.qid) % 4, 0), ',' ORDER BY i) || ']' END AS grades FROM q, range(1, 21) r(i) LEFT JOIN fused f ON f.qid = q.qid AND f.ord = i GROUP BY q.qid",
        *_SEARCH,
        "\nq AS (SELECT DISTINCT qid FROM fused WHERE (id + qid) % 4 > 0)",
    ),
    "hybrid_search_without_graph": _with(_SHOWN + "fused WHERE ord <= 8", *_SEARCH, seen=_OPEN),
    "hybrid_search_reranked": _with(
        "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, ord) AS ord, id AS chunk_id, round(score, 9) AS score, source FROM g WHERE top = 0 OR grade > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY grade DESC, ord) <= 8",
        *_SEARCH, _EDGES, _EXPAND, _merge("fused", "expanded", k=12),
        "\ng AS (SELECT *, max(grade) OVER (PARTITION BY qid) AS top FROM (SELECT m.*, CASE WHEN count(*) OVER (PARTITION BY qid) < 2 THEN 0 ELSE (ord + length(text)) % 4 END AS grade FROM merged m JOIN benchmark ON item_id = qid))",
        seen=_OPEN,
    ),
    "wikilinks": _with("SELECT doc_id, unnest(ts) AS target, generate_subscripts(ts, 1) - 1 AS pos FROM wiki", _NAMED, _LINKED),
    "topic_links": _with("SELECT doc_id, chars AS target, 0 AS pos FROM linked", _NAMED, _LINKED),
    "tags": _with("SELECT doc_id, tag FROM tagged", _NAMED, _LINKED),
    "edge_build": _with("SELECT * FROM built UNION ALL SELECT doc_id, 'tag:' || tag, 'tag', FALSE FROM tagged", _NAMED, _LINKED, _resolved("built", "targets", "named")),
    "edge_catch_up": _with(
        """SELECT src, dst, kind, bool_or(resolved) AS resolved FROM (SELECT * FROM early WHERE resolved UNION ALL SELECT * FROM again UNION ALL SELECT doc_id, 'tag:' || tag, 'tag', FALSE FROM tagged) GROUP BY src, dst, kind""",
        _NAMED, _LINKED, "\nhalf AS (SELECT * FROM named WHERE length(doc_id) % 2 = 0)", _resolved("early", "targets", "half"),
        "\npending AS (SELECT src, dst AS target, kind FROM early WHERE NOT resolved)", _resolved("again", "pending", "named"),
    ),
    "edge_backfill": "WITH" + _OLD + "\nSELECT doc_id FROM new WHERE doc_id IN (SELECT doc_id FROM old)",
    "frontmatter": _with(
        """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"title": "' || title || '", "n": ' || n_chars || '}' ELSE '{}' END AS front, md5(CASE WHEN doc_id % 4 = 1 THEN '---' || chr(10) || 'title: open' || chr(10) || source ELSE text END) AS digest FROM notes"""
    ),
    "sections": """
WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l)
SELECT doc_id, i AS pos, CASE WHEN i = 0 THEN '' WHEN i % 3 = 1 THEN 'part ' || i ELSE 'part ' || (i - (i - 1) % 3) || ' > item ' || i END AS heading_path, md5(line) AS digest FROM e""",
    "cdc_rebuild": "WITH" + _OLD + "\nSELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN markdown IS NULL THEN 'skipped' WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS class FROM new n FULL JOIN old o ON n.doc_id = o.doc_id",
    "touch_docs": "WITH" + _OLD + "\nSELECT doc_id, CASE WHEN class = 'touched' THEN '2' ELSE rev END AS rev, content_hash FROM old JOIN classed USING (doc_id)",
    "index_apply": _with(
        """SELECT lower(path) AS doc_id, CASE WHEN class IN ('new', 'changed', 'touched') THEN '2' ELSE o.rev END AS rev, CASE WHEN class IN ('new', 'changed') THEN sha256(text) ELSE o.content_hash END AS content_hash, regexp_matches(text, '\\S') AS chunked
FROM classed JOIN notes USING (doc_id) LEFT JOIN old o USING (doc_id) WHERE class <> 'deleted' AND NOT (class = 'skipped' AND o.doc_id IS NULL)""",
        _OLD,
    ),
    "engine_search": _with(
        "SELECT qid, rank AS ord, lower(path) AS doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, 'fts' AS source FROM fts JOIN notes ON notes.doc_id = id WHERE rank <= 3",
        _STORED,
        _FTS.replace("toks AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS terms FROM documents)", "toks AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(doc_id || ' ' || path || ' ' || body)), '[\\p{L}\\p{N}]+') AS terms FROM bodies WHERE body <> '')")
        .replace("ORDER BY round(score, 9), id)", "ORDER BY round(score, 9), left(sha256(lower(path) || '0'), 16))")
        .replace("{seen} QUALIFY", "id IN (SELECT doc_id FROM bodies WHERE NOT hidden) QUALIFY"),
    ),
    "embed_chunks": "SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN source <> 'src9' THEN CAST(length(source) + 3 + length(text) AS DOUBLE) END AS n, CASE WHEN source <> 'src9' THEN CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) END AS a FROM documents",
    "listing_entries": _with(
        """SELECT id AS doc_id, CASE WHEN doc_id % 3 = 0 THEN id ELSE path END AS path, (doc_id % 9)::VARCHAR AS rev, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS n_children, CASE WHEN doc_id % 6 <> 0 THEN doc_id ELSE 0 END AS mtime
FROM feed WHERE id >= 'src1' AND id <= 'src2' AND doc_id % 7 <> 0 AND type <> 'leaf'""",
        _FEED,
    ),
    "point_get": _with("SELECT id, (doc_id % 9)::VARCHAR AS rev FROM feed WHERE id = (SELECT min(id) FROM feed)", _FEED),
    "rerank_prompt": _with(
        """SELECT qid, count(*) AS n, md5('Question: ' || any_value(q.text) || chr(10) || chr(10) || 'Candidates:' || chr(10) || string_agg('[' || ord || '] ' || title || coalesce(' > ' || h, '') || chr(10) || left(trim(regexp_replace(blocks.text, '\\s+', ' ', 'g')), 500), chr(10) ORDER BY ord)) AS digest
FROM blocks JOIN benchmark q ON item_id = qid GROUP BY qid""",
        *_SEARCH, _CONTEXT, seen=_OPEN,
    ),
    "fts_query": "SELECT item_id AS qid, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: '\"' || t || '\"'), ' OR ') AS fts FROM benchmark",
    "note_reassembly": """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN source = 'src9' AND len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END >= 3 THEN NULL ELSE sha256(text) END AS content_hash FROM documents""",
    "stream_ingest": _with("SELECT lower(path) AS doc_id, doc_id::VARCHAR AS title, sha256(text) AS content_hash, CASE WHEN regexp_matches(source || '/', '^src1./') OR (source = 'src7' AND lang = 'de') THEN 'personal' ELSE 'open' END AS sensitivity FROM notes"),
}

_AB = (*_SEARCH, _EDGES, _EXPAND, "\nup AS (SELECT qid, ord, id, score * 2 AS score FROM expanded), none AS (SELECT * FROM up WHERE FALSE)", _merge("fused", "none", "without"), _merge("fused", "up"))
_DISPLACED = """SELECT m.qid, count(*) AS n_hits, count(*) FILTER (WHERE source = 'graph') AS n_expanded, coalesce(any_value(n), 0) AS n_displaced
FROM merged m LEFT JOIN (SELECT qid, count(*) AS n FROM without w WHERE NOT EXISTS (SELECT 1 FROM merged x WHERE x.qid = w.qid AND x.id = w.id) GROUP BY qid) l ON l.qid = m.qid GROUP BY m.qid"""
SQL["graph_ab_displacement"] = _with(_DISPLACED, *_AB)
SQL["graph_ab_totals"] = _with(
    f"""SELECT count(*) AS n_questions, count(*) FILTER (WHERE n_expanded > 0) AS n_fired, round(count(*) FILTER (WHERE n_expanded > 0) * 100.0::DOUBLE / count(*), 6) AS fired_percent,
  CAST(sum(n_expanded) AS BIGINT) AS n_expanded, CAST(sum(n_displaced) AS BIGINT) AS n_displaced, max(n_displaced) AS worst FROM ({_DISPLACED})""",
    *_AB,
)
