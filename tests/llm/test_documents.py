"""Operators on documents, each against a plain version and on odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import classifier, mixing, packing, pii, quality_rules, registry, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf, texts, odd):
    got = registry.queries()["op2_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts)
    counts = defaultdict(lambda: [0, 0])
    good = {r["doc_id"] for r in quality_rules.trusted_ids(spark, sf).collect()}
    grams = lambda t: (lambda h: h + [quality_hash(a, b) for a, b in zip(h, h[1:])])([signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(t or "")])
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    quality_hash = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
    for i, t in texts.items():
        for g in grams(t):
            counts[g % quality_rules.BUCKETS][0] += 1
            counts[g % quality_rules.BUCKETS][1] += i in good
    raw, target = (sum(c[k] for c in counts.values()) for k in (0, 1))
    s = quality_rules.SMOOTHING
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_rules(texts[r["doc_id"]])
        g = [counts[x % quality_rules.BUCKETS] for x in grams(texts[r["doc_id"]])]
        score = float(np.mean([np.log((t * raw / target + s) / (n + s)) for n, t in g])) if g else 0.0
        assert abs(score - r["score"]) < 1e-9
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.LEAST_SCORE)
    none = spark.createDataFrame([], "doc_id long")
    rows = quality_rules.judge(odd.select("doc_id", "text"), none).collect()
    assert len(rows) == odd.count() and all(r["rules"]["score"] == 0 for r in rows)
    for r in rows:
        assert tuple(r["rules"])[:5] == base_rules(r["text"])
    assert quality_rules.judge(odd.limit(0), none).count() == 0
    wide = odd.withColumn("weights", F.lit(1)).withColumn("Judged", F.lit("j"))
    out = quality_rules.judge(wide, none)
    assert out.columns == wide.columns and {(r["weights"], r["Judged"]) for r in out.collect()} == {(1, "j")}
    assert sorted(str(r["rules"]) for r in out.collect()) == sorted(str(r["rules"]) for r in rows)


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf, texts, odd):
    got = {r["doc_id"]: r for r in registry.queries()["op9_simhash"](spark, sf).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in prints.items())
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: got[i]["component_id"] for i in ids} == {i: find(i) for i in ids}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["fp"] == by[3]["fp"] == by[6]["fp"] == 0 and by[3]["component_id"] == by[6]["component_id"] == 2 and by[8]["component_id"] == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_chained_fingerprints_of_a_dense_group():
    rng = random.Random(5)
    for n, free in ((40, (0, 1)), (300, (2, 7))):
        low = rng.sample(range(1 << 12), n)
        v = np.array([(v & 255) << (8 * free[0]) | (v >> 8) << (8 * free[1]) | 0x0000110011000000 & ~(255 << (8 * free[0])) for v in low], dtype=np.uint64)
        brute = [(i, j) for i in range(n) for j in range(i + 1, n) if bin(int(v[i]) ^ int(v[j])).count("1") <= 2]
        assert _groups(n, simhash.span(v, free)) == _groups(n, brute)


def test_pairs_are_retained_by_their_tally():
    a = np.array([0, 0, 0, 0, 0], dtype=np.uint64)
    b = np.array([0, 1 << 63 | 1, 0b11, 0b111, 1 | 1 << 8 | 1 << 16], dtype=np.uint64)
    assert simhash.linked(a, b).tolist() == [True, True, True, False, False]


def _groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_spans(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data(spark, sf, texts, odd):
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("aZ0123459..@@-+ ()%_é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t)
    for r in registry.queries()["op5_pii"](spark, sf).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
    assert pii.find(odd).count() == odd.count() and pii.find(odd.limit(0)).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and {r["k1_"] for r in clean.collect()} == {7}
    assert [r["text"] for r in clean.where("doc_id IS NULL").collect()] == ["No id, but mail me at <EMAIL> or <PHONE>."]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please contact user{i}@mail.example.org now") for i in range(8)] + [(20 + i, f"please contact ID-7731{i}924 now") for i in range(2)] + [(40, "version 10.4.2-2024beta99 is out")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["kind"] for s in got[20]] == ["id"] and rows[8][1][got[20][0]["first"] : got[20][0]["last"]] == "ID-77310924" and got[40] == []


def test_keys_of_secrets_are_found(spark):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 6)) + "12ab34"
    lines = {i: (line, secret) for i, (line, secret) in enumerate([(f"{k}{secret}", secret) for k in ('token = "', "export API_KEY=", "db.password: ", '"client_secret": "', "auth_token=") for secret in (hexes(40), hexes(24))])}
    lines |= {100 + i: (f'widget = "{s}"', s) for i, s in enumerate(hexes(32) for _ in range(9))}
    plain = {200: "order = 20240131-77", 201: "tokens seen: 20240131", 202: "monkey: 12345678", 203: "size=1234567890123456"}
    words = lambda: " ".join(rng.choice(["alder", "birch", "cedar", "dogwood", "elder"]) + str(rng.randrange(9)) for _ in range(12))
    rows = [(i, f"{words()}\n{line}\" \n{words()}" if line.count('"') % 2 else f"{words()}\n{line}\n{words()}") for i, (line, _) in lines.items()]
    rows += [(i, f"{words()}\n{t}\n{words()}") for i, t in plain.items()]
    text = dict(rows)
    found = {r["doc_id"]: [text[r["doc_id"]][s["first"] : s["last"]] for s in r["spans"] if s["kind"] == "id"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, (_, secret) in lines.items() if secret not in found[i]] == []
    assert all(found[i] == [] for i in plain)


def test_keyed_secrets_of_the_tables(spark):
    """Recall of ``token = "<40 hex>"`` over whole tables; no bare run of digits that fails Luhn is flagged."""
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        want = {(i, *m.span(1)) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
        spans = {(r["doc_id"], s["first"], s["last"]) for r in pii.find(docs).collect() for s in r["spans"] if s["kind"] == "id"}
        assert want and len(want & spans) >= 0.9 * len(want)
        assert not [1 for i, a, b in spans if re.fullmatch(r"[0-9 -]{13,}", text[i][a:b])]


def plain_bootstrap(edges):
    """Scores of instances after all rounds, from {(pattern, instance): is seed}."""

    def form(v):
        kinds = [k for k, alphabet in (("x", "[0-9a-f]+"), ("X", "[0-9A-F]+"), ("w", "[0-9A-Za-z+/=_-]+")) if re.fullmatch(alphabet, v)]
        if kinds and len(v) >= 16 and len(set(v)) >= 10 and re.search("[0-9]", v) and re.search("[A-Za-z]", v):
            return f"{kinds[0]}{len(v)}"

    edges = edges | {(f"F {form(i)}", i): False for (p, i), seed in edges.items() if p[0] == "K" and form(i) and not seed}
    own = {}
    for p in {p for p, _ in edges if p[0] in "KF"}:
        forms = [form(i) for q, i in edges if q == p]
        most = max((forms.count(f) for f in forms if f), default=0)
        own[p] = most / (len(forms) + pii.DAMPING) if most >= pii.SUPPORT else 0.0
    score = {}
    for (_, i), seed in edges.items():
        score[i] = max(score.get(i, 0.0), float(seed))
    for _ in range(pii.ROUNDS):
        members = defaultdict(list)
        for p, i in edges:
            members[p].append(score[i])
        conf = {p: sum(v) / (len(v) + pii.DAMPING) for p, v in members.items() if sum(x >= pii.CONFIDENT for x in v) >= pii.SUPPORT}
        conf = {p: max(conf.get(p, 0.0), own.get(p, 0.0)) for p in members}
        conf = {p: c for p, c in conf.items() if c >= pii.CONFIDENT}
        doubt = defaultdict(lambda: 1.0)
        for p, i in edges:
            doubt[i] *= 1 - min(conf.get(p, 0.0), 0.999)
        score = {i: max(s, 1 - doubt[i]) for i, s in score.items()}
    return {i for i, s in score.items() if s >= pii.CONFIDENT} - {i for (_, i), seed in edges.items() if seed}


def test_graph_scores_equal_a_plain_version(spark):
    rng = random.Random(11)
    for share in (0.3, 0.7):
        seeds = {f"i{k}" for k in range(120) if rng.random() < share}
        edges = {(f"L p{rng.randrange(20)}", i): i in seeds for i in (f"i{rng.randrange(120)}" for _ in range(500))}
        frame = spark.createDataFrame([(p, i, s) for (p, i), s in edges.items()], "pattern string, instance string, seed boolean")
        got = {r["instance"] for r in pii.bootstrap(frame).collect()}
        assert got == plain_bootstrap(edges)
    assert got


def test_trust_goes_from_keys_to_formats_to_words(spark):
    """Random strings of one key: their format is trusted, then a rare key of that format and the words beside them, then what else stands there."""
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 6)) + "12ab34"
    edges = {}
    for k in range(30):
        v = hexes(32)
        edges[("K rare=" if k < 2 else f"K key{k % 3}=", v)] = False
        edges[(f"L word{k % 3}", v)] = False
    edges |= {("K size=", f"2024-0{k}-1x{k}{k}{k}") : False for k in range(9)} | {("L word0", "AB-123-456"): False, ("K mail:", "a@b.org"): True, ("L size", "AB-999-123"): False}
    frame = spark.createDataFrame([(p, i, s) for (p, i), s in edges.items()], "pattern string, instance string, seed boolean")
    got = {r["instance"] for r in pii.bootstrap(frame).collect()}
    assert got == plain_bootstrap(edges) and "AB-123-456" in got and "AB-999-123" not in got and not [i for i in got if i.startswith("2024")]


def test_words_of_patterns_are_whole():
    far, key = " " * 500, "k" * 200
    for text, want in (
        (f"left {key}1={far}ab12345678{far}right", ["L left", "R right"]), ('say "client_secret": "ab12345678", more', ["K client_secret:", "L say", "R more"]),
        ("x=ab12345678=cd12345678", ["K ab12345678=", "L x"]), ("ab12345678", []), (f"{'p' * 90} ab12345678", None),
    ):
        got = pii.occurrences(text, [])[0][4]
        assert want is None or [p for p in got if not p.startswith("K ") or len(p) < 30] == want
    assert pii.occurrences(f"{key}1=ab12345678", [])[0][4] != pii.occurrences(f"{key}2=ab12345678", [])[0][4]


def test_classifier(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op7_classifier"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all() and got["score"].between(0, 1).all()
    held = labels[labels["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(odd, none).collect()} == {0.5}
    assert classifier.classify(odd.limit(0), none).count() == 0
    both = spark.createDataFrame([(i, (i or 0) % 2) for i in (1, 2, 3, 4, None)] + [(5, None)], "doc_id long, quality int")
    assert classifier.classify(odd, both).count() == odd.count()


def plain_statistics(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if x]
    n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
    count = lambda p: len(re.findall(p, t))
    import unicodedata

    return (
        len(w), chars / n, count(r"[#*$%&|<>{}=_~^\\]") / n, sum(unicodedata.category(c) == "Lu" for c in t) / chars, count("[0-9]") / chars, len(set(w)) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n, (len(lines) - len(set(lines))) / max(len(lines), 1), count("[!?]") / n, len(lines) / n,
        (w.count(w[0]) if w else 0) / n, sum(len(x) <= 3 for x in w) / n,
    )


def test_classifier_statistics_and_compiled_rules(spark, docs, texts, odd):
    """Statistics against a plain version; a score against the rules applied one by one; both on odd rows too."""
    rows = docs.select("text").union(odd.select("text")).select("text", classifier.statistics(F.col("text")).alias("s")).collect()
    for r in rows:
        assert np.allclose(tuple(r["s"]), plain_statistics(r["text"]))
    x = np.array([tuple(r["s"]) for r in rows])
    y = ((x[:, 5] > np.median(x[:, 5])) & (x[:, 1] > np.median(x[:, 1]))).astype(float)
    intercept, rules = classifier.fit(x, y)
    assert rules and any(len(rule.terms) > 1 for rule, _ in rules)
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, " + ", ".join(f"{n} double" for n in classifier.STATISTICS))
    got = {r["i"]: r["p"] for r in frame.select("i", classifier.score_column(F.struct(*classifier.STATISTICS), intercept, rules).alias("p")).collect()}
    for i, v in enumerate(x):
        z = intercept + sum(w for rule, w in rules if all((v[f] > cut) if above else (v[f] <= cut) for f, above, cut in rule.terms))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.mean((np.array([got[i] for i in range(len(x))]) > 0.5) == y) > 0.9


def test_the_sample_is_of_both_labels(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert len({r["score"] for r in classifier.classify(docs, labels, sample=60).collect()}) > 1


def packed(rows, total):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return by_doc, by_sequence


def test_packing(spark, sf, texts, odd):
    from tokenizers import Tokenizer

    rows = registry.queries()["op8_packing"](spark, sf).collect()
    model = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_sequence = packed(rows, None)
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        raw, at = struct.pack(f"<{len(ids)}I", *ids), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids)
    lengths = [sum(r["length"] for r in s) for s in by_sequence.values()]
    padding = sum(4096 - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(lengths) + 4096
    out = packing.pack(odd, packing.tokenizer_path()).collect()
    _, sequences = packed(out, None)
    assert sum(r["length"] for r in out if r["doc_id"] in (2, 3, 6)) == 3 and len([r for r in out if r["doc_id"] == 1 and r["start"] == 0]) == 2
    assert packing.pack(odd.limit(0), packing.tokenizer_path()).count() == 0


def test_cuts_are_whole_and_of_full_classes():
    for n in range(1, 9000):
        c = packing.cuts(n)
        assert sum(c) == n and all(4096 // (4096 // s) == s for s in c)


def test_mixing(spark, sf, duck, same, odd):
    query, sql = registry.queries()["op10_mixing"], mixing.SQL
    same(query(spark, sf).drop("draws").toPandas(), duck(sql))
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for part in by.values():
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 1 and part[0]["source_size"] == sum(r["size"] for r in part)
    assert sum(p[0]["target"] for p in by.values()) <= 1.5 * sum(r["size"] for r in rows) + 1e-6
    mixed = mixing.mixed_documents(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert mixed.select(F.sum(quality_size())).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def quality_size():
    return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))


def test_the_tree_deals_exact_quotas():
    counts = np.array([1000, 10, 0, 333])
    out = mixing.split_quotas(counts, 8, 3)
    assert (out.sum(axis=0) == counts).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 8
    assert (out == mixing.split_quotas(counts, 8, 3)).all()


def test_shards_have_hypergeometric_compositions():
    counts, shards, runs = np.array([300, 90, 10]), 8, 1500
    draws = np.array([mixing.split_quotas(counts, shards, seed) for seed in range(runs)])
    total, share = counts.sum(), counts / counts.sum()
    size = total // shards
    spread = size * share * (1 - share) * (total - size) / (total - 1)
    assert (draws.sum(axis=2) == size).all()
    assert (np.abs(draws.mean(axis=0) - size * share) < 5 * np.sqrt(spread / runs)).all()
    assert (np.abs(draws.var(axis=0) / spread - 1) < 0.3).all()


def test_words_are_drawn_by_the_shards_of_the_tree(spark, sf, docs, tmp_path):
    """The query against a plain version: quotas, blocks, what the tree deals, and what each document gives to which shard."""
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in registry.queries()["op10_mixing"](spark, sf).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    by = defaultdict(list)
    for i, r in rows.items():
        by["null" if r["source"] is None else "=" + r["source"]].append(i)
    want, blocks = defaultdict(list), {}
    for skey, ids in by.items():
        whole = sum(got[i]["size"] for i in ids)
        target = int(got[ids[0]]["target"])
        for e, quota in ((1, min(target, whole)), (2, max(0, target - whole))):
            at = 0
            for i in sorted(ids, key=lambda i: digest(f"{i}:mix:{e}")):
                words = min(got[i]["size"], quota - at)
                if words > 0:
                    block = int(digest(f"{i}:mix:{e}")[:3], 16)
                    blocks.setdefault((e, skey), []).append(block)
                    want[i].append((e, words, digest(f"{i}:mix:place{e}"), skey, block))
                    at += words
    shard = {}
    for i, r in got.items():
        draws = [d.split(":") for d in r["draws"].split(",") if d]
        assert [(int(d[0]), int(d[2]), d[3]) for d in draws] == [w[:3] for w in want[i]]
        for d, (e, _, _, skey, block) in zip(draws, want[i], strict=True):
            assert shard.setdefault((e, skey, block), int(d[1])) == int(d[1])
    for (e, skey), taken in blocks.items():
        dealt = [shard[(e, skey, b)] for b in sorted(set(taken))]
        assert dealt == sorted(dealt)  # each shard draws a range of the permuted blocks
    held = [list(shard.values()).count(s) for s in range(mixing.SHARDS)]
    assert sum(held) == len(shard) and max(held) - min(held) <= 1

    mixing.write_shards(docs, str(tmp_path / "mix"))
    written = spark.read.parquet(str(tmp_path / "mix"))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["shard"], words(r["text"])) for r in written.collect()) == sorted((i, shard[w[0], w[3], w[4]], w[1]) for i, ws in want.items() for w in ws)
    for f in (tmp_path / "mix").glob("shard=*/*.parquet"):
        places = spark.read.parquet(str(f)).select("place").toPandas()["place"].tolist()
        assert places == sorted(places)


def plain_plan(sizes):
    order = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight, cap = [mixing.WEIGHTS[i % 3] for i in range(len(order))], [2 * n for _, n in order]
    full = set()
    while len(full) < len(order):
        unit = (1.5 * sum(n for _, n in order) - sum(cap[i] for i in full)) / sum(weight[i] for i in range(len(order)) if i not in full)
        over = {i for i in range(len(order)) if i not in full and weight[i] * unit >= cap[i]}
        if not over:
            break
        full |= over
    return {s: (n, float(cap[i]) if i in full else weight[i] * unit) for i, (s, n) in enumerate(order)}


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    many = [(f"s{i}" if i else None, rng.choice([0, 1, 7, 50, 10**6])) for i in range(12_000)]
    for sizes in (many, [("b", 100), (None, 50), ("a", 10), ("c", 1)], [("a", 0)], [("a", 5)]):
        got = {r["source"]: (r["size"], r["target"]) for r in mixing.source_plan(spark.createDataFrame(sizes, "source string, size long")).collect()}
        want = plain_plan(sizes)
        assert got.keys() == want.keys() and all(got[s][0] == n and abs(got[s][1] - t) < 1e-6 * max(1, t) for s, (n, t) in want.items())


def test_mix_of_repeated_and_nameless_rows(spark):
    """Quotas end among rows that share an id; rows without an id are told apart by their texts."""
    rows = [(7, "w " * n, "a") for n in (5, 9, 9, 1)] + [(None, f"x{i} " * 4, "b") for i in range(300)] + [(i, "y z", "c") for i in range(50)] + [(None, None, "b"), (1, "", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        part = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in part) == int(part[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in part)
        assert all(sum(d["words"] for d in r["draws"]) == r["taken"] and all(d["shard"] is not None for d in r["draws"]) for r in part)
    assert 1 < len({r["taken"] for r in got if r["source"] == "b"}) and len({d["shard"] for r in got for d in r["draws"]}) > 4
