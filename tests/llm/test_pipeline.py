import re

import numpy as np
import pandas as pd

import corpus_pipeline
from scriptorium.llm import lists, pii, simhash
from scriptorium.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, docs, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "pii", "mixing", "packing"]
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, kept, sf))
        seen.append(kept)
    filtered, single, clean, mixed, packed = seen
    assert all(d.columns == COLUMNS for d in seen[:4])
    assert {r["doc_id"]: r["text"] for r in filtered.collect()}.items() <= texts.items()
    groups = {}
    for r in simhash.near_duplicates(filtered).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert {r["doc_id"] for r in single.collect()} == set(groups)
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not [s for s in pii.base_spans(r["text"]) if s[0] == "email"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {r["doc_id"]: words(r["text"]) for r in clean.collect()}
    drawn = {}
    for r in mixed.collect():
        drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + words(r["text"])
    assert all(n <= 2 * size[i] for i, n in drawn.items()) and abs(sum(drawn.values()) - 1.5 * sum(size.values())) <= 20
    assert {r["doc_id"] for r in packed.collect()} == set(drawn)


def test_stages_take_odd_rows(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.count() > 0 or name == "quality_rules"
        assert stage(spark, odd.limit(0), sf).count() == 0
        if name != "packing":
            assert out.columns == odd.columns
    one = corpus_pipeline.near_duplicates(spark, odd, sf)
    assert one.where("doc_id = 1").count() == 1 and one.where("doc_id IS NULL").count() == 1


def test_near_copies_of_five_word_shingles(spark, docs, texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, ids = {i: shingles(t) for i, t in texts.items()}, sorted(texts)
    root = {i: i for i in ids}
    near = [(i, j) for i in ids for j in ids if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in ids:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert any(bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).count("1") > 2 for i, j in near)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == root


def test_groups_of_long_lists_in_blocks(spark):
    """A chain of edited copies, alike only nearby, and strangers that share much: blocks and ends change nothing."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([f"x{k}" for k in range(i)] + base[i:]) for i in range(0, 60, 3)]
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 9)):
            w[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i, a in enumerate(shingles):
            for j in range(i):
                if len(a & shingles[j]) >= 0.8 * len(a | shingles[j]):
                    root[i] = root[j] = min(root[i], root[j])
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert 5 < len(set(root)) < len(texts) - 5
    for kw in ({}, {"block": 3}, {"block": 7}):
        got = {r["row"]: r["root"] for r in simhash.row_groups(rows, **kw).collect()}
        assert [got[i] for i in range(len(texts))] == root


def test_one_row_of_a_group_whatever_its_id(spark, sf):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, text), (1, text + " end"), (2, "some other text"), (2, text), (3, "of a third kind"), (3, "another of id three"), (None, "null but alone")]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, frame, sf).collect()}
    assert got == {(1, text + " end"), (2, "some other text"), (3, "of a third kind"), (3, "another of id three"), (None, "null but alone")}


def test_wide_fingerprints_are_simhashes_listed_by_byte_positions():
    """Every bit is a vote of all shingles, and pairs at the threshold meet in lists of equal bytes and reach the tally."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 64, 300):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert simhash.wide_fingerprint(h, 24).tolist() == plain_votes(h, 24)
    for common, a, b in ((4, 0, 1), (12, 0, 3), (100, 0, 25), (80, 10, 10)):
        h = rng.integers(0, 1 << 63, common + a + b, dtype=np.uint64)
        x, y = np.sort(h[: common + a]), np.sort(np.concatenate((h[:common], h[common + a :])))
        n = min(simhash.conjunctions(len(x)), simhash.conjunctions(len(y)))
        f, g = (simhash.wide_fingerprint(v, 3 * n).reshape(n, 3) for v in (x, y))
        both = {(s, int(k)) for s, keys in enumerate(simhash.posting_keys(x)) for k in keys} & {(s, int(k)) for s, keys in enumerate(simhash.posting_keys(y)) for k in keys}
        assert len(both) == (f == g).all(axis=1).sum() > 0
        assert simhash.tallied(f.reshape(1, -1)[:, : simhash.TALLIED], g.reshape(1, -1)[:, : simhash.TALLIED]).all()
    assert not simhash.tallied(rng.integers(0, 256, simhash.TALLIED), rng.integers(0, 256, simhash.TALLIED))


def plain_votes(h, size):
    m = simhash._multipliers(size // 8)
    x = [[(int(v) + int(p)) * int(q) % 2**64 for p, q in m] for v in h]
    bits = [sum(((w[i // 64] ^ w[i // 64] >> 32) >> i % 64) & 1 for w in x) * 2 > len(h) for i in range(8 * size)]
    return [sum(bits[8 * k + j] << j for j in range(8)) for k in range(size)]


def test_lists_that_go_on_in_the_next_batch():
    rows = [(1, 5), (2, 3), (2, 4), (2, 9), (3, 1), (4, 2), (4, 6)]
    for cut in range(len(rows) + 1):
        for cut2 in range(cut, len(rows) + 1):
            parts = [pd.DataFrame(p, columns=["key", "node"], dtype="int64") for p in (rows[:cut], rows[cut:cut2], rows[cut2:])]
            got = [tuple(int(v) for v in r) for df in lists._listed(iter(parts)) for r in df.itertuples(index=False)]
            assert got == [(2, 3, 3), (2, 4, 3), (2, 9, 3), (4, 2, 2), (4, 6, 2)]


def test_packed_postings_are_listed_whole_in_any_pieces(monkeypatch):
    """Groups are read back whole, and lists that go on from piece to piece keep the member they are known by."""
    rng = np.random.default_rng(5)
    node, slice_, key = np.repeat(np.arange(400), 5), rng.integers(0, 4, 2000), rng.integers(-20, 20, 2000).astype(np.int32)
    want = {}
    for s, k, n in zip(slice_.tolist(), key.tolist(), node.tolist(), strict=True):
        want.setdefault((s, k), []).append(n)
    for far in (1, 1 << 20, 1 << 40):
        for bits, piece in ((0, 1 << 18), (0, 7), (3, 50)):
            monkeypatch.setattr(lists, "GROUP", piece)
            parts = [lists.packed(node[i : i + 500] * far, slice_[i : i + 500], key[i : i + 500], bits) for i in range(0, 2000, 500)]
            rows = pd.concat(parts).sort_values(["group", "first"], kind="stable")
            found = pd.concat(lists._listed(lists._unpacked(iter([rows.iloc[:9], rows.iloc[9:]]))))
            got = {}
            for k, n, low in found.itertuples(index=False):
                got.setdefault((k >> 32 + bits, int(np.uint32(k & 0xFFFFFFFF).astype(np.int32))), []).append((n // far, low // far))
            assert {at: sorted(n for n, _ in members) for at, members in got.items()} == {at: sorted(n) for at, n in want.items() if len(n) > 1}
            assert all(len({low for _, low in members}) == 1 for members in got.values())


def test_workers_keep_one_operators_tables():
    from scriptorium.llm import common

    a = common.kept(("a",), list)
    assert common.kept(("a",), list) is a
    common.kept(("b",), dict)
    assert list(common._kept) == [("b",)]


def test_lists_are_cut_only_where_no_similar_sizes_meet(monkeypatch):
    """Strangers of far sizes leave their lists; similar sizes stay together in whatever pieces, and groups in several pieces are not cut."""
    pairs = [(a, b) for a in range(1, 400) for b in range(a, 400) if a >= 0.8 * b - 1e-9]
    assert all(lists.size_class(b, 0.8) - lists.size_class(a, 0.8) <= lists.CLASSES + 1 for a, b in pairs)
    rng = np.random.default_rng(8)
    n = np.sort(rng.integers(1, 3000, 900))
    node, key, size = np.arange(900), rng.integers(0, 60, 900).astype(np.int32), np.array([lists.size_class(int(x), 0.8) for x in n])
    found = {}
    for piece in (1 << 18, 40):
        monkeypatch.setattr(lists, "GROUP", piece)
        rows = pd.concat([lists.packed(node[i : i + 300], np.zeros(300, dtype=int), key[i : i + 300], 1, size[i : i + 300]) for i in (0, 300, 600)]).sort_values(["group", "first"], kind="stable")
        assert all(len(k) == 3 * m for k, m in zip(rows["keys"], rows["n"], strict=True))
        got = pd.concat(lists._listed(lists._unpacked(iter([rows.iloc[:2], rows.iloc[2:]]))))
        found[piece] = {(int(r.band), int(r.key)): set() for r in got.itertuples()}
        for r in got.itertuples():
            found[piece][int(r.band), int(r.key)].add(int(r.node))
        together = {(a, b) for m in found[piece].values() for a in m for b in m}
        assert all((a, b) in together for a in range(900) for b in range(a) if key[a] == key[b] and n[b] >= 0.8 * n[a] - 1e-9)
    met = {piece: sum(len(m) ** 2 for m in lists_.values()) for piece, lists_ in found.items()}
    assert met[1 << 18] < 0.7 * met[40]


def test_shingle_codes_tell_shingles_apart():
    words = [b"a", b"b", b"a", b"b", b"c", b"a", b"b", b"a", b"b", b"c", b"b", b"a"]
    for k in (2, 3, 5):
        code, plain = lists.shingle_codes(words, k).tolist(), [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert len(code) == len(plain) and all((code[i] == code[j]) == (plain[i] == plain[j]) for i in range(len(code)) for j in range(i))
    assert lists.shingle_codes([], 5).tolist() == [] and len(lists.shingle_codes(words[:3], 5)) == 1
