"""The alignment against whole texts, encoded in one piece and cut by byte offsets."""

import hashlib
from collections import Counter, defaultdict

import pytest

from scriptorium.llm import registry, token_align
from scriptorium.llm.packing import tokenizer_path

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plain(models, texts):
    """What each text should give, in the order of texts."""
    a_model, b_model = models
    letters = token_align.byte_letters()
    names = {i: w for w, i in a_model.get_vocab().items()}
    groups, links = [], []
    for t in texts:
        groups.append([])
        links.append([])
        if not t:
            continue
        a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        ab = [bytes(letters[c] for c in names[i]) for i in a]
        bb = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            continue
        ends = [{}, {}]
        for side, pieces in enumerate((ab, bb)):
            n = 0
            for k, p in enumerate(pieces):
                n += len(p)
                ends[side][n] = k
        i = j = 0
        for n in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][n], ends[1][n]
            groups[-1].append((a[i : x + 1], b[j : y + 1]))
            links[-1].append((a[x], b[y]))
            i, j = x + 1, y + 1
    counts = Counter(p for ls in links for p in ls)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for g, ls in zip(groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), digest))
    return out


def test_whole_table(spark, sf, texts, models):
    ids = sorted(texts)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in registry.queries()["op13_token_align"](spark, sf).collect()}
    assert [got[i] for i in ids] == plain(models, [texts[i] for i in ids])


def test_odd_texts_and_few_broadcast_pairs(spark, odd, models):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    more = ["  two  leading", "a\n b\n  c \t d", "x <|endoftext|> </s> [INST] y", "has ▁ mark", "tab\x1c end", "a b c　 d", "don't  we'll '  s", "﻿ é \U0001f9d1‍\U0001f680 flags", " ", "\n", "x" * 300 + " " + "中文" * 200, "nul\x00 byte \x7f"]
    rows += [(100 + i, t) for i, t in enumerate(more)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, pair int, Pairs string")
    want = sorted(map(str, zip([i for i, _ in rows], plain(models, [t for _, t in rows]), strict=True)))
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    for share in (token_align.SHARE, 20):
        got = token_align.align(frame, *paths, share=share).collect()
        assert sorted(str((r["doc_id"], tuple(r[c] for c in COLUMNS))) for r in got) == want
    assert sum(r["n_links"] == 0 for r in got) == 3  # null, empty, and the text with U+2581
    assert token_align.align(frame.limit(0), *paths).count() == 0


def test_transducer():
    a, b = [b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"d", b"x"]
    t = token_align.Transducer(a, b, most=3)
    assert t.cuts([0, 1, 3], [0, 1, 3]) == [(2, 2), (3, 3)]
    assert t.cuts([2, 3], [2]) == [(2, 1)]
    assert t.cuts([2, 3], [0, 4]) is None and t.cuts([2], [2]) is None and t.cuts([2], [0, 1, 3]) is None
    assert t.cuts([], []) == []
    for _ in range(3):
        assert t.cuts([0, 1, 3, 2], [0, 1, 3, 0, 1]) == [(2, 2), (3, 3), (4, 5)]
    assert t.states[0] == (0, b"") and all(any(w.endswith(rest) for w in a + b) for _, rest in t.states)


def test_memory_in_generations(models, monkeypatch):
    monkeypatch.setattr(token_align, "MOST_UNITS", 5)
    monkeypatch.setattr(token_align, "TOGETHER", 12)
    aligner = token_align.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    for text in ("one two three four", "two five six", "one two seven eight nine ten", "z" * 70 + " one"):
        a, b = aligner._encoded(text)
        units = aligner.units([text])[0]
        assert (sum(u[0] for u in units), sum(u[1] for u in units)) == (len(a), len(b))
    assert len(aligner.known) <= 8 and not any(len(u) > token_align.LONGEST_UNIT for u in aligner.known)
