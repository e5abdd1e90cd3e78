"""HyperMinHash near-duplicates against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest

from scriptorium.llm import hyperminhash, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """(doc_id, n, component, kept) of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]
    return sorted(map(str, out))


def got(frame, **kw):
    return sorted(str(tuple(r)) for r in hyperminhash.near_duplicates(frame, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_query_equals_its_sql_and_brute_force(spark, sf, duck, same, texts):
    out = registry.queries()["op12_hyperminhash"](spark, sf)
    same(out.toPandas(), duck(registry.oracle_sql()["op12_hyperminhash"]))
    assert sorted(str(tuple(r)) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()) == plain(sorted(texts.items()))


@pytest.mark.parametrize("block", [2048, 3])
def test_chains_dense_groups_and_small_sets(spark, block):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([f"x{k}" for k in range(i)] + base[i:]) for i in range(0, 60, 3)]
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 9)):
            w[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    small = [f"s{i}" for i in range(9)]
    texts += [" ".join(small[:n]) for n in range(1, 10)] + [" ".join(small[:8] + ["Z"]), " ".join(small).upper()] + ["one two three four"] * 70
    texts += [" ".join(small[a:] + small[:a]) for a in range(4)] + ["a b c d a b c d a", "b c d a b c d a b c"]  # one set in two texts
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = plain(rows)
    assert 5 < len({x.split(", ")[2] for x in want}) < len(texts) - 60
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), block=block) == want


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd.withColumnRenamed("fp", "sketch").withColumnRenamed("copy", "node")) == plain(rows)
    assert got(odd.limit(0)) == []
    text = "null ids that are alike stay together with their kind"
    more = spark.createDataFrame([(None, text), (None, text), (5, None), (6, ""), (7, " \n"), (None, None)], "doc_id long, text string")
    assert got(more) == sorted(["(None, 7, None, True)"] * 2 + ["(5, 0, 5, True)", "(6, 0, 6, True)", "(7, 0, 7, True)", "(None, 0, None, True)"])


def test_registers_are_zeros_and_mantissas_of_the_least_hash():
    rng = np.random.default_rng(2)
    h = np.unique(np.concatenate((rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.array([0, 1 << 57, (1 << 57) | 1, (5 << 57) | 15], dtype=np.uint64))))
    want = {}
    for v in h.tolist():
        want.setdefault(v >> 57, v)
    for b, r in enumerate(hyperminhash.registers(h).tolist()):
        if b not in want:
            assert r == hyperminhash.EMPTY
            continue
        rest = f"{want[b] & ((1 << 57) - 1):057b}"[:53]
        zeros = len(rest) - len(rest.lstrip("0"))
        assert r == zeros << 10 | (int((rest.lstrip("0")[1:] + "0" * 60)[:10], 2) if zeros < 53 else 0)


def test_estimates_are_right_on_average_and_accidents_are_allowed_for():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for size, share in ((30, 0.8), (400, 0.8), (4000, 0.5), (4000, 0.0)):
        both = round(2 * size * share / (1 + share))
        found, n = [], []
        for _ in range(200):
            common = draw(both)
            a, b = (hyperminhash.registers(np.unique(np.concatenate((common, draw(size - both))))) for _ in "ab")
            j, m = hyperminhash.estimate(a, b, size, size)
            found.append(j), n.append(m)
            assert share < 0.8 or hyperminhash.likely(a, b)
        true = both / (2 * size - both)
        assert abs(np.mean(found) - true) < 4 * np.sqrt(true * (1 - true) / np.mean(n) / 200) + 0.002
    alone = np.stack([hyperminhash.registers(np.unique(draw(4000))) for _ in range(200)])
    agree = np.mean([(alone[i] == alone[i + 1 :]).mean() for i in range(199)])
    assert 0.7 < agree / hyperminhash.accident(4000, 4000) < 1.6
