"""Hard negatives against all integer products, on tables with ties, copies, odd rows and many blocks."""

import math

import numpy as np
import pytest

from scriptorium.llm import hard_negatives, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    kept = []
    for i, e, label in rows:
        if label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for m, (j, other, w) in enumerate(kept) if m != n)
        for p, positive, *_ in [x for x in scored if x[3] == label][:5]:
            fit = [(s, j) for s, j, _, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, positive, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit[:10])]
    return sorted(out)


def got(frame, **kw):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, **kw).collect())


def test_query_equals_its_sql_and_brute_force(spark, sf, duck, same):
    out = registry.queries()["op11_hard_negatives"](spark, sf).toPandas()
    same(out, duck(registry.oracle_sql()["op11_hard_negatives"]))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, out[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]].to_numpy().tolist())) == plain(rows) != []


@pytest.mark.parametrize("kw", [{}, {"block": 40, "lists": 3}])
def test_ties_copies_and_odd_rows(spark, kw):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6)).round(1)
    rows = [(i, [float(np.float32(x)) for x in base[rng.integers(12)] + (rng.integers(0, 2, 6) / 8 if i % 3 else 0)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], 9 - i % 2) for i in range(1000, 1200)]  # one vector in a third of all rows
    rows += [(100, rows[5][1], 2), (100, rows[100][1], rows[100][2]), (-200, rows[7][1], 1), (-7, rows[8][1], 3), (2000, [0.0] * 6, 1), (2001, [0.0] * 6, 1), (2002, [0.0] * 6, 0)]
    odd = [(2100, None, 1), (2100, [], 1), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2100, [float("nan")] * 6, 1), (2100, [float("inf")] + [0.0] * 5, 1), (2100, rows[0][1], None), (2100, [1.0] * 5, 1), (2200, [3e38] * 6, 1), (None, rows[0][1], 1)]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows + odd], SCHEMA + ", row int, windows string, v double")
    want = plain(rows)
    assert {r[0] for r in want} >= {0, 100, 200, -200, 1000, 1100, 2000} and got(frame, **kw) == want


def test_tables_without_results(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1), (5, [1.0, 0.0], 2)], SCHEMA)
    assert got(frame) == got(frame.limit(0)) == got(frame.where("vec_id = 5")) == []
    opposite = spark.createDataFrame([(100, [1.0, 0.0], 1), (5, [-1.0, 0.0], 1), (6, [-0.5, 0.0], 2)], SCHEMA)
    assert got(opposite) == plain([tuple(r) for r in opposite.collect()]) == []


def test_rotation_ends_products_early_and_loses_nothing():
    """Rows along a few directions: after an eighth of the components few are left to verify, and bounds hold for all."""
    rng = np.random.default_rng(5)
    directions = np.linalg.qr(rng.normal(size=(64, 4)))[0]
    v = np.floor(256 * (rng.normal(size=(3000, 4)) @ directions.T + 0.003 * rng.normal(size=(3000, 64)))).astype(np.int64)
    _, basis = np.linalg.eigh((v.T @ v).astype(float))
    block = hard_negatives.Block(v, basis[:, ::-1], [8])
    part = block.rotated[:, :8] @ block.rotated[0, :8]
    spread = block.rest[8] * block.rest[8][0] + 1e-6
    exact = v @ v[0]
    assert (np.abs(exact - part) <= spread).all()
    kth = np.sort(part - spread)[-10]
    assert (part + spread >= kth).sum() < 60 and set(np.argsort(-exact)[:10]) <= set(np.flatnonzero(part + spread >= kth))
