"""Hard-negative mining by exact inner products, with an orthogonal PCA rotation that lets most products end early.

Rows. Every component becomes floor(256 * x), an integer; a row's score with an anchor is their integer inner product. An
anchor's positives are its ``positives`` best other rows of its label; for each of them the hard negatives are the ``k`` best
rows of other labels whose score lies in a window below the positive's.

Rotation. The eigenvectors of the second moments of at most ``SAMPLE`` rows (the smallest by a hash), largest first, are an
orthogonal basis, so inner products are the same in it, and most of each lies in the leading components. A block multiplies a
few leading components of all its rows with a slice of anchors and adds more in steps (``STEPS``). What is left of a product is at
most the product of the residual norms; with that and slack for rounding each row has an upper and a lower bound. Rows that cannot reach the floor
of any window, or lie above all of them, are dropped; the k best lower bounds of a window raise its floor. Survivors are verified with
integer products, which alone are returned: the rotation and its sample decide about work, never about results.

Dealing. All rows are dealt by a hash into blocks of about ``BLOCK``, anchors into lists of ``LISTS``; a block and a list meet in one
task. A first round takes a ``FIRST``-th of the rows, whose k-th best score is each window's floor for the rest, so blocks emit little.

Edge cases: rows with a null label, a null or empty vector, or any null or non-finite component take no part; nor do vectors of another
length than the most common one, or with components so large that the hundredfold of a product might not fit a long; zero vectors do take part. Repeated ids
are rows of their own, each with its own positives and negatives; ties go to the smaller id. A label that has no other row, or too few, gives what
there is; a window without rows gives none, as does a positive of a negative score (its window is empty). Long vectors
are multiplied whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of its positive's, both ends included.
LEAST, MOST = 30, 90
SAMPLE = 16_384
BLOCK, LISTS = 65_536, 4_096
#: Rows of a block where the table is small, so that no task stands idle.
SMALL_BLOCK = 2_000
#: Shares of the components after which bounds are compared; anchors multiplied at a time.
STEPS = (0.125, 0.25, 0.5)
SLICE = 64
FIRST = 16
#: Slack for rounding, relative to the vectors' lengths: well above the error bound of 64-bit products and of the rotation.
SLACK = 2.0**-46
_FOUND = "anchor long, w int, row long, vec_id long, score long"
FAR = (1 << 62) - 1


def valid(df: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part: ``row`` a unique long, labels flipped for each seventh id, components as integers."""
    e = F.col("embedding")
    fit = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(fit)
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = length["n"] if length else 1
    most = min(2**31 - 1, math.isqrt(2**55 // n)) / SCALE
    rows = rows.where((F.size("embedding") == n) & F.forall("embedding", lambda x: F.abs(x) < most - 1))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def rotation(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The eigenvectors of the second moments of a sample of at most ``sample`` rows, as columns, largest first."""
    v = np.array([r[0] for r in rows.orderBy(F.xxhash64("row"), "row").select("v").limit(sample).collect()], dtype=np.float64)
    _, vectors = np.linalg.eigh(v.T @ v)
    return vectors[:, ::-1]


class Block:
    """Rows of a block, rotated, with the residual norms after each step."""

    def __init__(self, v: np.ndarray, basis: np.ndarray, steps: list[int]) -> None:
        self.v, self.rotated = v, v @ basis
        squares = self.rotated**2
        self.rest = {s: np.sqrt(squares[:, s:].sum(axis=1)) for s in steps}
        self.norm = np.sqrt(squares.sum(axis=1))


def _floors(low: np.ndarray, high: np.ndarray, windows: np.ndarray, k: int) -> np.ndarray:
    """Each window's floor, raised to the k-th best lower bound of the rows that surely lie in it."""
    out = windows[:, 2].astype(np.float64)
    for w, (least, most, _) in enumerate(windows):
        sure = low[(low >= least) & (high <= most)]
        if len(sure) >= k:
            out[w] = max(out[w], np.partition(sure, len(sure) - k)[len(sure) - k])
    return out


def _mined(basis: np.ndarray, k: int, same: bool, shares: tuple[float, ...] = STEPS):
    """The k best rows of each window of each anchor of a list within a block."""
    dim = len(basis)
    steps = sorted({min(dim, max(1, round(s * dim))) for s in shares})

    def run(vectors: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(vectors) and len(anchors):
            rows, ids, labels = (vectors[c].to_numpy() for c in ("row", "vec_id", "label"))
            block = Block(np.stack(vectors["v"].to_numpy()).astype(np.int64), basis, steps)
            asked = Block(np.stack(anchors["v"].to_numpy()).astype(np.int64), basis, steps)
            slack = SLACK * dim**1.5
            names, their = anchors["anchor"].to_numpy(), anchors["label"].to_numpy()
            windows = [np.array([[x["least"], x["most"], x["floor"]] for x in ws], dtype=np.int64).reshape(-1, 3) for ws in anchors["windows"]]
            first = steps[0]
            for at in range(0, len(anchors), SLICE):
                leading = block.rotated[:, :first] @ asked.rotated[at : at + SLICE, :first].T
                for i in range(at, min(at + SLICE, len(anchors))):
                    fit = (labels == their[i]) & (rows != names[i]) if same else labels != their[i]
                    left = np.flatnonzero(fit)
                    part, done = leading[left, i - at], first
                    for step in [*steps, None]:
                        if not len(left) or not len(windows[i]):
                            break
                        step = dim if step is None else step
                        if step > done:
                            part = part + block.rotated[left, done:step] @ asked.rotated[i, done:step]
                            done = step
                        spread = slack * block.norm[left] * asked.norm[i] + 1e-6
                        if step < dim:
                            spread += block.rest[step][left] * asked.rest[step][i]
                        low, high = part - spread, part + spread
                        floors = _floors(low, high, windows[i], k)
                        keep = ((high[:, None] >= floors) & (low[:, None] <= windows[i][:, 1])).any(axis=1)
                        left, part = left[keep], part[keep]
                    if not len(left):
                        continue
                    scores = block.v[left] @ asked.v[i]
                    for w, (least, most, floor) in enumerate(windows[i].tolist()):
                        inside = np.flatnonzero((scores >= max(least, floor)) & (scores <= most))
                        best = inside[np.lexsort((rows[left[inside]], ids[left[inside]], -scores[inside]))[:k]]
                        out += [(names[i], w, rows[left[b]], ids[left[b]], scores[b]) for b in best]
        return pd.DataFrame(out, columns=["anchor", "w", "row", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(rows: DataFrame, anchors: DataFrame, basis: np.ndarray, k: int, *, same: bool, block: int = BLOCK, lists: int = LISTS) -> DataFrame:
    """(anchor, w, place, row, vec_id, score): the k best rows in each window of each anchor.

    rows: (row, vec_id, label, v). anchors: (anchor, label, v, windows), the anchor being a row and windows an array of structs (least, most), ends included.
    Candidates are other rows of the anchor's label (``same``) or all rows of other labels.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    total, asked = rows.count(), anchors.count()
    part = lambda key, n: F.pmod(F.xxhash64(key, F.lit(2)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    early = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(FIRST)) == 0
    found = None
    for share, chosen in ((1 / FIRST, early), (1 - 1 / FIRST, ~early)):
        blocks = max(1, math.ceil(total * share / block), min(4 * parallel, math.ceil(total * share / SMALL_BLOCK)))
        n = max(1, math.ceil(asked / lists))
        known = anchors.withColumn("windows", F.transform("windows", lambda w: F.struct(w["least"].alias("least"), w["most"].alias("most"), F.lit(-FAR).alias("floor"))))
        if found is not None:
            # A window that has k rows already takes none below the least of them.
            floors = found.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
            floors = floors.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("floors"))
            raised = F.transform("windows", lambda w, i: F.struct(w["least"].alias("least"), w["most"].alias("most"), F.coalesce(F.try_element_at("floors", i), w["floor"]).alias("floor")))
            known = known.join(floors, "anchor", "left").withColumn("windows", raised).drop("floors")
        v = rows.where(chosen).select(part("row", blocks).alias("block"), each(n).alias("list"), "row", "vec_id", "label", "v")
        q = known.select(each(blocks).alias("block"), part("anchor", n).alias("list"), "anchor", "label", "v", "windows")
        got = v.groupBy("block", "list").cogroup(q.groupBy("block", "list")).applyInPandas(_mined(basis, k, same), _FOUND)
        found = materialize(_best(got if found is None else got.union(found.drop("place")), k))
    return found


def hard_negatives(df: DataFrame, *, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, **kw) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label) rows."""
    rows = materialize(valid(df))
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    basis = rotation(rows)
    anchors = materialize(rows.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"))
    any_score = F.array(F.struct(F.lit(-FAR).alias("least"), F.lit(FAR).alias("most")))
    near = mine(rows, anchors.select("anchor", "label", "v", any_score.alias("windows")), basis, positives, same=True, **kw)
    score = F.col("score")
    lowest, highest = F.expr(f"({least} * score + 99) div 100"), F.expr(f"({most} * score) div 100")
    window = F.struct(F.col("place").alias("p"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"), lowest.alias("least"), highest.alias("most"))
    asked = near.where("score >= 0").select("anchor", window.alias("x")).groupBy("anchor").agg(F.array_sort(F.collect_list("x")).alias("windows"))
    asked = materialize(anchors.join(asked, "anchor"))
    far = mine(rows, asked.select("anchor", "label", "v", "windows"), basis, negatives, same=False, **kw)
    # A window's number is its place among the anchor's positives.
    names = asked.select("anchor", "anchor_id", F.posexplode("windows").alias("w", "x")).select("anchor", "anchor_id", "w", "x.positive_id", "x.positive_score")
    return far.join(names, ["anchor", "w"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
