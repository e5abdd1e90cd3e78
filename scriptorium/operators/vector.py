"""Exact nearest neighbours by Euclidean distance, filtered before the limit, for many questions.

Vectors lie in blocks, rings around pivots: a block holds vectors of one cell (those nearest to one
pivot) whose distances to the pivot are neighbours, and a small directory knows each block's least and
largest. Every question first scores the blocks nearest to it, enough for k vectors. Its k-th distance
is a bound: blocks that the triangle inequality puts beyond it are never read, and of the others
only vectors within it leave their task. Questions stay a table, blocks are shipped once for every
``QUESTIONS`` of them. Distances are computed in double precision, between vectors of one length.

Vectors and questions that are null, empty, or hold null or non-finite components take no part.
Questions have distinct qids; of equal distances (to nine decimals) the smaller id comes first.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X

#: Questions that meet a block at once.
QUESTIONS = 4096
#: Vectors of a block, at most.
BLOCK = 1024
#: Vectors that pivots are fitted on, at most; pivots are half the square root of that many.
SAMPLE = 4096
#: Question rows of one array of distances.
STEP = 64


@dataclass(frozen=True)
class PivotIndex:
    """Pivots by length of vector, and rows (block, dim, cell, low, high, n, ids, data): data are n * dim doubles."""

    pivots: dict[int, np.ndarray]
    blocks: DataFrame

    @property
    def directory(self) -> DataFrame:
        return self.blocks.select("block", "dim", "cell", "low", "high", "n")


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of every question to every vector, a block of questions at a time."""
    return np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in q]))


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k smallest distances and their ids; to nine decimals, ties to the smaller id."""
    order = np.lexsort((ids, np.round(d, 9)), axis=-1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))


def fit_pivots(sample: np.ndarray) -> np.ndarray:
    """Centres of the sample: the farthest from all before, one by one, then moved to the means of their cells."""
    chosen = [0]
    near = distances(sample, sample[:1])[0]
    while len(chosen) < max(1, math.isqrt(len(sample)) // 2) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[0])
    at = sample[chosen]
    for _ in range(3):
        cell = distances(at, sample).argmin(axis=1)
        at = np.stack([sample[cell == c].mean(axis=0) if (cell == c).any() else at[c] for c in range(len(at))])
    return at


def _to_pivots(df: pd.DataFrame, pivots: dict[int, np.ndarray]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """(length, rows, distances to its pivots) for each length of vectors; a length without pivots has the origin."""
    for dim, rows in df.groupby(df["embedding"].map(len)):
        yield int(dim), rows, distances(pivots.get(dim, np.zeros((1, dim))), np.stack(rows["embedding"].to_numpy()))


def _place(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for dim, rows, d in _to_pivots(df, pivots):
                yield rows.assign(dim=dim, cell=d.argmin(axis=1), r=d.min(axis=1))

    return run


def _pack(size: int):
    """Blocks of rows that come in the order of cell and distance; a block's number holds its partition's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for df in batches:
            out = []
            for (dim, cell), rows in df.groupby(["dim", "cell"], sort=False):
                for at in range(0, len(rows), size):
                    part = rows.iloc[at : at + size]
                    data = np.stack(part["embedding"].to_numpy()).astype("<f8").tobytes()
                    out.append((number, dim, cell, part["r"].iloc[0], part["r"].iloc[-1], len(part), list(part["id"]), data))
                    number += 1
            if out:
                yield pd.DataFrame(out, columns=["block", "dim", "cell", "low", "high", "n", "ids", "data"])

    return run


def build_index(vectors: DataFrame, chunks: DataFrame, *, visible: str | None, key: str = "chunk_id", block: int = BLOCK) -> PivotIndex:
    """The index of all visible chunks that have a vector; a cell of any size is cut by range."""
    kind = vectors.schema[key].dataType.simpleString()
    seen = chunks.where(X.visible(F.col("sensitivity"), visible)).select(key)
    rows = vectors.join(seen, key, "left_semi").select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("embedding")))
    sample: dict[int, list] = {}
    for r in rows.select("embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    pivots = {dim: fit_pivots(np.array(s, dtype=np.float64)) for dim, s in sample.items()}
    placed = rows.mapInPandas(_place(pivots), f"id {kind}, embedding array<double>, dim int, cell int, r double")
    # Equal vectors are told apart by their ids, so that copies do not make one range.
    order = ["dim", "cell", "r", F.xxhash64("id")]
    packed = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_pack(block), f"block long, dim int, cell int, low double, high double, n int, ids array<{kind}>, data binary")
    return PivotIndex(pivots, scratch.write(packed))


def _bounds(asked: DataFrame, index: PivotIndex) -> DataFrame:
    """(qid, block, n, d, gap, before): a least distance of each block, and the vectors of the blocks before it in the order of cells, then gaps."""
    pivots = index.pivots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for dim, rows, d in _to_pivots(df, pivots):
                cells = d.shape[1]
                yield pd.DataFrame({"qid": rows["qid"].repeat(cells), "dim": dim, "cell": np.tile(np.arange(cells), len(rows)), "d": d.ravel(), "least": d.min(axis=1).repeat(cells)})

    cells = asked.mapInPandas(run, "qid long, dim int, cell int, d double, least double")
    # What lies in another cell is at least half as far as the pivot is farther than the nearest one.
    gap = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"), (F.col("d") - F.col("least")) / 2, F.lit(0.0))
    before = Window.partitionBy("qid").orderBy("d", "gap", "block").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(index.directory, ["dim", "cell"]).withColumn("gap", gap).select("qid", "block", "n", "d", "gap", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def nearest_in(x: np.ndarray, ids: np.ndarray, qids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int) -> pd.DataFrame:
    """Of one block the k nearest of each question that lie within its limit."""
    out = []
    for at in range(0, len(q), STEP):
        d, rows = _best(distances(x, q[at : at + STEP]), np.broadcast_to(ids, (len(q[at : at + STEP]), len(ids))), k)
        within = d <= limit[at : at + STEP, None]
        out.append(pd.DataFrame({"qid": np.repeat(qids[at : at + STEP], within.sum(axis=1)), "id": rows[within], "distance": d[within]}))
    return pd.concat(out)


def _score(pairs: DataFrame, asked: DataFrame, index: PivotIndex, k: int, parts: int) -> DataFrame:
    """(qid, id, distance) of (qid, block, limit) pairs: the blocks that are asked for meet their questions."""
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    want = pairs.join(asked, "qid").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    met = want.select(F.col("block").alias("met"), F.col("part").alias("met_part")).distinct()
    have = index.blocks.select("block", "dim", "ids", "data").join(met, F.col("block") == F.col("met")).drop("block")

    def run(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if b.empty or q.empty:
            return pd.DataFrame({"qid": [], "id": [], "distance": []})
        row = b.iloc[0]
        x, ids = np.frombuffer(row["data"], "<f8").reshape(-1, row["dim"]), np.asarray(row["ids"])
        ids = ids.astype(str) if ids.dtype == object else ids
        return nearest_in(x, ids, q["qid"].to_numpy(), np.stack(q["embedding"].to_numpy()), q["limit"].to_numpy(), k)

    return have.groupBy("met", "met_part").cogroup(want.groupBy("block", "part")).applyInPandas(run, f"qid long, id {kind}, distance double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("qid").isNotNull() & _usable(F.col("embedding")))


def _rounds(questions: DataFrame, index: PivotIndex, k: int):
    """(the first round's distances, written; the pairs left for the second; their questions, written; the parts questions come in)."""
    asked = scratch.write(_asked(questions))
    parts = max(1, math.ceil(asked.count() / QUESTIONS))
    bounds = _bounds(asked, index)
    first = scratch.write(_score(bounds.where(F.col("before") < k).select("qid", "block", F.lit(math.inf).alias("limit")), asked, index, k, parts))
    floor = _ranked(first, k).where(F.col("rank") == k).select("qid", F.col("distance").alias("kth"))
    # Slack for nine decimals of a tie and for rounding in long sums.
    limit = F.coalesce(F.col("kth") * (1 + 1e-9) + 1e-8, F.lit(math.inf))
    left = bounds.where(F.col("before") >= k).join(floor, "qid", "left").withColumn("limit", limit).where(F.col("gap") <= F.col("limit") + F.col("d") * 1e-9)
    return first, left, asked, parts


def nearest(questions: DataFrame, index: PivotIndex, k: int) -> DataFrame:
    """(qid, rank, id, distance): the k nearest vectors of the index for each (qid, embedding) question."""
    first, left, asked, parts = _rounds(questions, index, k)
    second = _score(left.select("qid", "block", "limit"), asked, index, k, parts)
    return _ranked(first.union(second), k).select("qid", "rank", "id", "distance")


def scored(questions: DataFrame, index: PivotIndex, k: int) -> DataFrame:
    """(qid, n_scored, n_vectors): how many vectors a search compares with each question, of how many of its length."""
    _, left, asked, _ = _rounds(questions, index, k)
    bounds = _bounds(asked, index)
    every = bounds.groupBy("qid").agg(F.sum("n").alias("n_vectors"), F.sum(F.when(F.col("before") < k, F.col("n")).otherwise(0)).alias("near"))
    more = left.groupBy("qid").agg(F.sum("n").alias("more"))
    return every.join(more, "qid", "left").select("qid", (F.col("near") + F.coalesce("more", F.lit(0))).alias("n_scored"), "n_vectors")


def search(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, *, visible: str | None, key: str = "chunk_id") -> DataFrame:
    """(qid, rank, id, distance): the k nearest visible vectors of each (qid, embedding) question.

    Only chunks that have a vector take part; ties go to the smaller id.
    """
    return nearest(questions, build_index(vectors, chunks, visible=visible, key=key), k)


def search_or_nothing(questions: DataFrame, vectors: DataFrame | PivotIndex, chunks: DataFrame, k: int, **kw) -> DataFrame | None:
    """The vector arm when vectors may be missing or of another space: a failure gives None, and is logged.

    An index, which must hold the visible vectors only, is searched as it is. Lengths are compared by an aggregate. The result is written, so a failure of its jobs is met here and not in what follows.
    """
    log = logging.getLogger(__name__)
    try:
        asked = questions.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        built = isinstance(vectors, PivotIndex)
        lengths = vectors.directory.select("dim") if built else vectors.where("embedding IS NOT NULL").select(F.size("embedding").alias("dim"))
        if asked[0] is not None and not lengths.where((F.col("dim") < asked[0]) | (F.col("dim") > asked[1])).isEmpty():
            log.warning("vector search is unavailable: questions have %d to %d components, some vectors others", *asked)
            return None
        return scratch.write(nearest(questions, vectors, k) if built else search(questions, vectors, chunks, k, **kw))
    except Exception:
        log.warning("vector search is unavailable", exc_info=True)
        return None
