"""Approximate nearest neighbours by a forest of random-projection trees.

Index. Each tree has orthonormal Gaussian directions, one for each level, and splits every node
at the median projection of a bounded sample of vectors (``SAMPLE`` rows, the smallest by a hash of
the id); below the sample's resolution a node splits at its mean. Every vector is then assigned
to one leaf per tree. Of exact copies only the k + 1 with the smallest ids are indexed: the others
can be in no result, since ties go to smaller ids.

Search. The trees of a query share one priority queue, ordered by the sum of squared margins of
the splits taken against the query, which bounds the squared distance to a leaf from below.
It is popped until ``PROBE_SHARE`` of all leaves are found, at every size of the table.

Rerank. The index is dealt by a hash of the id into blocks of about ``BLOCK`` vectors, each shipped once with its
leaves; a block keeps the lists of its leaves in memory. A query's candidates in a block are the
members of the leaves it found, each once; they are scored exactly, in double precision, and the best of
all blocks are merged. Queries come to a block in groups of ``QUERIES``, so a task holds a bounded part of both.

Vectors of nearly independent directions in 64 dimensions have no near neighbours to speak of; a
recall of 0.9 then takes over half of the vectors as candidates, the more the smaller the table. Lower the
share for clustered data.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do vectors of another length than the most common one; rows with null ids take no part;
repeated ids are vectors of their own, except that a query skips all vectors of its own id, and a vector that
two rows repeat under one id is one result; ties go to the smaller id; very long vectors are read whole; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

TREES = 16
LEAF = 50
#: Levels of a tree at most; leaves grow beyond.
MOST_DEPTH = 10
SAMPLE = 16_384
PROBE_SHARE = 0.1
BLOCK = 32_768
QUERIES = 4_096
K = 20


class Forest:
    """Directions and thresholds of all trees, small enough to send to every task."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.depth = min(dim, MOST_DEPTH, max(1, round(math.log2(max(2, total / leaf)))))
        self.fitted = min(self.depth, max(1, int(math.log2(max(2, len(sample) / 8)))))
        self.directions, self.medians, self.means = [], [], []
        for _ in range(trees):
            r = np.linalg.qr(rng.normal(size=(dim, self.depth)))[0]
            p, node, cuts = sample @ r, np.zeros(len(sample), dtype=np.int64), []
            for level in range(self.fitted):
                order = np.lexsort((p[:, level], node))
                n = np.bincount(node, minlength=1 << level)
                first = np.cumsum(n) - n
                at = np.minimum(first + n // 2, len(sample) - 1)
                cut = np.where(n > 0, p[order[at], level], 0.0)
                cuts.append(cut)
                node = node * 2 + (p[:, level] > cut[node])
            n = np.maximum(np.bincount(node, minlength=1 << self.fitted), 1)
            means = [np.bincount(node, weights=p[:, level], minlength=1 << self.fitted) / n for level in range(self.fitted, self.depth)]
            self.directions.append(r)
            self.medians.append(cuts)
            self.means.append(means)
        #: The same as plain lists, which single look-ups read faster.
        self.lists = [[a.tolist() for a in (*c, *m)] for c, m in zip(self.medians, self.means, strict=True)]

    def threshold(self, tree: int, level: int, node):
        if level < self.fitted:
            return self.medians[tree][level][node]
        return self.means[tree][level - self.fitted][node >> (level - self.fitted)]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        out = np.zeros((len(x), len(self.directions)), dtype=np.int64)
        for t, r in enumerate(self.directions):
            p, node = x @ r, out[:, t]
            for level in range(self.depth):
                node[:] = node * 2 + (p[:, level] > self.threshold(t, level, node))
        return out

    def search(self, q: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The first ``probes`` (tree, leaf) pairs off the shared queue."""
        p = [(q @ r).tolist() for r in self.directions]
        queue = [(0.0, t, 0, 0) for t in range(len(p))]
        found: list[tuple[int, int]] = []
        push, pop, depth, fitted = heapq.heappush, heapq.heappop, self.depth, self.fitted
        while queue and len(found) < probes:
            cost, t, level, node = pop(queue)
            mine, cuts = p[t], self.lists[t]
            while level < depth:
                m = mine[level] - cuts[level][node if level < fitted else node >> (level - fitted)]
                right = m > 0
                node *= 2
                push(queue, (cost + m * m, t, level + 1, node + (not right)))
                node += right
                level += 1
            found.append((t, node))
        return found


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    e = F.col("embedding")
    fit = F.size(e) > 0
    fit &= F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    kept = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fit)
    length = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("embedding") == (length["n"] if length else 0))


def _assign(forest: Forest):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                yield df.assign(leaves=list(forest.leaves(np.stack(df["embedding"].to_numpy())).astype(np.int32)))

    return run


def _probe(forest: Forest, probes: int):
    """The leaves of each query; a leaf's number counts through all trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.assign(found=[np.array([(t << forest.depth) + leaf for t, leaf in forest.search(np.asarray(q), probes)], dtype=np.int32) for q in df["query"]])

    return run


def _rerank(k: int, depth: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(vectors) and len(queries):
            ids, x = vectors["vec_id"].to_numpy(), np.stack(vectors["embedding"].to_numpy())
            leaves = np.stack(vectors["leaves"].to_numpy()).astype(np.int64)
            trees = leaves.shape[1]
            flat = (leaves + (np.arange(trees) << depth)).ravel()
            members = np.argsort(flat, kind="stable") // trees
            size = np.bincount(flat, minlength=trees << depth)
            first = np.cumsum(size) - size
            for i, found, q in zip(queries["query_id"], queries["found"], queries["query"], strict=True):
                n = size[found]
                at = np.repeat(first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hit = np.zeros(len(ids), dtype=bool)
                hit[members[at]] = True
                at = np.flatnonzero(hit & (ids != i))
                if not len(at):
                    continue
                q = np.asarray(q)
                if len(at) > k:
                    rough = x[at] @ q
                    least = np.partition(rough, len(at) - k)[len(at) - k]
                    at = at[rough >= least - 1e-9 * max(1.0, abs(least))]
                scores = (x[at] * q).sum(axis=1)
                best = np.lexsort((ids[at], -scores))[:k]
                out[0].append(np.full(len(best), i))
                out[1].append(ids[at][best])
                out[2].append(scores[best])
        cat = lambda a, kind: np.concatenate(a).astype(kind) if a else np.array([], dtype=kind)
        return pd.DataFrame({"query_id": cat(out[0], np.int64), "vec_id": cat(out[1], np.int64), "score": cat(out[2], np.float64)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, probe_share: float = PROBE_SHARE, leaf: int = LEAF) -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank, vec_id, score.

    vectors: (vec_id long, embedding array of doubles), as ``valid`` gives them; queries likewise.
    """
    spark = vectors.sparkSession
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = materialize(vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "embedding"))
    total = kept.count()
    if total == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in kept.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).collect()])
    forest = Forest(sample, total, trees, leaf)
    probes = math.ceil(probe_share * trees * 2**forest.depth)

    dim = "array<double>"
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).repartition(spark.sparkContext.defaultParallelism * 2, "query_id")
    asked = materialize(asked.mapInPandas(_probe(forest, probes), f"query_id long, query {dim}, found array<int>"))
    blocks, lists = max(1, math.ceil(total / BLOCK)), max(1, math.ceil(asked.count() / QUERIES))
    # Small tables are cut finer, so that no task stands idle.
    blocks = max(blocks, min(spark.sparkContext.defaultParallelism, math.ceil(total / 2_000)))
    part = lambda key, n: F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = kept.mapInPandas(_assign(forest), f"vec_id long, embedding {dim}, leaves array<int>")
    v = index.select(part("vec_id", blocks).alias("block"), each(lists).alias("list"), "vec_id", "embedding", "leaves")
    q = asked.select(each(blocks).alias("block"), part("query_id", lists).alias("list"), "query_id", "query", "found")
    found = v.groupBy("block", "list").cogroup(q.groupBy("block", "list")).applyInPandas(_rerank(k, forest.depth), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    vectors = materialize(valid(table(spark, sf_dir, "embeddings")))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
