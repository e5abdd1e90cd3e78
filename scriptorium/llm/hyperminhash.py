"""Near-duplicates by HyperMinHash sketches.

Sketch. The distinct shingles of a text are hashed once; the top bits of a hash choose one of ``BUCKETS`` buckets, and a
bucket keeps its smallest hash as a register of 16 bits: the number of leading zeros and the ``MANTISSA`` bits after the first one.
An empty bucket has a register of its own kind; for banding it takes over that of the first filled bucket in a fixed order of its own, so
sets of a few shingles are banded as well as large ones.

Bands. ``BANDS`` keys of four registers each (64 bits) list every distinct set; a pair of Jaccard similarity 0.8 shares none of 32 keys with a
chance of (1 - 0.8**4)**32 < 5e-8. Pairs that share one are judged by their registers: of the buckets that either set fills,
the share that agree, corrected for registers that agree by accident (the chance follows from both sets' sizes). Only a pair whose estimate falls short of the threshold by
more than ``DEVIATIONS`` standard deviations is dropped; all others are confirmed on whole sets. How groups come out of lists is told in ``lists``.

Equal sets are one node, so exact copies are never paired; rows are joined to their group by the digest of their set, digests of many copies apart.

Edge cases: texts without words have an empty set, no registers and no links, each being its own component; texts of fewer
words than a shingle have one shingle, the whole sequence; rows with a null id have a set and links, and take the smallest id of
their group (null if it has none, and then they are kept); repeated rows stay, each with its component; very long texts are hashed whole; of ties
the smallest id stands for a group; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lists
from .common import broadcast_if_small, components, materialize, table
from .lists import shingle_hashes, text_words

SHINGLE = 4
JACCARD = 0.8
BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, BAND_ROWS = 32, 4
#: Bits of a hash below the bucket's that are looked at: what a double holds exactly.
REST = 53
EMPTY = 0xFFFF
DEVIATIONS = 6
#: Copies from which a set is looked up apart.
HOT = 50
#: The order in which each bucket asks the others for a register.
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(11)).random((BUCKETS, BUCKETS)), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of distinct hashes in ascending order."""
    out = np.full(BUCKETS, EMPTY, dtype=np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(64 - REST)
        zeros = REST - np.frexp(rest.astype(np.float64))[1]
        after = (rest << (zeros + 64 - REST).astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = (zeros << MANTISSA).astype(np.uint16) | np.where(rest > 0, after, 0).astype(np.uint16)
    return out


def band_keys(r: np.ndarray) -> np.ndarray:
    """The keys of a sketch, its empty registers filled from others."""
    filled = r != EMPTY
    if not filled.all():
        lacking = np.flatnonzero(~filled)
        asked = _ORDER[lacking]
        r = r.copy()
        r[lacking] = r[asked[np.arange(len(lacking)), filled[asked].argmax(axis=1)]]
    return r[: BANDS * BAND_ROWS].astype("<u2").view("<i8").copy()


def accident(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The chance that the registers of two different minima agree, for sets of x and y elements."""
    edges = np.concatenate((2.0 ** -np.arange(0, 24), [0.0]))
    chance = lambda n: np.diff(np.exp(-np.multiply.outer(edges, np.atleast_1d(n) / BUCKETS)), axis=0)
    return (chance(x) * chance(y)).sum(axis=0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities of sketches (rows of registers) of sets of x and y elements, and the buckets they rest on."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(filled.sum(axis=-1), 1)
    agree = ((a == b) & filled).sum(axis=-1) / n
    chance = accident(x, y)
    return np.clip((agree - chance) / (1 - chance), 0, 1), n


def _sizes(a: np.ndarray) -> np.ndarray:
    """Sizes of sets from their filled buckets (exactly enough for the chance of accidents)."""
    empty = np.maximum((a == EMPTY).sum(axis=-1), 0.5)
    return -BUCKETS * np.log(empty / BUCKETS)


def likely(a: np.ndarray, b: np.ndarray, jaccard: float = JACCARD) -> np.ndarray:
    """Whether the estimate leaves it possible that sets are as similar as ``jaccard``."""
    found, n = estimate(a, b, _sizes(a), _sizes(b))
    return found >= jaccard - DEVIATIONS * np.sqrt(jaccard * (1 - jaccard) / n)


def _likely(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        x, y = (np.stack([np.frombuffer(v, dtype="<u2") for v in s]) if len(s) else np.empty((0, BUCKETS), dtype="<u2") for s in (a, b))
        yield pd.Series(likely(x, y), dtype=bool)


def _sketched(shingle: int):
    """Digest, size, registers and keys of each text's set."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                h = np.unique(shingle_hashes(text_words(t), shingle))
                r = registers(h)
                out.append((hashlib.md5(h.tobytes()).digest(), len(h), r.astype("<u2").tobytes(), band_keys(r)) if len(h) else (None, 0, None, None))
            yield pd.DataFrame(out, columns=["digest", "n", "sketch", "keys"])

    return F.pandas_udf(run, "digest binary, n long, sketch binary, keys array<long>")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, jaccard: float = JACCARD, block: int = lists.BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")))
    prints = materialize(rows.select("row", "doc_id", _sketched(shingle)("text").alias("s")).select("row", "doc_id", "s.*"))
    nodes = prints.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys"))
    nodes = materialize(nodes)
    listed = lists.listed(nodes.select("node", F.posexplode("keys").alias("band", "key")))
    sketches = nodes.select("node", "sketch")
    pairs = lists.stars(listed)
    x, y = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    pairs = materialize(broadcast_if_small(pairs).join(x, "a").join(y, "b").where(F.pandas_udf(_likely, "boolean")("x", "y")).select("a", "b"))
    sets = lists.sets_of(rows, listed, shingle)
    links = lists.verified(pairs, sets, jaccard)
    roots = materialize(components(links))
    more = lists.between(lists.unsettled(listed, roots), sets.join(sketches, "node"), jaccard, block, lambda a, b: likely(a, b, jaccard), "<u2")
    roots = materialize(components(links.union(more)))
    rooted = materialize(nodes.select("digest", "node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = materialize(rooted.join(named, "root").select("digest", "copies", "component_id"))
    # Sets of many copies are looked up apart, so that no task gets all rows of one.
    hot = broadcast_if_small(final.where(F.col("copies") >= HOT).drop("copies"))
    cold = final.where(F.col("copies") < HOT).drop("copies")
    own = ["doc_id", "n", "component_id"]
    found = [prints.join(hot, "digest"), prints.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"), prints.where("n = 0").withColumn("component_id", F.col("doc_id"))]
    out = found[0].select(*own).union(found[1].select(*own)).union(found[2].select(*own))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS shingle FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
