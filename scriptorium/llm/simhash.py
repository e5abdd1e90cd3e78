"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Two
fingerprints link at two or fewer differing bits; two bits lie in at most two of the eight bytes,
so a linked pair shares at least six (position, byte) postings. Lists of single postings would
hold a 256th of all fingerprints each, and pairs that share one byte are of no use; so the index lists
each distinct fingerprint under the 28 conjunctions of six postings, and a pair meets in a list
exactly if its tally reaches six. Pairs that meet are tallied (equal bytes counted), retained at six or more,
and verified on all 64 bits.

Inside a list only the two other bytes differ, so a list holds at most 2**16 distinct fingerprints
however many texts there are. Short lists are taken pair by pair. In longer ones every two of the 16 free
bits are masked in turn: fingerprints equal under the mask are neighbours after sorting, and such neighbours
are the pairs that are tallied and verified (two fingerprints of two or fewer differing bits are equal
under some mask, and what is equal under one is linked through neighbours). A list gives links that span its
linked groups, not all pairs; components are found iteratively.

Exact copies are one fingerprint: they are grouped before the index and expanded after it.

``near_duplicates`` is for corpora: two texts link if the sets of their ``shingle``-word shingles
have a Jaccard similarity of ``jaccard`` or more. Two of 64 bits reach hardly any of these, so each distinct text has a
SimHash of its set as wide as the index needs (the bits of every position voted by all distinct shingles, ties giving 0), and the index lists it under the conjunctions of ``CONJUNCTION`` neighbouring byte positions. Sets at the
threshold share every bit with a chance that follows from their angle and sizes; ``conjunctions`` gives the number of lists after which
a pair meets in none with a chance of ``MISS``: nearly a thousand for long texts, more for short ones, whose votes are
coarse. Pairs that meet are tallied over the first ``TALLIED`` bytes, retained at ``least_tally`` equal bytes or more,
and verified on whole sets. How groups come out of the lists is told in ``lists``.

Edge cases: null and empty texts and texts of white space have fingerprint zero and link like any
other; texts of fewer words than a shingle have one shingle, the whole sequence; repeated rows
stay, each with its component; rows with a null doc_id keep a fingerprint and take the component
of the smallest id they reach (null if none); very long texts are hashed whole, their bits counted in slices; of
equal candidates the smallest id (or row) stands for a group; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lists
from .common import broadcast_if_small, components, kept, materialize, table
from .lists import shingle_hashes, text_words

SEED = 42
SHINGLE = 3
MOST_BITS = 2
#: Equal bytes of a pair at least: two bits lie in two bytes at most.
LEAST_TALLY = 8 - MOST_BITS
PAIRWISE = 64
#: Copies from which a fingerprint is looked up apart.
HOT = 50
#: Near-duplicate stages: words of a shingle and similarity.
NEAR_SHINGLE = 5
NEAR_JACCARD = 0.8
#: Byte positions of a conjunction, and the chance that a pair at the threshold meets in none.
CONJUNCTION = 3
MISS = 5e-8
#: By the least number of shingles: how much likelier a bit differs than between large sets at the same angle, at most (summed over all splits of votes).
COARSE = ((125, 1.01), (50, 1.025), (6, 1.064), (0, 1.238))
#: Bytes of a fingerprint that are tallied, and the chance that a pair at the threshold falls short.
TALLIED = 192
SHORT = 1e-9
#: Words of votes held at once, and postings that leave together.
VOTES = 1 << 18
POSTED = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    h = shingle_hashes(text_words(text), shingle, seed)
    if not len(h):
        return 0
    n = len(h)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint16).astype(np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _conjunctions() -> list[tuple[int, int]]:
    """For every choice of two free bytes: their positions."""
    return list(combinations(range(8), 2))


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: their tally of equal bytes reaches the least, and few enough bits differ."""
    x = np.ascontiguousarray(a ^ b)
    tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    out = tally >= LEAST_TALLY
    out[out] = np.bitwise_count(x[out]) <= MOST_BITS
    return out


def span(prints: np.ndarray, free: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (i, j) that span the groups of distinct fingerprints which may differ in the bytes ``free``."""
    n = len(prints)
    links: list[tuple[int, int]] = []
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(first: np.ndarray, second: np.ndarray) -> None:
        good = linked(prints[first], prints[second])
        for i, j in zip(first[good].tolist(), second[good].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))

    if n <= PAIRWISE:
        link(*np.triu_indices(n, 1))
        return links
    for a, b in combinations([8 * p + i for p in free for i in range(8)], 2):
        masked = prints & ~np.uint64((1 << a) | (1 << b))
        order = np.argsort(masked, kind="stable")
        same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
        link(order[same], order[same + 1])
    return links


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between fingerprints, from posting lists of (conjunction, fingerprints)."""
    pairs = _conjunctions()
    for df in batches:
        a, b = [], []
        for c, node in zip(df["c"], df["node"], strict=True):
            node = np.asarray(node, dtype=np.int64)
            for i, j in span(node.view(np.uint64), pairs[c]):
                a.append(node[i])
                b.append(node[j])
        yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document."""
    fp = F.pandas_udf(_fingerprints, "long")
    return docs.select("doc_id", fp("text").alias("fp"))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root): every distinct fingerprint and the smallest fingerprint it reaches through links."""
    # Dealt anew by another key, since the 28 postings of each outgrow the partitions that the small rows were put in.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = materialize(prints.select("fp").distinct()).repartition(parts, F.xxhash64("fp", F.lit(SEED)))
    keys = []
    for i, (a, b) in enumerate(_conjunctions()):
        mask = ((1 << 64) - 1) ^ (255 << (8 * a)) ^ (255 << (8 * b))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    posted = nodes.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.*", "fp")
    posted = posted.groupBy("c", "key").agg(F.collect_list("fp").alias("node")).where(F.size("node") > 1)
    links = posted.select("c", "node").mapInPandas(_links, "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "root")


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): every document's fingerprint and the smallest id it reaches."""
    prints = materialize(fingerprints(docs))
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked = materialize(classes(prints))
    low = lowest.join(linked, "fp").groupBy("root").agg(F.min("least").alias("component"))
    merged = linked.join(low, "root").select("fp", "component")
    root = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.least("component", "least"))
    final = materialize(lowest.join(merged, "fp", "left").select("fp", "n", root.alias("component_id")))
    # Fingerprints of many copies are looked up apart, so that no task gets all rows of one.
    hot = broadcast_if_small(final.where(F.col("n") >= HOT))
    out = ["doc_id", "fp", "component_id"]
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(final.where(F.col("n") < HOT), "fp")
    return prints.join(hot, "fp").select(*out).union(rest.select(*out))


def differing(n: int, jaccard: float = NEAR_JACCARD) -> float:
    """The chance that a bit differs between sets at the threshold, the larger of n shingles."""
    return next(f for least, f in COARSE if n >= least) * math.acos(2 * jaccard / (1 + jaccard)) / math.pi


@cache
def _conjunctions_from(least: int, jaccard: float) -> int:
    met = (1 - differing(least, jaccard)) ** (8 * CONJUNCTION)
    return 8 * math.ceil(math.log(MISS) / math.log1p(-met) / 8)


def conjunctions(n: int, jaccard: float = NEAR_JACCARD) -> int:
    """Conjunctions that a set of n shingles is listed under, a multiple of 8; of similar sets the larger never has more."""
    if n < (n + 1) * jaccard - 1e-9:  # Only equal sets are similar enough.
        return 8
    return _conjunctions_from(next(least for least, _ in COARSE if n >= least), jaccard)


@cache
def least_tally(jaccard: float = NEAR_JACCARD) -> int:
    """Equal bytes among the tallied ones that a pair at the threshold has but for a chance of ``SHORT``."""
    same, below, k = (1 - differing(0, jaccard)) ** 8, 0.0, 0
    while k < TALLIED and (below := below + math.comb(TALLIED, k) * same**k * (1 - same) ** (TALLIED - k)) <= SHORT:
        k += 1
    return k


def _majority(votes: np.ndarray) -> np.ndarray:
    """For every bit of the columns: whether over half of the rows have it. Counts are kept as bit planes."""
    n, planes, level = len(votes), [], votes
    while True:
        carries = []
        while len(level) > 1:
            if m := len(level) // 3:
                a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
                odd = a ^ b
                carry = a & b
                rest = level[3 * m :]
                level = np.empty((m + len(rest), level.shape[1]), dtype=np.uint64)
                np.bitwise_xor(odd, c, out=level[:m])
                level[m:] = rest
                odd &= c
                carry |= odd
                carries.append(carry)
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        planes.append(level[0])
        if not carries:
            break
        level = np.concatenate(carries) if len(carries) > 1 else carries[0]
    more, same = np.zeros_like(votes[0]), ~np.zeros_like(votes[0])
    for i, plane in reversed(list(enumerate(planes))):
        if n // 2 >> i & 1:
            same = same & plane
        else:
            more |= same & plane
            same = same & ~plane
    return more


@cache
def _multipliers(words: int, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, (words, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes (a multiple of 8) of the SimHash of a set of distinct hashes in ascending order."""
    if not len(hashes):
        return np.zeros(size, dtype=np.uint8)
    out = np.empty(size // 8, dtype="<u8")
    mult = _multipliers(len(out))
    step = max(1, VOTES // len(hashes))
    for i in range(0, len(out), step):
        x = hashes[:, None] + mult[i : i + step, 0]
        x *= mult[i : i + step, 1]
        x ^= x >> np.uint64(32)
        out[i : i + step] = _majority(x)
    return out.view(np.uint8)


def posting_keys(hashes: np.ndarray, jaccard: float = NEAR_JACCARD) -> np.ndarray:
    """The lists of a set: a row for each conjunction, which holds its bytes as a number."""
    n = conjunctions(len(hashes), jaccard)
    key = np.zeros(n, dtype=np.int32)
    for b in wide_fingerprint(hashes, n * CONJUNCTION).reshape(n, CONJUNCTION).astype(np.int32).T:
        key = key << 8 | b
    return key[:, None]


def _printed(shingle: int):
    """Of each text: the digest of its words, the size of its set and the bytes that are tallied."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept(("simhash",), dict)  # Nothing, and what earlier stages kept goes.
        for texts in batches:
            out = []
            for t in texts:
                w = text_words(t)
                h = np.unique(lists.shingle_codes(w, shingle))
                out.append((hashlib.md5(b" ".join(w)).digest(), len(h), wide_fingerprint(h, TALLIED).tobytes() if len(h) else None))
            yield pd.DataFrame(out, columns=["digest", "size", "sketch"])

    return F.pandas_udf(run, "digest binary, size int, sketch binary")


def _posted(shingle: int, jaccard: float, bits: int):
    """The packed postings of all texts, ``POSTED`` or a few more at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = [], 0

        def leaving() -> pd.DataFrame:
            rows, sizes, keys = zip(*held, strict=True)
            counts = [len(k) for k in keys]
            each = [np.arange(n) for n in counts]
            return lists.packed(np.repeat(np.array(rows, dtype=np.int64), counts), np.concatenate(each), np.concatenate(keys)[:, 0], bits, np.repeat(np.array(sizes, dtype=np.uint8), counts))

        for df in batches:
            for row, t in zip(df["row"], df["text"], strict=True):
                h = np.unique(lists.shingle_codes(text_words(t), shingle))
                if len(h):
                    held.append((row, lists.size_class(len(h), jaccard), posting_keys(h, jaccard)))
                    number += len(held[-1][2])
                if number >= POSTED:
                    yield leaving()
                    held, number = [], 0
        if held:
            yield leaving()

    return run


def tallied(a: np.ndarray, b: np.ndarray, jaccard: float = NEAR_JACCARD) -> np.ndarray:
    """Whether fingerprints (rows of bytes) have enough equal bytes."""
    return (a == b).sum(axis=-1) >= least_tally(jaccard)


def _tallied(jaccard: float):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pair in batches:
            a, b = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, TALLIED) for s in pair)
            yield pd.Series(tallied(a, b, jaccard), dtype=bool)

    return F.pandas_udf(run, "boolean")


def row_groups(docs: DataFrame, *, shingle: int = NEAR_SHINGLE, jaccard: float = NEAR_JACCARD, block: int = lists.BLOCK) -> DataFrame:
    """(row, digest, root): of docs' rows (row, text), ``row`` a unique long, the digest of the words and the group."""
    printed = _printed(shingle)
    prints = materialize(docs.select("row", printed("text").alias("s")).select("row", "s.*"))
    # Texts of the same words are one node, the smallest of their rows.
    least = materialize(prints.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("sketch").alias("sketch")))
    copied = prints.select("row", "digest").join(broadcast_if_small(least.where("n > 1").select("digest", "node")), "digest").where("row <> node")
    single = docs.select("row", "text").join(broadcast_if_small(materialize(copied.select("row"))), "row", "left_anti")
    # Every conjunction is a slice, and dealt further by keys where it has many.
    bits = lists.group_bits(least.count(), 1)
    posted = single.select("row", "text").mapInPandas(_posted(shingle, jaccard, bits), "group int, first long, n int, steps binary, keys binary, sizes binary")
    listed = lists.listed_mostly_alone(posted)
    pairs = lists.stars(listed)
    for part in (least.select("node", "size"), least.select("node", "sketch")):
        name = part.columns[1]
        a, b = (part.select(F.col("node").alias(c), F.col(name).alias(n)) for c, n in (("a", "x"), ("b", "y")))
        fit = F.least("x", "y") >= F.greatest("x", "y") * jaccard - 1e-9 if name == "size" else _tallied(jaccard)("x", "y")
        pairs = materialize(broadcast_if_small(pairs).join(a, "a").join(b, "b").where(fit).select("a", "b"))
    sets = lists.sets_of(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), shingle)
    links = lists.verified(pairs, sets, jaccard)
    roots = materialize(components(links))
    sketches = least.select("node", "sketch")
    left = lists.hopeful(lists.unsettled(listed, roots), sketches, block, lambda a, b: tallied(a, b, jaccard), "u1")
    sets = lists.sets_of(docs, left, shingle)
    more = lists.between(left, sets.join(sketches, "node"), jaccard, block, lambda a, b: tallied(a, b, jaccard), "u1")
    roots = materialize(components(links.union(more)))
    final = materialize(least.select("digest", "node", "n").join(roots, "node", "left").select("digest", "n", F.coalesce("root", "node").alias("root")))
    # Texts of many copies are looked up apart, so that no task gets all rows of one.
    hot = broadcast_if_small(final.where(F.col("n") >= HOT))
    out = ["row", "digest", "root"]
    rest = prints.join(hot.select("digest"), "digest", "left_anti").join(final.where(F.col("n") < HOT), "digest")
    return materialize(prints.join(hot, "digest").select(*out).union(rest.select(*out)))


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, fp, component_id): a digest of every document's words and the smallest id its group has.

    The digest is zero for texts without words. Parameters are those of ``row_groups``.
    """
    rows = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    groups = row_groups(rows, **kw).join(rows.select("row", "doc_id"), "row")
    least = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    fp = F.when(F.col("digest") == F.unhex(F.lit(hashlib.md5(b"").hexdigest())), F.lit(0)).otherwise(F.xxhash64("digest"))
    return groups.join(least, "root").select("doc_id", fp.cast("long").alias("fp"), "component_id")


def query(spark, sf_dir):
    out = fingerprint_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
