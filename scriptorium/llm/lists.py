"""Groups of similar sets out of posting lists (band, key, node), without gathering any list in one place.

1. Every list is known by its smallest member, an aggregate with partial minima; no list is collected. Each member is a pair with that
   smallest one, and distinct pairs are verified on whole sets: that joins dense groups with a row for each member.
2. Of lists that then still hold several groups (seen from their least and greatest root; lists of the same members count once, told
   by their number and two hashes of them) the members outside the largest group are probes. Probes are compared with
   all members where the sets are, by counting in an index of the members' elements; only links that join two groups leave. (Two
   members of the largest group are linked already, so every pair that matters holds a probe.) Lists are cut into blocks of
   bounded members and elements, each met by each block of its probes, so a task's share is bounded whatever the list.

Lists of packed postings carry classes of sizes, and are cut where no similar sets can meet, before any pair is made.
A ``Likeness`` may drop pairs by their sketches before sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

SEED = 42
KEY = ("band", "key")
BLOCK_KEY = ["list", "block", "probes"]
#: Members and elements of a block at most.
BLOCK = 2_048
BLOCK_ELEMENTS = 2_000_000
#: Candidates of a probe up to which sets are compared one by one.
FEW = 8
#: Postings of a group of lists, and of a piece of it, at most (if keys are even).
GROUP = 1 << 18
#: Classes of sizes between a set and the smallest that is similar enough.
CLASSES = 4
MEMBER, BOTH, PROBE = 0, 1, 2
#: Whether pairs may be similar, from their sketches (rows of the one against a row, or rows, of the other).
Likeness = Callable[[np.ndarray, np.ndarray], np.ndarray]


def text_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeated ones too; of the whole sequence if it is shorter."""
    hash64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([hash64(joined, seed)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    return np.fromiter((hash64(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def shingle_codes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """A 64-bit code of every shingle, repeated ones too: the XXH64 of its words, folded in their order and mixed. Each word is hashed once, not once a shingle."""
    if len(words) <= shingle:
        return shingle_hashes(words, shingle, seed)
    hash64 = xxhash.xxh64_intdigest
    each = np.fromiter((hash64(w, seed) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - shingle + 1
    out = each[:n].copy()
    for j in range(1, shingle):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += each[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def size_class(n: int, jaccard: float) -> int:
    """The class of a set's size, at most 255. Classes of similar sets differ by at most ``CLASSES`` + 1."""
    return min(255, int(CLASSES * math.log(max(n, 1)) / -math.log(jaccard))) if jaccard < 1 else 0


def _sets(shingle: int):
    """The distinct shingle hashes of each text, sorted, as bytes, and their number."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [np.unique(shingle_hashes(text_words(t), shingle)) for t in texts]
            yield pd.DataFrame({"shingles": [x.astype("<u8").tobytes() for x in found], "n": [len(x) for x in found]})

    return F.pandas_udf(run, "shingles binary, n int")


def sets_of(docs: DataFrame, listed_: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles, n) of the listed nodes, which are rows of docs (row, text)."""
    named = broadcast_if_small(materialize(listed_.select(F.col("node").alias("row")).distinct()))
    sets = docs.select("row", "text").join(named, "row", "left_semi").select(F.col("row").alias("node"), _sets(shingle)("text").alias("s"))
    return materialize(sets.select("node", "s.shingles", "s.n"))


def listed(postings: DataFrame) -> DataFrame:
    """The postings of lists of two members or more, with the smallest one: (band, key, node, low)."""
    ends = postings.groupBy(*KEY).agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    return materialize(postings.join(ends.select(*KEY, "low"), [*KEY]).select(*KEY, "node", "low"))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of lists of two or more with their first one, from rows by group of lists (a key's upper half), the lists of a group in any order.

    Of the group a batch ends in, the first members are carried on, so it may be of any length; it is the lists of a group that are bounded.
    With classes of sizes (``size``), the lists of a group that a batch holds whole are cut where sizes leave a gap that no similar sets span; then
    ``band`` tells the parts of a list apart.
    """
    held = None
    for df in batches:
        if not len(df):
            continue
        k, n = df["key"].to_numpy(), df["node"].to_numpy()
        told = np.zeros(len(k), dtype=bool)
        sized = "size" in df
        if sized and df["whole"].iloc[0]:
            held, size = None, df["size"].to_numpy().astype(np.int64)
            order = np.argsort(k << 8 | size, kind="stable")
            k, n, size = k[order], n[order], size[order]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (np.diff(size) > CLASSES + 1)))
        else:
            if held is not None and held[0][-1] >> 32 == k[0] >> 32:
                k, n, told = (np.concatenate(x) for x in zip(held, (k, n, told), strict=True))
            order = np.argsort(k, kind="stable")
            k, n, told = k[order], n[order], told[order]
            size, new = np.zeros(len(k), dtype=np.int64), np.concatenate(([True], k[1:] != k[:-1]))
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(k)))
        low, member = np.repeat(n[starts], counts), np.repeat(counts > 1, counts) & ~told
        found = {"key": k[member], "node": n[member], "low": low[member]}
        if sized:
            found = {"band": np.repeat(size[starts], counts)[member].astype(np.int32)} | found
        yield pd.DataFrame(found)
        going = starts[k[starts] >> 32 == k[-1] >> 32]
        held = k[going], n[going], told[going] | (counts[len(counts) - len(going) :] > 1)


def group_bits(postings: int, slices: int) -> int:
    """Bits of a key by which the lists of a slice are dealt further, so that a group holds about ``GROUP`` of all postings at most."""
    return max(0, math.ceil(math.log2(max(1, postings) / slices / GROUP)))


def packed(node: np.ndarray, slice_: np.ndarray, key: np.ndarray, bits: int, size: np.ndarray | None = None) -> pd.DataFrame:
    """Postings as a row for each group: the first node, the steps from each node to the next and the keys, in the fewest bytes that hold them, and the classes of sizes, if given.

    Rows of one batch have much the same nodes and sizes, which is what shuffled blocks are compressed by.
    """
    key = key.astype("<u4")
    spread = (key.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)
    group = slice_.astype(np.int64) << bits | spread.astype(np.int64)
    order = np.argsort(group.astype(np.uint16) if group.max(initial=0) < 1 << 16 else group, kind="stable")
    group, node, key = group[order], node[order], key[order]
    size = None if size is None else size[order].astype(np.uint8)
    narrow = not len(key) or key.max() < 1 << 24
    bytes_ = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 4)[:, : 3 if narrow else 4])
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    steps = np.diff(node, prepend=node[:1])
    steps[starts] = 0
    kind = next(t for t in ("<u1", "<u4", "<i8") if not len(steps) or t == "<i8" or 0 <= steps.min() and steps.max() < 256 ** np.dtype(t).itemsize)
    cut = lambda x: [x[i:j].tobytes() for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=False)]
    number = np.diff(np.append(starts, len(node))).astype(np.int32)
    out = pd.DataFrame({"group": group[starts].astype(np.int32), "first": node[starts], "n": number, "steps": cut(steps.astype(kind)), "keys": cut(bytes_)})
    return out if size is None else out.assign(sizes=cut(size))


def _keys(raw: bytes, n: int) -> np.ndarray:
    """Keys of three or four bytes."""
    if len(raw) == 4 * n:
        return np.frombuffer(raw, dtype="<u4").astype(np.int64)
    wide = np.zeros((n, 4), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(raw, dtype=np.uint8).reshape(n, 3)
    return wide.view("<u4").ravel().astype(np.int64)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, node) of packed postings that lie by group, in pieces of about ``GROUP`` postings, twice as many at most; with sizes, these and whether the piece is of whole groups."""
    held, number, at, whole = [], 0, None, True

    def piece(ends: bool) -> pd.DataFrame:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        out = pd.DataFrame(dict(zip(("key", "node", "size"), columns, strict=False)))
        return out.assign(whole=whole and ends) if "size" in out else out

    for df in batches:
        sizes = df["sizes"] if "sizes" in df else [None] * len(df)
        for group, first, n, steps, keys, size in zip(df["group"], df["first"], df["n"], df["steps"], df["keys"], sizes, strict=True):
            if held and (number >= GROUP // 2 if group != at else number >= 2 * GROUP):
                yield piece(group != at)
                whole = group != at
                held, number = [], 0
            node = first + np.cumsum(np.frombuffer(steps, dtype={1: "<u1", 4: "<u4", 8: "<i8"}[len(steps) // n]), dtype=np.int64)
            held.append((_keys(keys, n) | group << 32, node) if size is None else (_keys(keys, n) | group << 32, node, np.frombuffer(size, dtype=np.uint8)))
            number, at = number + n, group
    if held:
        yield piece(True)


def listed_mostly_alone(postings: DataFrame) -> DataFrame:
    """As ``listed``, of ``packed`` postings with sizes most of which are alone in their list: they are shuffled once, as they are, and no list is held."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, "group").sortWithinPartitions("group", "first")
    return materialize(dealt.mapInPandas(lambda batches: _listed(_unpacked(batches)), "band int, key long, node long, low long"))


def stars(listed_: DataFrame) -> DataFrame:
    """(a, b): every member of a list with the one it is known by."""
    return materialize(listed_.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())


def alike(both, x, y, jaccard: float):
    """Whether sets of x and y elements that share ``both`` are similar enough."""
    return both >= jaccard * (x + y - both) - 1e-9


def _similar(jaccard: float):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            pairs = [(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in zip(a, b, strict=True)]
            yield pd.Series([bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), jaccard)) for x, y in pairs], dtype=bool)

    return F.pandas_udf(run, "boolean")


def verified(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    small = sets.select("node", "shingles", "n")
    x, y = (small.select(F.col("node").alias(c), F.col("shingles").alias(s), F.col("n").alias(n)) for c, s, n in (("a", "x", "nx"), ("b", "y", "ny")))
    sized = broadcast_if_small(pairs).join(x, "a").join(y, "b").where(F.least("nx", "ny") >= F.greatest("nx", "ny") * jaccard - 1e-9)
    return materialize(sized.where(_similar(jaccard)("x", "y")).select("a", "b"))


def unsettled(listed_: DataFrame, roots: DataFrame) -> DataFrame:
    """(list, node, root): the members of lists that hold several groups."""
    named = materialize(listed_.join(broadcast_if_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    # The member a list is known by has met all others, so lists of two are settled.
    told = [F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    mixed = named.groupBy(*KEY).agg(*told, F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last AND n > 2")
    chosen = mixed.groupBy("n", "low", "x", "y").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    chosen = materialize(chosen.withColumn("list", F.monotonically_increasing_id()))
    return named.join(broadcast_if_small(chosen), [*KEY]).select("list", "node", "root")


def joining(kinds: np.ndarray, nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], jaccard: float, sketches: np.ndarray | None = None, likely: Likeness | None = None) -> list[tuple[int, int]]:
    """Links (node, node) of similar sets that join the groups (roots) of one block of a list: of probes and members."""
    parent = {int(r): int(r) for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    members, probes = np.flatnonzero(kinds != PROBE), np.flatnonzero(kinds != MEMBER)
    if not len(members):
        return []
    sizes = np.array([len(sets[m]) for m in members])
    index = None
    links = []
    for p in probes.tolist():
        x = sets[p]
        fit = (np.minimum(sizes, len(x)) >= np.maximum(sizes, len(x)) * jaccard - 1e-9) & (roots[members] != roots[p])
        if likely is not None and fit.any():
            fit[fit] = likely(sketches[members[fit]], sketches[p])
        some = np.flatnonzero(fit)
        if len(some) <= FEW:
            for k in some.tolist():
                m = members[k]
                a, b = find(int(roots[p])), find(int(roots[m]))
                if a != b and alike(len(np.intersect1d(x, sets[m], assume_unique=True)), len(x), sizes[k], jaccard):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(nodes[p]), int(nodes[m])))
            continue
        if index is None:
            flat, owner = np.concatenate([sets[m] for m in members]), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(flat, kind="stable")
            index = flat[order], owner[order]
        first, end = np.searchsorted(index[0], x, "left"), np.searchsorted(index[0], x, "right")
        n = end - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(index[1][at], minlength=len(members))
        for m in members[fit & alike(both, len(x), sizes, jaccard)].tolist():
            a, b = find(int(roots[p])), find(int(roots[m]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(nodes[p]), int(nodes[m])))
    return links


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each block of rows that lie side by side, and whether it is the last of its batch; the last block of a batch may go on in the next."""
    rest = None
    for last, df in _with_last(batches):
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        k = df[BLOCK_KEY].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        stop = len(df) if last else (int(cuts[-1]) if len(cuts) else 0)
        rest = df.iloc[stop:]
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(df)], strict=True):
            if j <= stop:
                yield j == stop, df.iloc[i:j]


def _arrays(column: pd.Series, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column]


def _joined(jaccard: float, likely: Likeness | None, sketch: str | None):
    """Links of all blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = []
        for done, df in _blocks(batches):
            sketches = None if sketch is None else np.stack(_arrays(df["sketch"], sketch))
            links += joining(*(df[c].to_numpy() for c in ("kind", "node", "root")), _arrays(df["shingles"], "<u8"), jaccard, sketches, likely)
            if done:
                yield pd.DataFrame(np.array(links, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])
                links = []

    return run


def _hoping(likely: Likeness, sketch: str):
    """The (list, node) of all blocks that have a likely partner of another group there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for done, df in _blocks(batches):
            kinds, roots, sketches = df["kind"].to_numpy(), df["root"].to_numpy(), np.stack(_arrays(df["sketch"], sketch))
            members, hope = np.flatnonzero(kinds != PROBE), np.zeros(len(df), dtype=bool)
            for p in np.flatnonzero(kinds != MEMBER).tolist():
                others = members[roots[members] != roots[p]]
                others = others[likely(sketches[others], sketches[p])]
                hope[others] = True
                hope[p] |= len(others) > 0
            found.append(df.loc[hope, ["list", "node"]])
            if done:
                yield pd.concat(found, ignore_index=True)
                found = []

    return run


def _with_last(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    held = None
    for df in batches:
        if held is not None:
            yield False, held
        held = df
    if held is not None:
        yield True, held


def _dealt(members: DataFrame, block: int, carried: DataFrame) -> DataFrame:
    """The blocks of lists of (list, node, root, n), n being the elements of a node, with the columns ``carried`` has of each node."""
    each = members.groupBy("list", "root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    known = each.groupBy("list").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.max("m").alias("most"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    share = F.col("n") / BLOCK_ELEMENTS
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(share)).cast("int")
    probing = F.greatest(F.ceil((F.col("m") - F.col("most")) / block), F.ceil(share * (F.col("m") - F.col("most")) / F.col("m")), F.lit(1)).cast("int")
    known = materialize(known.select("list", "largest", blocks.alias("blocks"), probing.alias("probings")))
    placed = members.join(broadcast_if_small(known), "list").withColumn("probe", F.col("root") != F.col("largest"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    single = (F.col("blocks") == 1) & (F.col("probings") == 1)
    as_member = F.transform(every("probings"), lambda p: F.struct(part("blocks").alias("block"), p.alias("probes"), F.when(single & F.col("probe"), BOTH).otherwise(MEMBER).alias("kind")))
    as_probe = F.transform(every("blocks"), lambda b: F.struct(b.alias("block"), part("probings").alias("probes"), F.lit(PROBE).alias("kind")))
    dealt = F.when(single | ~F.col("probe"), as_member).otherwise(F.concat(as_member, as_probe))
    dealt = placed.select("list", "node", "root", F.explode(dealt).alias("d")).select("list", "d.*", "node", "root")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    beside = dealt.join(carried, "node").repartition(parts, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    return beside.select(*BLOCK_KEY, "kind", "node", "root", *[c for c in carried.columns if c != "node"])


def hopeful(members: DataFrame, sketches: DataFrame, block: int, likely: Likeness, sketch: str) -> DataFrame:
    """The rows of the unsettled lists ``members`` that have, by their sketches (node, sketch), a likely partner of another group in their list."""
    members = materialize(members)
    found = materialize(_dealt(members.withColumn("n", F.lit(1)), block, sketches).mapInPandas(_hoping(likely, sketch), "list long, node long").distinct())
    return materialize(members.join(broadcast_if_small(found), ["list", "node"]))


def between(members: DataFrame, sets: DataFrame, jaccard: float, block: int = BLOCK, likely: Likeness | None = None, sketch: str | None = None) -> DataFrame:
    """(a, b): links that join groups of the unsettled lists ``members``.

    sets: (node, shingles, n), and with ``likely`` a column ``sketch`` of arrays of the numpy type ``sketch``.
    """
    members = materialize(members.join(sets.select("node", "n"), "node"))
    carried = ["shingles", "sketch"] if likely is not None else ["shingles"]
    return materialize(_dealt(members, block, sets.select("node", *carried)).mapInPandas(_joined(jaccard, likely, sketch), "a long, b long"))
