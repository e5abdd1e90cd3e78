"""Harmonic packing of tokenized documents into sequences of 4096 tokens.

A document's ids (with the end id) are cut into pieces whose length is exactly the largest one of
a reciprocal-capacity class: the class of k pieces a sequence holds lengths in
(4096 / (k + 1), 4096 / k], and a piece is floor(4096 / k) long. Whole sequences are cut first, then
the rest by the largest class that fits, and so on; below 64 tokens a class holds a single length.
A class's sequences take k pieces each, at fixed offsets, independently of all other classes and
workers: a piece's sequence follows from its rank in its class, which is its place in its
partition and class plus the counts of the partitions before. The fewer than k pieces that
remain of each class (about twenty thousand pieces at most, whatever the input) are
packed together by best fit.

Each document is tokenized once; what is written and ranked is one short row per piece.

Edge cases: null and empty texts are the end id alone; very long texts are cut like any other; a
repeated row is packed as often as it occurs; rows with a null id are packed too; pieces of equal length lie in the order they are
read, those left over by length, id and start; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, kept, materialize, table

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 200_000
#: Marks that may follow a run of letters (no apostrophe: contractions are split otherwise).
MARKS = ".,;:!?*#%&$|<>()-"
#: Letters below this one have a single, composed lower-case form.
SIMPLE = "\u0130"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, word by word from a cache.

    The vocabulary never joins across white space, so a text's ids are those of its words in a
    row; only blanks and line feeds separate words here, the tokenizer sees any other white space.
    It splits letters from marks, and every run of letters ends with an id that closes a word: so
    unknown runs are encoded many at a time and told apart by those ids. Words of another make are
    encoded one by one. Two generations of the cache bound what a worker remembers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                self.older, self.known = known, {"": b""}
                new = [w for w in set(words) if w]
            self._learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, new: list[str]) -> None:
        known, older = self.known, self.older
        parts, fresh = [], set()
        for w in new:
            if w in older:
                known[w] = older[w]
                continue
            core = w.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or max(core) < SIMPLE):
                key, tail = core.lower(), w[len(core) :]
                parts.append((w, key, tail))
                if key not in known:
                    if key in older:
                        known[key] = older[key]
                    else:
                        fresh.add(key)
                if tail not in known:
                    known[tail] = self._one(tail)
            else:
                known[w] = self._one(w)
        if fresh:
            runs = list(fresh)
            ids = np.array(self.model.encode(" ".join(runs), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(runs) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for run, end in zip(runs, (ends * 4).tolist(), strict=True):
                    known[run] = raw[at:end]
                    at = end
            else:
                for run in runs:
                    known[run] = self._one(run)
        for w, key, tail in parts:
            known[w] = known[key] + known[tail]

    def _one(self, word: str) -> bytes:
        return np.array(self.model.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


def tokenizer_at(path: str) -> WordTokenizer:
    """A worker's own tokenizer, kept with its cache from task to task."""
    return kept(("packing", path), lambda: WordTokenizer(path))


def cuts(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of so many tokens."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest  # the class rest lies in; its largest length may be longer than rest
        size = rest if capacity // k == rest else capacity // (k + 1)
        out.append(size)
        rest -= size
    return out


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = tokenizer_at(path)
        end = end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for df in batches:
            rows = []
            for doc_id, text in zip(df["doc_id"], df["text"], strict=True):
                ids = tokenize(text) + end
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity):
                    rows.append((doc_id, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, part, seen[size]))
                    seen[size] += 1
                    at += size
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    return run


def _best_fit(capacity: int):
    """Packs the pieces left over, in one task: (…, bin, offset) for each."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "rank"], ascending=[False, True], kind="stable")
        free: list[tuple[int, int]] = []  # (room, bin), sorted
        bins, offsets, made = [], [], 0
        for n in df["length"].tolist():
            i = bisect.bisect_left(free, (n, -1))
            room, b = free.pop(i) if i < len(free) else (capacity, made)
            made += b == made
            bins.append(b)
            offsets.append(capacity - room)
            if room > n:
                bisect.insort(free, (room - n, b))
        df["bin"], df["offset"] = bins, offsets
        return df

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in which sequence."""
    spark = docs.sparkSession
    pieces = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_pieces(tokenizer_path, end_id, capacity), PIECES))
    w = Window.partitionBy("length").orderBy("part")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("length")))
    # Sequences of a class follow those of all shorter classes.
    per = F.floor(F.lit(capacity) / F.col("length"))
    sizes = counts.groupBy("length").agg(F.first("all").alias("all")).withColumn("full", F.floor(F.col("all") / per))
    sizes = sizes.withColumn("base", F.sum("full").over(Window.orderBy("length")) - F.col("full"))  # a row for each of at most 4096 lengths
    where = materialize(counts.drop("all").join(F.broadcast(sizes), "length"))
    total = where.select("length", "full").distinct().agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    ranked = pieces.join(broadcast_if_small(where.select("length", "part", "before", "full", "base")), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).withColumn("place", F.floor(F.col("rank") / per))
    in_class = F.col("place") < F.col("full")
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = ranked.where(in_class).select(*own, (F.col("base") + F.col("place")).cast("long").alias("sequence_id"), ((F.col("rank") % per) * F.col("length")).cast("long").alias("offset"))
    rest = ranked.where(~in_class).select(*own, "rank").groupBy().applyInPandas(_best_fit(capacity), ", ".join([*(f"{c} long" for c in own), "rank long", "bin long", "offset long"]))
    return whole.union(rest.select(*own, (F.col("bin") + F.lit(total)).alias("sequence_id"), "offset"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
