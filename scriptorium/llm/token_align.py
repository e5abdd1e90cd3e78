"""Alignment of two tokenizers by a dangling-suffix transducer.

A text is tokenized twice, with a space before it: by a byte-level model (A) and by a piece model (B, which adds the
space itself). The transducer reads both sequences at once. Its state is the side that leads and the bytes by which it
does (the residual, always a suffix of one token, so the vocabularies bound the states); the next token comes from the
other side, from A if nothing dangles. A transition depends on the residual and that token alone and is remembered
(``MOST_STEPS`` at most, then the memory starts afresh). Where the residual is empty both sides end together: a group
closes, and its last tokens are a link.

Neither vocabulary joins or looks across a single space between two characters that are not white space, so texts
fall into units there; tokens, groups and links of a unit are the same wherever it stands, and the residual at its ends is
empty. A worker remembers units (``MOST_UNITS`` in each of two generations, of up to ``LONGEST_UNIT`` characters); new ones are
encoded many at a time.

Links are counted by id pair in each document, the document's pairs are written once, and counts of the corpus are their sums. Pairs that
make up a ``SHARE``-th of all links or more, which are ``SHARE`` at most, are broadcast with their counts; the others are few in a document and are joined by shuffle.

Edge cases: null and empty texts, and texts whose tokens do not give their bytes back (such as those with U+2581, which B
reads as a space), have no tokens: zeros and an empty digest; very long texts, and texts without spaces, are encoded whole; rows with
null or repeated ids are rows of their own, and repeated rows count once each; ties for the highest count are all best;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import tokenizer_path

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_STEPS = 1_000_000
MOST_UNITS = 250_000
LONGEST_UNIT = 64
#: Characters of new units that are encoded in one call.
TOGETHER = 20_000
#: Documents of an output batch.
DOCS = 256
SHARE = 100_000
#: White space in any model's sense ends no unit.
_UNIT = re.compile(r"(?<=\S) (?=\S)")
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, ns array<int>"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Reads two token sequences of one text; tokens are given by their bytes, by id."""

    WIDTH = 1 << 20

    def __init__(self, a: list[bytes], b: list[bytes], most: int = MOST_STEPS) -> None:
        self.bytes, self.most = (a, b), most
        self._forget()

    def _forget(self) -> None:
        #: States by number: which side is read next (0 is A), and the residual of the other one.
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers = {(0, b""): 0}
        self.steps: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after a token; -1 if the sides' bytes differ."""
        side, rest = self.states[state]
        piece = self.bytes[side][token]
        if rest.startswith(piece):
            after = (side, rest[len(piece) :])
        elif piece.startswith(rest):
            after = (1 - side, piece[len(rest) :])
        else:
            return -1
        if not after[1]:
            after = (0, b"")
        number = self.numbers.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self.steps[state * self.WIDTH + token] = number
        return number

    def cuts(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each side lie before the end of every group; None if the sides' bytes differ."""
        if len(self.steps) > self.most:
            self._forget()
        out, i, j, m, n = [], 0, 0, len(a), len(b)
        state, steps, states, width = 0, self.steps, self.states, self.WIDTH
        while True:
            if states[state][0]:
                if j == n:
                    return None
                token = b[j]
                j += 1
            else:
                if i == m:
                    return out if not state and j == n else None
                token = a[i]
                i += 1
            try:
                state = steps[state * width + token]
            except KeyError:
                state = self.step(state, token)
            if state <= 0:
                if state < 0:
                    return None
                out.append((i, j))


class Aligner:
    """Tokens, groups and links of whole texts, unit by unit from a worker's memory."""

    def __init__(self, byte_model: str, piece_model: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        letters = byte_letters()
        vocabulary = Tokenizer.from_file(byte_model).get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}
        # Ids are the order of merges there, which is all that the faster library needs.
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            self.a_bytes[i] = w
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _encoded(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_ordinary(f" {text}"), self.b.encode(text)

    def _whole(self, text: str, lengths: list[int]) -> list[tuple] | None:
        """The records of a text's units, of so many bytes each with their spaces; None if its tokens do not give its bytes back."""
        a, b = self._encoded(text)
        raw = f" {text}".encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        cuts = self.transducer.cuts(a, b)
        if cuts is None:
            return None
        as_text, bs_text = list(map(str, a)), list(map(str, b))
        groups, i, j = [], 0, 0
        for x, y in cuts:
            one = x - i == 1 == y - j
            groups.append(f"{as_text[i]}|{bs_text[j]}" if one else f"{','.join(as_text[i:x])}|{','.join(bs_text[j:y])}")
            i, j = x, y
        at = np.array(cuts, dtype=np.int64).reshape(-1, 2)
        links = (np.array(a, dtype="<i8")[at[:, 0] - 1] << 32 | np.array(b, dtype="<i8")[at[:, 1] - 1]).tobytes()
        # Units end where groups end: which group of the text is the last of each unit?
        closed, wanted = np.cumsum([len(self.a_bytes[i]) for i in a])[at[:, 0] - 1], np.cumsum(lengths)
        stops = np.searchsorted(closed, wanted) + 1
        if not np.array_equal(closed[stops - 1], wanted):
            return None
        ends = [(0, 0, 0), *zip(stops.tolist(), *at[stops - 1].T.tolist(), strict=True)]
        return [(y - x, v - u, ";".join(groups[p:q]), links[8 * p : 8 * q]) for (p, x, u), (q, y, v) in zip(ends, ends[1:], strict=False)]

    def _learn(self, units: list[str]) -> None:
        """Encodes units many at a time, one by one if some of them lose bytes."""
        batch, size = [], 0
        for u in units:
            if u[:1].isspace() or u[-1:].isspace() or not u:
                # At the ends of a text: joined to others, white space would not stay by itself.
                self.known[u] = (self._whole(u, [len(u.encode()) + 1]) or [None])[0]
        for u in [*(u for u in units if u not in self.known), None]:
            if batch and (u is None or size + len(u) > TOGETHER):
                lengths = [len(x.encode()) + 1 for x in batch]
                found = self._whole(" ".join(batch), lengths)
                if found is None:
                    found = [(self._whole(x, [n]) or [None])[0] for x, n in zip(batch, lengths, strict=True)]
                self.known.update(zip(batch, found, strict=True))
                batch, size = [], 0
            if u is not None:
                batch.append(u)
                size += len(u) + 1

    def units(self, texts: list[str]) -> list[list[tuple | None]]:
        """What is known of each unit of each text."""
        cut = [_UNIT.split(t) for t in texts]
        new = [u for u in set().union(*cut) if u not in self.known]
        if len(self.known) + len(new) > MOST_UNITS:
            self.older, self.known = self.known, {}
            new = list(set().union(*cut))
        self.known.update((u, self.older[u]) for u in new if u in self.older)
        self._learn([u for u in new if u not in self.older])
        out = [[self.known[u] for u in units] for units in cut]
        for u in new:
            if len(u) > LONGEST_UNIT:
                del self.known[u]
        return out


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner_at(byte_model: str, piece_model: str) -> Aligner:
    """A worker's own aligner, kept with its memory from task to task."""
    key = (byte_model, piece_model)
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


def _align(byte_model: str, piece_model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = aligner_at(byte_model, piece_model)
        for df in batches:
            for at in range(0, len(df), DOCS):
                part = df.iloc[at : at + DOCS]
                texts = ["" if t is None else t for t in part["text"]]
                rows = []
                for text, units in zip(texts, aligner.units(texts), strict=True):
                    if not text or None in units:
                        rows.append((0, 0, 0, 0, "", [], []))
                        continue
                    pairs, ns = np.unique(np.frombuffer(b"".join([u[3] for u in units]), dtype="<i8"), return_counts=True)
                    n = int(ns.sum())
                    digest = hashlib.sha256(";".join([u[2] for u in units]).encode()).hexdigest()
                    rows.append((sum([u[0] for u in units]), sum([u[1] for u in units]), n, n, digest, pairs, ns))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "ns"], index=part.index)
                yield pd.concat([part[["row", "doc_id"]], out], axis=1).astype({"doc_id": "Int64"})

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair (A's id << 32 | B's id), and whether no pair of its B id has more."""
    counts = materialize(_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def _pairs(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "ns")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.ns").alias("n"))


def align(docs: DataFrame, byte_model: str, piece_model: str, share: int = SHARE) -> DataFrame:
    """Per row of (doc_id, text): numbers of tokens, groups and links, digest of the groups, and what the corpus says of its links."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    aligned = materialize(texts.mapInPandas(_align(byte_model, piece_model), _ALIGNED))
    judged = pair_counts(aligned)
    total = judged.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = F.col("count") * share >= total
    frequent = F.broadcast(judged.where(often))  # at most ``share`` pairs
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum")]
    each = _pairs(aligned)
    rare = each.join(frequent.select("pair"), "pair", "left_anti").join(judged.where(~often), "pair")
    found = each.join(frequent, "pair").groupBy("row").agg(*sums).union(rare.groupBy("row").agg(*sums))
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return aligned.drop("pairs", "ns").join(found, "row", "left").select(*own, zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_MODEL), tokenizer_path(PIECE_MODEL))
