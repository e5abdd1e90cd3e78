"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are summed per source. Sources are ranked in code-point order (null last) over range
   partitions; weights 5, 2, 1 repeat over the ranks. Shares of 150 % of all words are capped at twice a
   source's size and the excess is shared again by weight: each round is one aggregation of the sources'
   table, until no further source reaches its cap.
2. A source's documents lie in the order of a keyed digest, which is a random permutation; the
   digest's first three hex digits cut it into 4096 blocks. A quota below the source's size
   takes a prefix of that permutation; beyond it the whole source and a prefix of a second,
   independent permutation. Only block totals are summed along a source (at most 4096 rows); the one block
   the quota ends in gives the digest at which it ends, so a hot source is never gathered and a document is
   judged by comparing its digest with its source's. The document in which a quota ends is cut, so quotas are met exactly.
3. The taken blocks are dealt to output shards by the tree. Sources are hashed to ``BUCKETS`` buckets; a node splits
   its block counts per bucket between its halves with a multivariate hypergeometric draw, so every shard
   has the composition of a uniform shuffle, exact quotas add up, and shards draw disjoint ranges
   of permuted blocks. Below, each bucket's share of every shard is dealt to its sources in the same way, one task a
   bucket. A document gives words to a shard that drew its block, and to none if no shard did. Inside a shard, documents are
   ordered by another digest, their place: ``mixed_rows`` moves them to their shards and sorts there. A shard is laid out in up to
   ``PARTS`` parts by the leading digits of the place, so that it is not the work of one task.

What decides about a document is its source's row and its block's row; both are broadcast after a count, so neither
documents nor texts are shuffled.

Edge cases: a null source is a source of its own; null and empty texts have size 0 and are
taken 0 words; a document without an id goes by a digest of its text; very long texts are counted and cut whole; repeated rows count
once each, and where a quota ends among rows of one id the smaller ones come first (identical rows being equal; they are
numbered within the tasks that wrote them and counted between tasks, so a row repeated without bound is no one task's work);
an empty table gives no rows; further columns are ignored by ``mix``, and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, broadcast_if_small, materialize, table, unused, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_DIGITS = 3
SHARDS = 16
PART_DIGITS = 2
PARTS = 16**PART_DIGITS
BUCKETS = 256


def source_plan(sizes: DataFrame) -> DataFrame:
    """(source, size, target) of (source, size): shares by weight, filled up to their caps."""
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialize(sizes.repartitionByRange(*order).select("source", "size", F.spark_partition_id().alias("part")))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    before = np.cumsum([0, *[r["n"] for r in parts]]).tolist()
    offsets = spark.createDataFrame([(r["part"], n) for r, n in zip(parts, before, strict=False)], "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    known = materialize(dealt.join(F.broadcast(offsets), "part").select("source", "size", (F.col("size") * MOST).alias("cap"), weight.cast("long").alias("weight")))
    first = known.agg(F.sum("size"), F.sum("weight")).first()
    total, unit, full = SHARE * (first[0] or 0), 0.0, -1
    caps, weights = 0, first[1] or 0
    while weights:
        unit = (total - caps) / weights
        over = F.col("weight") * F.lit(unit) >= F.col("cap")
        now = known.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if now[0] == full:
            break
        full, caps, weights = now[0], now[1] or 0, now[2] or 0
    share = F.col("weight") * F.lit(unit)
    target = F.when((share >= F.col("cap")) | F.lit(not weights), F.col("cap").cast("double")).otherwise(share)
    return known.select("source", "size", target.alias("target"))


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: recursive multivariate hypergeometric halving."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def halve(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[left] = have
            return
        mid = (left + right) // 2
        draw = int(have.sum()) * (mid - left) // (right - left)
        mine = np.zeros_like(have)
        rest, want = int(have.sum()), draw
        for i, n in enumerate(have.tolist()):
            rest -= n
            mine[i] = rng.hypergeometric(n, rest, want) if n and want else 0
            want -= int(mine[i])
        halve(left, mid, mine)
        halve(mid, right, have - mine)

    halve(0, shards, counts.astype(np.int64))
    return out


def _dealt(quotas: dict[int, list[int]], seed: str):
    """The positions of a source's taken blocks for each shard, from the shares of its bucket."""

    def run(sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values(["epoch", "skey"])
        bucket = int(sources["bucket"].iloc[0])
        left = np.array(quotas[bucket], dtype=np.int64)
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(f"{seed}:{bucket}".encode())))
        out = []
        for epoch, skey, n in zip(sources["epoch"], sources["skey"], sources["n"], strict=True):
            mine = rng.multivariate_hypergeometric(left, int(n), method="marginals")
            left -= mine
            ends = mine.cumsum().tolist()
            out += [(epoch, skey, shard, end - m, end) for shard, (m, end) in enumerate(zip(mine.tolist(), ends, strict=True)) if m]
        return pd.DataFrame(out, columns=["epoch", "skey", "shard", "first", "last"])

    return run


def _keyed(docs: DataFrame, seed: str, *keep) -> DataFrame:
    """The columns ``keep`` with a document's source key, key, size and places in both permutations."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    skey = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = docs.select(*keep, skey.alias("skey"), key.alias("key"), word_count(F.col("text")).alias("size"))
    for e in (1, 2):
        rows = rows.withColumn(f"digest{e}", F.md5(F.concat("key", F.lit(f"{seed}:{e}"))))
        rows = rows.withColumn(f"block{e}", F.conv(F.substring(f"digest{e}", 1, BLOCK_DIGITS), 16, 10).cast("int"))
    return rows


def _decisions(kept: DataFrame, shards: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """What decides about documents: a row for each source, and one for each taken block.

    Of a source: its size and target, and for each pass the quota, the digest it ends at (null if it takes all), the
    words left there and the rows of that digest. Of a block: epoch, skey, block, shard.
    """
    spark = kept.sparkSession
    source = F.when(F.col("skey") != "null", F.substring("skey", 2, 2**31 - 1))
    plan = source_plan(kept.groupBy("skey").agg(F.sum("size").alias("size")).select(source.alias("source"), "size"))
    whole = F.floor("target").cast("long")
    quotas = plan.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("skey"), F.col("size").alias("source_size"), "target",
        F.least(whole, F.col("size")).alias("quota1"), F.greatest(F.lit(0), whole - F.col("size")).alias("quota2"),
    )
    quotas = materialize(quotas)
    rows = kept.join(broadcast_if_small(quotas), "skey")

    # Totals of blocks, cumulated along each source: at most 4096 rows a source and epoch.
    each = []
    for e in (1, 2):
        b = rows.where(f"quota{e} > 0").groupBy("skey", F.col(f"block{e}").alias("block"), F.col(f"quota{e}").alias("quota")).agg(F.sum("size").alias("words"))
        each.append(b.select(F.lit(e).alias("epoch"), "skey", "block", "words", "quota"))
    w = Window.partitionBy("epoch", "skey").orderBy("block")
    blocks = each[0].union(each[1]).withColumn("before", F.sum("words").over(w) - F.col("words")).where("before < quota and words > 0")
    blocks = materialize(blocks.withColumn("at", F.row_number().over(w) - 1))

    # The documents of the one block a quota ends in, in order: where does it end?
    ends = []
    for e in (1, 2):
        last = broadcast_if_small(blocks.where(f"epoch = {e} and before + words > quota").select("skey", F.col("block").alias(f"block{e}"), "before"))
        found = rows.join(last, ["skey", f"block{e}"]).groupBy("skey", F.col(f"digest{e}").alias(f"cut{e}"), F.col(f"quota{e}").alias("quota"), "before").agg(F.sum("size").alias("words"), F.count("*").alias(f"rows{e}"))
        along = Window.partitionBy("skey").orderBy(f"cut{e}").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("quota") - F.col("before") - F.coalesce(F.sum("words").over(along), F.lit(0))
        ends.append(found.withColumn(f"left{e}", left).where(f"left{e} > 0 and left{e} <= words").select("skey", f"cut{e}", f"left{e}", f"rows{e}"))
    sources = materialize(quotas.join(ends[0], "skey", "left").join(ends[1], "skey", "left"))

    # The tree deals buckets of sources to the shards, and each bucket's shares to its sources.
    counts = blocks.groupBy("epoch", "skey").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("epoch", "skey"), F.lit(BUCKETS)).cast("int"))
    totals = sorted(tuple(r) for r in counts.groupBy("bucket").agg(F.sum("n")).collect())  # at most BUCKETS rows
    shares = split_quotas(np.array([n for _, n in totals], dtype=np.int64), shards, zlib.crc32(seed.encode()))
    quota = {b: shares[:, i].tolist() for i, (b, _) in enumerate(totals)}
    deal = counts.groupBy("bucket").applyInPandas(_dealt(quota, seed), "epoch int, skey string, shard int, first long, last long")
    placed = blocks.join(broadcast_if_small(materialize(deal)), ["epoch", "skey"]).where("at >= first and at < last")
    return sources, materialize(placed.select("epoch", "skey", "block", "shard"))


def _drawn(rows: DataFrame, sources: DataFrame, placed: DataFrame, seed: str) -> DataFrame:
    """rows, as ``_keyed`` gives them, with source_size, target, taken and draws."""
    rows = rows.join(broadcast_if_small(sources), "skey")
    for e in (1, 2):
        place = placed.where(F.col("epoch") == e).select("skey", F.col("block").alias(f"block{e}"), F.col("shard").alias(f"shard{e}"))
        rows = rows.join(broadcast_if_small(place), ["skey", f"block{e}"], "left")
    shared = F.lit(False)
    for e in (1, 2):
        shared = shared | ((F.col(f"digest{e}") == F.col(f"cut{e}")) & (F.col(f"rows{e}") > 1))
    shared = F.coalesce(shared, F.lit(False))
    zero = F.lit(0).cast("long")
    parts = [rows.where(~shared).withColumn("ahead", zero)]
    if not sources.where("rows1 > 1 or rows2 > 1").isEmpty():
        # Rows of one digest share what is left of a quota: summed by size and task, then numbered within those.
        few = materialize(rows.where(shared).withColumn("task", F.shiftright(F.monotonically_increasing_id(), 33)))
        same = ["skey", "digest1", "size", "task"]
        w = Window.partitionBy("skey", "digest1").orderBy("size", "task").rowsBetween(Window.unboundedPreceding, -1)
        sums = few.groupBy(*same).agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(w), zero)).drop("words")
        nth = F.row_number().over(Window.partitionBy(*same).orderBy("key")) - 1
        parts.append(few.withColumn("nth", nth).join(sums, same).withColumn("ahead", F.col("before") + F.col("nth") * F.col("size")).select(*parts[0].columns))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    draws = []
    for e in (1, 2):
        digest, cut = F.col(f"digest{e}"), F.col(f"cut{e}")
        rest = F.greatest(zero, F.least(F.col("size"), F.col(f"left{e}") - F.col("ahead")))
        drawn = (F.col(f"quota{e}") > 0) & F.col(f"shard{e}").isNotNull()
        took = F.when(~drawn, zero).when(cut.isNull() | (digest < cut), F.col("size")).when(digest == cut, rest).otherwise(zero)
        rows = rows.withColumn(f"words{e}", took)
        place = F.md5(F.concat("key", F.lit(f"{seed}:place{e}")))
        draws.append(F.when(F.col(f"words{e}") > 0, F.struct(F.lit(e).alias("epoch"), F.col(f"words{e}").alias("words"), F.col(f"shard{e}").alias("shard"), place.alias("place"))))
    return rows.withColumn("taken", F.col("words1") + F.col("words2")).withColumn("draws", F.filter(F.array(*draws), lambda d: d.isNotNull()))


def mix(docs: DataFrame, seed: str = ":mix", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and its draws.

    ``draws`` lists structs (epoch, words, shard, place): which pass takes how many of its first
    words, for which output shard, and the key of its place in that shard's shuffled order.
    """
    kept = materialize(_keyed(docs, seed, "doc_id", "source"))
    drawn = _drawn(kept, *_decisions(kept, shards, seed), seed)
    return drawn.select("doc_id", "source", "size", "source_size", "target", "taken", "draws")


def mixed_rows(docs: DataFrame, seed: str = ":mix", shards: int = SHARDS) -> DataFrame:
    """The mix itself: (row, shard, place), a row for each draw, in the order of its shard.

    ``row`` is a struct of docs' columns with the text cut to the draw's words; a column n_chars, if there is one, is counted again.
    Texts are read a second time, cut, and moved once, to their shard and their part of it.
    """
    kept = materialize(_keyed(docs, seed))
    rows = _keyed(docs, seed, F.struct(*docs.columns).alias("row"))
    rows = _drawn(rows, *_decisions(kept, shards, seed), seed).select("row", "size", F.explode("draws").alias("d")).select("row", "size", "d.words", "d.shard", "d.place")
    # The end of the last word taken: the words before it and the white space between.
    lead = F.regexp_extract_all("row.text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    cut = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(lead, F.lit(1), F.col("words").cast("int")), ""))
    rows = rows.withColumn("cut", cut)
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    rows = rows.select(F.struct(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]).alias("row"), "shard", "place")
    return rows.repartition("shard", F.substring("place", 1, PART_DIGITS)).sortWithinPartitions("shard", "place")


def mixed_documents(docs: DataFrame, seed: str = ":mix", shards: int = SHARDS) -> DataFrame:
    """docs' columns of ``mixed_rows``, in its order."""
    return mixed_rows(docs, seed, shards).select("row.*")


def write_shards(docs: DataFrame, path: str, seed: str = ":mix", shards: int = SHARDS) -> None:
    """The mix as Parquet folders ``shard=N``; the files of a shard, each sorted by place, hold disjoint sets of its parts."""
    mixed_rows(docs, seed, shards).select("row.*", F.col("place").alias(unused("place", docs.columns)), "shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir):
    """``draws`` lists epoch:shard:words:place, comma-joined, in the order of the passes."""
    shown = F.transform("draws", lambda d: F.concat_ws(":", d["epoch"].cast("string"), d["shard"].cast("string"), d["words"].cast("string"), d["place"]))
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.array_join(shown, ",").alias("draws"))


#: Sizes, targets and words taken; the hypergeometric draws have no SQL, so this covers all columns of the query but ``draws``.
SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT source, n, 2 * n AS cap, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(n) OVER () * 1.5::DOUBLE AS total FROM s
), o AS (
  SELECT *, sum(cap) OVER p AS caps, sum(weight) OVER p AS weights, sum(weight) OVER () AS all_weights,
         lead(cap::DOUBLE / weight) OVER q AS next_ratio, cap::DOUBLE / weight AS ratio
  FROM w WINDOW q AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST), p AS (q ROWS UNBOUNDED PRECEDING)
), u AS (
  SELECT max(unit) AS unit FROM (
    SELECT total / all_weights AS unit, ratio AS next_ratio, 0 AS k FROM (SELECT * FROM o ORDER BY ratio LIMIT 1)
    UNION ALL
    SELECT (total - caps) / (all_weights - weights), next_ratio, 1 FROM o WHERE next_ratio IS NOT NULL
  ) WHERE unit < next_ratio
), t AS (
  SELECT source, n, CASE WHEN u.unit IS NULL OR weight * u.unit >= cap THEN CAST(cap AS DOUBLE) ELSE weight * u.unit END AS target FROM w, u
), r AS (
  SELECT doc_id, size, n, target,
         least(CAST(floor(target) AS BIGINT), n) AS q1, greatest(0, CAST(floor(target) AS BIGINT) - n) AS q2,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(key || ':mix:1'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b1,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(key || ':mix:2'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, n AS source_size, target,
       CAST(greatest(0, least(size, q1 - b1)) + greatest(0, least(size, q2 - b2)) AS BIGINT) AS taken
FROM r
"""
