"""The engine's tables on shared storage, as segments of rows and of hidden keys.

A commit writes one segment: the new rows of some tables, and keys whose rows in earlier segments no longer
count. What it costs therefore grows with the change, not with the corpus. A numbered manifest lists the segments;
it appears under its final name by one rename that never replaces a file, so of two writers one comes first, and readers that hold a number
keep seeing its segments.

Two writers. A commit names the version it was computed from and the documents it touches. If others have committed since, and touched none of
these, the segment is added after theirs; if they have, or if the version is older than the log of touched keys (``LOG`` commits), the commit raises
``Conflict`` and nothing of it appears: the caller reads again and computes again.

Merging. Neighbouring segments of one size class (each class ``FANOUT`` times the one below) are merged when there are ``FANOUT`` of them, so a
byte is written again once a class and not once every few commits: O(log n) times. ``clean`` removes what recent manifests no longer name.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import keyword

#: The tables, their schemas and the key that replaces their rows (rows of blocks add up and are never replaced).
TABLES = {
    "docs": (schemas.DOCS, "doc_id"), "chunks": (schemas.CHUNKS, "doc_id"), "vectors": (schemas.VECTORS, "chunk_id"), "edges": (schemas.EDGES, "src"),
    "postings": (schemas.POSTINGS, "chunk_id"), "lengths": (schemas.LENGTHS, "chunk_id"), "blocks": (schemas.BLOCKS, None), "gone": (schemas.GONE, "doc_id"), "meta": (schemas.META, "key"),
}
FANOUT = 4
#: Bytes of the smallest size class.
SMALL = 1 << 20
#: Commits whose touched keys are kept for later writers.
LOG = 64
#: Attempts to put a manifest after one that came first.
ATTEMPTS = 20
_MANIFEST = "manifest-"


class Conflict(OSError):
    """Another writer has changed, since this one read, what it changes."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def versions(self) -> list[int]:
        """The numbers of all manifests, oldest first."""
        fs, at = _files(self.spark, self.root)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(_MANIFEST) :]) for n in names if n.startswith(_MANIFEST) and n[len(_MANIFEST) :].isdigit())

    def current(self) -> int | None:
        """The latest version, None before the first commit."""
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"segments": [], "log": []}
        return json.loads(self.spark.read.text(f"{self.root}/{_MANIFEST}{version:012d}").first()[0])

    def segments(self, version: int | None = None) -> list[dict]:
        """The segments of a version, oldest first: id, bytes, tables with rows, and where the hidden keys of which tables are."""
        return self._manifest(self.current() if version is None else version)["segments"]

    def _placed(self, name: str, segments: list[dict]) -> DataFrame | None:
        """A table's rows in these segments that none of the later ones of them hides, with ``at_``, the place of their segment; None without rows."""
        schema, key = TABLES[name]
        found, hidden = [], []
        for i, s in enumerate(segments):
            if name in s["rows"]:
                found.append(self.spark.read.schema(schema).parquet(f"{self.root}/{s['id']}/{name}").select(*schema.fieldNames(), F.lit(i).alias("at_")))
            if name in s["hidden"] and found:
                hidden += [self.spark.read.schema("key_ string").parquet(f"{self.root}/{at}").select("key_", F.lit(i).alias("until_")) for at in s["hidden"][name]]
        if not found:
            return None
        rows = reduce(DataFrame.unionAll, found)
        if hidden:
            last = reduce(DataFrame.unionAll, hidden).groupBy("key_").agg(F.max("until_").alias("until_"))
            rows = rows.join(last, (F.col(key) == F.col("key_")) & (F.col("at_") < F.col("until_")), "left_anti")
        return rows

    def read(self, name: str, version: int | None = None) -> DataFrame:
        rows = self._placed(name, self.segments(version))
        return self.spark.createDataFrame([], TABLES[name][0]) if rows is None else rows.drop("at_")

    def _write(self, name: str, rows: DataFrame, segment: str) -> None:
        rows, at = rows.select(*TABLES[name][0].fieldNames()), f"{self.root}/{segment}/{name}"
        if name == "chunks":
            # Visibility is a directory level: the gate prunes partitions.
            rows.write.partitionBy("sensitivity").parquet(at)
        elif name == "postings":
            # Sorted by term and block over all files, so that a question reads few row groups, and a frequent term lies in many.
            rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(at)
        else:
            rows.write.parquet(at)

    def _bytes(self, segment: str) -> int:
        fs, at = _files(self.spark, f"{self.root}/{segment}")
        return fs.getContentSummary(at).getLength()

    def commit(self, rows: dict[str, DataFrame], hidden: dict[str, DataFrame] | None = None, *, base: int | None = None, touched: DataFrame | None = None) -> int:
        """Adds a segment: new rows, after the rows of earlier segments with the ``hidden`` keys are taken away.

        base: the version that all this was computed from (the current one if it is not given). touched: the keys it answers for; without them any
        commit since ``base`` is a conflict.
        """
        base = self.current() if base is None else base
        segment, hidden = uuid.uuid4().hex, hidden or {}
        places: dict[int, str] = {}
        for name, keys in hidden.items():
            if id(keys) not in places:  # tables that hide the same keys share them
                places[id(keys)] = f"{segment}/hidden-{name}"
                keys.select(F.col(keys.columns[0]).cast("string").alias("key_")).distinct().write.parquet(f"{self.root}/{places[id(keys)]}")
        for name, df in rows.items():
            self._write(name, df, segment)
        if touched is not None:
            touched.select(F.col(touched.columns[0]).cast("string").alias("key_")).distinct().write.parquet(f"{self.root}/{segment}/touched")
        new = {"id": segment, "bytes": self._bytes(segment), "rows": sorted(rows), "hidden": {name: [places[id(keys)]] for name, keys in hidden.items()}}
        for _ in range(ATTEMPTS):
            now = self.current()
            old = self._manifest(now)
            self._agree(segment, base, now, old["log"], touched is not None)
            version = 0 if now is None else now + 1
            entry = {"version": version, "touched": f"{segment}/touched" if touched is not None else None}
            if self._publish({"segments": [*old["segments"], new], "log": [*old["log"], entry][-LOG:]}, version):
                return self.merge() or version
        raise Conflict(f"{ATTEMPTS} others came first in {self.root}")

    def _agree(self, segment: str, base: int | None, now: int | None, log: list[dict], known: bool) -> None:
        """Raises ``Conflict`` if a commit after ``base`` touched what this segment touches, or may have."""
        if base == now:
            return
        since = [x for x in log if base is None or x["version"] > base]
        if not known or any(x["touched"] is None for x in since) or len(log) == LOG and len(since) == LOG:
            raise Conflict(f"version {now} of {self.root} was written since {base} was read")
        mine = self.spark.read.schema("key_ string").parquet(f"{self.root}/{segment}/touched")
        theirs = [f"{self.root}/{x['touched']}" for x in since]
        if theirs and not mine.join(self.spark.read.schema("key_ string").parquet(*theirs), "key_", "left_semi").isEmpty():
            raise Conflict(f"documents of this commit were changed in {self.root} since version {base}")

    def _merged(self, segments: list[dict], first: bool) -> dict:
        """One segment in place of neighbouring ones: their rows that count, and all keys they hide from earlier segments."""
        segment, names = uuid.uuid4().hex, sorted({n for s in segments for n in s["rows"]} - {"blocks"})
        written: dict[str, DataFrame] = {}
        for name in names:
            rows = self._placed(name, segments).drop("at_")
            if name == "postings":
                rows = keyword.blocked(rows.withColumnRenamed("chunk_id", "id")).withColumnRenamed("id", "chunk_id")
            self._write(name, rows, segment)
            written[name] = self.spark.read.schema(TABLES[name][0]).parquet(f"{self.root}/{segment}/{name}")
        if any("blocks" in s["rows"] for s in segments):
            blocks = written.get("postings", self.spark.createDataFrame([], schemas.POSTINGS))
            counted = keyword.bounds(blocks).withColumn("chunk_id", F.lit(None).cast("string"))
            if not first:
                # What was taken back from segments before these ones is still to be taken back.
                back = self._placed("blocks", segments).where("chunk_id IS NOT NULL")
                held = [self.spark.read.schema(schemas.LENGTHS).parquet(f"{self.root}/{s['id']}/lengths").select("chunk_id", F.lit(i).alias("from_")) for i, s in enumerate(segments) if "lengths" in s["rows"]]
                since = reduce(DataFrame.unionAll, held).groupBy("chunk_id").agg(F.min("from_").alias("from_"))
                counted = counted.unionByName(back.join(since, "chunk_id", "left").where(F.col("from_").isNull() | (F.col("from_") >= F.col("at_"))).drop("from_", "at_"))
            self._write("blocks", counted, segment)
            names = sorted([*names, "blocks"])
        hidden: dict[str, list[str]] = {}
        for s in () if first else segments:
            for name, at in s["hidden"].items():
                hidden[name] = hidden.get(name, []) + at
        return {"id": segment, "bytes": self._bytes(segment), "rows": names, "hidden": hidden}

    def _due(self, segments: list[dict]) -> tuple[int, int] | None:
        """The newest run of neighbours of one size class that is long enough to be merged: from, to."""
        level = [max(0, math.ceil(math.log(max(s["bytes"], 1) / SMALL, FANOUT))) for s in segments]
        end = len(level)
        while end:
            start = end - 1
            while start and level[start - 1] <= level[end - 1]:
                start -= 1
            if end - start >= FANOUT:
                return start, end
            end = start
        return None

    def merge(self) -> int | None:
        """Merges segments while a run of them is due; the last version if any were."""
        version = None
        while True:
            now = self.current()
            old = self._manifest(now)
            due = self._due(old["segments"])
            if due is None:
                return version
            version = self._replace(now, old, *due)
            if version is None:
                return None  # another writer came first and merges in its turn

    def compact(self) -> int:
        """Merges all segments into one."""
        now = self.current()
        old = self._manifest(now)
        version = self._replace(now, old, 0, len(old["segments"]))
        if version is None:
            raise Conflict(f"version {now} of {self.root} is no longer the last")
        return version

    def _replace(self, now: int, old: dict, start: int, end: int) -> int | None:
        one = self._merged(old["segments"][start:end], start == 0)
        after = [*old["segments"][:start], one, *old["segments"][end:]]
        log = [*old["log"], {"version": now + 1, "touched": f"{one['id']}/touched"}][-LOG:]
        self.spark.createDataFrame([], "key_ string").write.parquet(f"{self.root}/{one['id']}/touched")  # a merge changes no document
        return now + 1 if self._publish({"segments": after, "log": log}, now + 1) else None

    def _publish(self, manifest: dict, version: int) -> bool:
        """Whether the manifest became this version; not if another writer's did."""
        fs, new = _files(self.spark, f"{self.root}/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = _files(self.spark, f"{self.root}/{_MANIFEST}{version:012d}")
        if fs.exists(final) or not fs.rename(new, final):
            fs.delete(new, False)
            return False
        return True

    def clean(self, keep: int = 2) -> int:
        """Deletes manifests but the last ``keep``, and segments none of those names; returns how many segments went."""
        fs, at = _files(self.spark, self.root)
        versions = self.versions()
        manifests = {v: self._manifest(v) for v in versions}
        named = lambda m: {s["id"] for s in m["segments"]} | {at.split("/")[0] for s in m["segments"] for keys in s["hidden"].values() for at in keys} | {x["touched"].split("/")[0] for x in m["log"] if x["touched"]}
        wanted = set().union(*(named(manifests[v]) for v in versions[-keep:]))
        gone = set().union(*(named(manifests[v]) for v in versions[:-keep])) - wanted
        kept = {s["id"] for v in versions[-keep:] for s in manifests[v]["segments"]}
        for v in versions[:-keep]:
            fs.delete(_files(self.spark, f"{self.root}/{_MANIFEST}{v:012d}")[1], False)
        for s in gone:
            fs.delete(_files(self.spark, f"{self.root}/{s}")[1], True)
        # Of merged segments only the keys are needed: those they hide, and those they touched.
        for s in wanted - kept:
            for name in TABLES:
                fs.delete(_files(self.spark, f"{self.root}/{s}/{name}")[1], True)
        return len(gone | (wanted - kept))
