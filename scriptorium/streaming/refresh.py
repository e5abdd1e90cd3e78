"""Incremental refresh: a stream of listing rows, one index run for each micro-batch.

The store is the state: a micro-batch holds the notes that changed, so nothing it lacks is deleted. Rows marked ``deleted`` delete their note,
and the store remembers when; full listings through ``plans.engine.index`` delete what they lack. Of all rows of a note, within a batch and over batches, the one of the
latest (mtime, rev) counts: an older revision that comes late changes nothing, nor does it bring back a deleted note. Re-running a batch after a failure
finds its notes unchanged, which makes the sink idempotent. If another writer changes one of a batch's notes meanwhile, the batch is judged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import scratch
from ..plans import engine
from ..schemas import CHANGE
from ..settings import Settings
from ..sources.store import Conflict, Store


def read_notes(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files).json(path)


#: Times a batch is judged again after another writer came first.
ATTEMPTS = 5


def latest(batch: DataFrame, store: Store, version: int | None) -> DataFrame:
    """(doc_id, path, rev, mtime, markdown, deleted): the last row of each note, where it is not older than what the store knows of it."""
    rows = batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("path", "rev", "mtime", "markdown", F.coalesce("deleted", F.lit(False)).alias("deleted")), F.struct("mtime", "rev")).alias("n")).select("doc_id", "n.*")
    stamp = lambda t: store.read(t, version).select("doc_id", F.struct("mtime", "rev").alias("at"))
    known = stamp("docs").union(stamp("gone")).join(last.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("at").alias("known"))
    return last.join(known, "doc_id", "left").where(F.col("known").isNull() | (F.struct("mtime", "rev") >= F.col("known"))).drop("known")


def merge_batch(store: Store, batch: DataFrame, settings: Settings) -> None:
    """Applies one micro-batch of changed and deleted notes."""
    for attempt in range(ATTEMPTS):
        rows = scratch.write(latest(batch, store, store.current()))
        try:
            removed = rows.where("deleted").select("doc_id", "mtime", "rev")
            engine.index(store, rows.where("NOT deleted").drop("deleted"), settings, full=False, removed=removed, allow_mass_delete=True)
            return
        except Conflict:
            if attempt + 1 == ATTEMPTS:
                raise


def refresh(notes: DataFrame, store: Store, checkpoint: str, settings: Settings | None = None, every: str | None = None) -> StreamingQuery:
    """Starts the refresh: every ``every`` (such as '1 hour'), or once over all that is there."""
    chosen = settings or Settings()
    writer = notes.writeStream.foreachBatch(lambda df, _: merge_batch(store, df, chosen)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts of an events stream, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
