"""Incremental graph updates from a stream of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.functions.rules import IGNORED
from tracewarden.operators import build, extract
from tracewarden.schema import CHANGES
from tracewarden.sources.repository import inside_tree
from tracewarden.sources.shared import written
from tracewarden.sources.store import FactStore


def read_changes(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of change rows from JSON files below ``path``, at most ``per_trigger`` files a batch."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", per_trigger).json(path)


def supported(changes: DataFrame) -> DataFrame:
    """Changes of files in a known language outside ignored folders."""
    return changes.filter(F.col("language").isin("python", "typescript", "javascript", "go") & inside_tree(F.col("path"), IGNORED))


def debounced(changes: DataFrame, quiet: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of changes of a path: its last state, once the path was quiet.

    Sessions by event time; a session is emitted when the watermark has passed its end, so the newest burst waits
    for a later event.
    """
    sessions = changes.withWatermark("event_time", late).groupBy("path", F.session_window("event_time", quiet).alias("session"))
    last = sessions.agg(F.max_by(F.struct("language", "is_delete", "content"), "event_time").alias("c"), F.max("event_time").alias("event_time"))
    return last.select("path", "c.language", "c.is_delete", "c.content", "event_time")


def bursts(changes: DataFrame, quiet: float, order: str = "is_delete") -> DataFrame:
    """The same over a table: (path, burst, the last row's columns, n), bursts numbered from 1 within a path, a new one after more than
    ``quiet`` seconds. ``order`` decides between rows of one time."""
    by_path = Window.partitionBy("path").orderBy("event_time", order)
    at = F.col("event_time").cast("double")
    numbered = changes.withColumn("fresh", F.coalesce(at - F.lag(at).over(by_path) > quiet, F.lit(True)).cast("long"))
    numbered = numbered.withColumn("burst", F.sum("fresh").over(by_path)).drop("fresh")
    rest = [c for c in changes.columns if c != "path"]
    last = numbered.groupBy("path", "burst").agg(F.max_by(F.struct(*rest), F.struct("event_time", order)).alias("c"), F.count(F.lit(1)).alias("n"))
    return last.select("path", "burst", "c.*", "n")


def apply_changes(store: FactStore, changes: DataFrame) -> int | None:
    """Apply a batch of changes to the store: the last one of each path counts; deleted files go, files whose content
    has changed are extracted again, others are skipped. Applying a batch twice gives the same graph. None for a batch without changes."""
    last = written(build.latest(supported(changes)), "changes")
    files = extract.source_files(last.filter(~F.coalesce("is_delete", F.lit(False))).select("path", "content"))
    known = store.table("files").select(F.col("file_path").alias("path"), "hash")
    fresh = written(files.join(known, ["path", "hash"], "left_anti"), "files")
    gone = last.filter(F.coalesce("is_delete", F.lit(False))).select("path").unionByName(fresh.select("path"))
    if gone.isEmpty():
        return None
    events = written(extract.syntax_events(fresh), "events")
    parsed, functions, calls = extract.facts(events)
    return store.replace(gone.select(F.col("path").alias("file_path")), {"files": fresh.select(F.col("path").alias("file_path"), "hash"), "parsed": parsed, "functions": functions, "calls": calls})


def start(changes: DataFrame, store: FactStore, checkpoint: str, available_now: bool = False):
    """Run the stream into the store; a restart from the checkpoint repeats at most the last batch."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_changes(store, batch) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
