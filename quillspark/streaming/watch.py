"""Watching files: events of paths become one action per path and burst, and actions become batches of the index.

A path's events belong together while no more than ``gap`` passes from one to the next; a burst is flushed once the watermark is
past its quiet time. One deletion in a burst makes it a deletion. The same expression serves tables and streams, so a stream
gives what the table gives, whatever the order of arrival within the watermark's delay; events that repeat an id count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.indexing import index_files
from ..sources.corpus import glob_regex
from ..sources.versions import Store

#: Kinds of events; the quiet time before a flush.
INDEXING, REMOVING, MOVING = ["created", "modified"], "deleted", "moved"
QUIET = "2 seconds"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that fits a path leaves it out; ``!`` takes it back in."""
    out = F.lit(False)
    for pattern in patterns:
        out = F.when(path.rlike(glob_regex(pattern.removeprefix("!"))), F.lit(not pattern.startswith("!"))).otherwise(out)
    return out


def path_actions(events: DataFrame, extensions: list[str], ignore: list[str] = ()) -> DataFrame:
    """(event_id, created_at, path, remove): a move removes its source and indexes its destination.

    Only paths with these extensions count; ignored ones can still be removed. Directories and other kinds are left out.
    """
    index, gone = F.col("kind").isin(INDEXING), F.col("kind") == REMOVING
    one = lambda path, remove: F.struct(path.alias("path"), F.lit(remove).alias("remove"))
    acts = F.when(index, F.array(one(F.col("path"), False))).when(gone, F.array(one(F.col("path"), True))).when(F.col("kind") == MOVING, F.array(one(F.col("path"), True), one(F.col("dest"), False)))
    rows = events.filter("path IS NOT NULL AND NOT is_directory").select("event_id", "created_at", F.explode(acts).alias("act")).select("event_id", "created_at", T.normalised_path(F.col("act.path")).alias("path"), "act.remove")
    rows = rows.filter(F.col("path").isNotNull() & T.extension_of(F.col("path")).isin([x.lower() for x in extensions]))
    return rows.filter(F.col("remove") | ~ignored(F.col("path"), list(ignore))) if ignore else rows


def flushed(actions: DataFrame, gap: str = QUIET, delay: str = "10 seconds") -> DataFrame:
    """(path, action, first_at, last_at, n_events) of every burst; of a stream those whose quiet time has passed."""
    if actions.isStreaming:
        actions = actions.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id", "path"])
    else:
        actions = actions.dropDuplicates(["event_id", "path"])
    rows = actions.groupBy(F.session_window("created_at", gap), "path").agg(F.max("remove").alias("remove"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n_events"))
    return rows.select("path", F.when(F.col("remove"), "delete").otherwise("index").alias("action"), "first_at", "last_at", "n_events")


def apply_batch(store: Store, load: Callable[[DataFrame], DataFrame], file_id: Column, **limits) -> Callable[[DataFrame, int], None]:
    """What indexes and removes a batch of flushed actions; of several bursts of a path the last decides.

    ``load`` turns (file_id, path) into scanned files; a path that is no longer there is removed. A batch that is replayed
    after a failure finds its work done.
    """

    def apply(batch: DataFrame, _epoch: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("action", "last_at").alias("action")).withColumn("file_id", file_id)
        # the batch is a read of stored state, and is used three times
        last = last.persist()
        try:
            scanned = load(last.filter("action = 'index'").select("file_id", "path")).persist()
            missing = last.filter("action = 'index'").join(scanned.select("file_id"), "file_id", "left_anti")
            index_files(store, scanned, last.filter("action = 'delete'").select("file_id").union(missing.select("file_id")), **limits)
            scanned.unpersist()
        finally:
            last.unpersist()

    return apply


def watch(events: DataFrame, store: Store, load: Callable[[DataFrame], DataFrame], file_id: Column, checkpoint: str, extensions: list[str], ignore: list[str] = (), gap: str = QUIET, delay: str = "10 seconds", **limits) -> StreamingQuery:
    """Keep the store up to date with a stream of (event_id, created_at, kind, path, dest, is_directory), as far as it goes."""
    rows = flushed(path_actions(events, extensions, ignore), gap, delay)
    query = rows.writeStream.foreachBatch(apply_batch(store, load, file_id, **limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
