"""What happens to each batch of new posts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedframe.operators.assets import video_plan
from feedframe.operators.flatten import resolve_media
from feedframe.sinks.tables import append_jsonl

log = logging.getLogger("feedframe")

BatchSink = Callable[[DataFrame, int], None]


def jsonl_sink(path: str) -> BatchSink:
    """Append the raw posts of each batch. Every batch has its own folder, so the output
    is valid after each one and a repeated batch replaces itself.

    Batches are numbered per checkpoint: a query with a new checkpoint needs a new path.
    """
    return lambda batch, batch_id: append_jsonl(batch.select("raw"), path, batch_id)


def video_plan_sink(path: str, merge: bool = False) -> BatchSink:
    """Append the videos that each batch would fetch."""
    return lambda batch, batch_id: append_jsonl(video_plan(resolve_media(batch), merge), path, batch_id)


def on_new_posts(callback: BatchSink, on_error: str = "log") -> BatchSink:
    """The caller's own function. What it raises is logged, or raised if asked for."""
    if on_error not in ("log", "raise"):
        raise ValueError(f"Unknown on_error: {on_error}")

    def guarded(batch: DataFrame, batch_id: int) -> None:
        try:
            callback(batch, batch_id)
        except Exception:
            if on_error == "raise":
                raise
            log.warning("new-posts callback failed on batch %s", batch_id, exc_info=True)

    return guarded


def fan_out(sinks: Iterable[BatchSink | None]) -> BatchSink | None:
    """One function that runs several sinks in order; None when there is none.

    A batch without posts reaches no sink.
    """
    active = [s for s in sinks if s is not None]
    if not active:
        return None

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty():
                return
            for sink in active:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return run


def write_stream(
    posts: DataFrame, sinks: Iterable[BatchSink | None], checkpoint: str, available_now: bool = False
) -> StreamingQuery | None:
    """Start a query that hands each batch of posts to the sinks; None without sinks."""
    batch_sink = fan_out(sinks)
    if batch_sink is None:
        return None
    writer = posts.writeStream.foreachBatch(batch_sink).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
