"""Responses as a stream: the batch operators over arriving pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedframe.functions.posts import with_post_id
from feedframe.operators.filters import is_rate_limited
from feedframe.operators.routing import route_posts, route_users
from feedframe.schemas import PAGE_SCHEMA
from feedframe.sources.responses import parse_responses, payload_rows


def stream_pages(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    schema: StructType | str = PAGE_SCHEMA,
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Response pages from files as they arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def stream_posts(pages: DataFrame) -> DataFrame:
    """Post nodes of arriving pages, none of throttled ones. Keeps no state."""
    parsed = parse_responses(pages)
    return route_posts(payload_rows(parsed.where(~is_rate_limited(F.col("errors")))))


def stream_users(pages: DataFrame) -> DataFrame:
    """User records of arriving pages. Keeps no state."""
    return route_users(payload_rows(parse_responses(pages)))


def stream_dedup(
    posts: DataFrame, event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """Each post id of a run once, over the whole stream; posts without id all pass.

    State grows with the distinct ids. ``event_time`` and ``delay`` bound it: ids are
    then forgotten once the watermark has passed, and a later copy would come through.
    """
    # A post without id gets a key of its own: where it stands.
    place = F.concat_ws("/", F.lit("\0"), "page_seq", "payload_idx", "pos")
    keyed = with_post_id(posts).withColumn("_key", F.coalesce("post_id", place))
    if event_time and delay:
        unique = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["run_id", "_key"])
    else:
        unique = keyed.dropDuplicates(["run_id", "_key"])
    return unique.drop("_key")
