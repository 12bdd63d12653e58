"""First arrival wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedframe.functions.posts import with_post_id

ARRIVAL = ("page_seq", "payload_idx", "pos")


def first_by(df: DataFrame, keys: list[Column], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before the
    shuffle (a group limit below the window), so a key with many copies stays small."""
    # Rows are sorted by a number first, which settles nearly all comparisons.
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def dedup_posts(
    posts: DataFrame, order: tuple[str, ...] = ARRIVAL, run: tuple[str, ...] = ("run_id",)
) -> DataFrame:
    """First arrival of each post id within a run, with its ``post_id``.

    Posts without an id all stay: their place in the order stands in for the id.
    """
    keyed = with_post_id(posts)
    alone = F.when(F.col("post_id").isNull(), F.struct(*order))
    keys = [*[F.col(c) for c in run], F.col("post_id"), F.col("_alone")]
    return first_by(keyed.withColumn("_alone", alone), keys, order).drop("_alone")


def dedup_profile_pics(pics: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """First picture of each handle."""
    return first_by(pics, [F.col("handle")], order)
