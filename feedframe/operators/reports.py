"""Reports on runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedframe.functions.scalars import result_category
from feedframe.operators.filters import dated_posts, run_rules
from feedframe.operators.joins import handle_user_ids
from feedframe.sources.responses import filter_api_responses


def target_of(query):
    """What a run was about: handle, else shortcode, else keyword."""
    return F.coalesce(*[F.nullif(query[k], F.lit("")) for k in ("handle", "shortcode", "keyword")])


def _counted(children: DataFrame, name: str) -> DataFrame:
    return children.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))


def run_summary(runs: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """Per run: target, result, numbers of posts and users, duration. Zeros stay."""
    return (
        runs.select("run_id", target_of(F.col("query")).alias("target"), "result", "time_taken")
        .join(_counted(posts, "post_count"), "run_id", "left")
        .join(_counted(users, "user_count"), "run_id", "left")
        .fillna(0, ["post_count", "user_count"])
    )


def response_counts(pages: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """API responses per run, unreadable bodies included.

    With ``runs``, or else among all runs in ``pages``, those without any count 0.
    """
    counts = filter_api_responses(pages).groupBy("run_id").agg(F.count(F.lit(1)).alias("response_count"))
    every = (pages if runs is None else runs).select("run_id").distinct()
    return (
        every.join(counts, "run_id", "left")
        .fillna(0, ["response_count"])
        .withColumn("has_activity", F.col("response_count") > 0)
    )


def runs_by_category(runs: DataFrame) -> DataFrame:
    return runs.groupBy(result_category(F.col("result")).alias("category")).agg(
        F.count(F.lit(1)).alias("runs")
    )


def to_recollect(requests: DataFrame, runs: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a run that ended well or at least partly."""
    done = runs.where(result_category(F.col("result")).isin("success", "partial", "unknown"))
    return requests.join(done.select(key), key, "left_anti")


def author_filter_alarm(runs: DataFrame, posts: DataFrame, users: DataFrame, tz: str = "UTC") -> DataFrame:
    """Timelines whose author filter dropped every dated post while no id was known."""
    known = handle_user_ids(runs, users).select("run_id")
    rules = run_rules(runs, tz).where(F.col("_mode") == "filter").join(known, "run_id", "left_anti")
    return (
        dated_posts(rules, posts)
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("dropped"), F.count_if("_direct").alias("_kept"))
        .where(F.col("_kept") == 0)
        .drop("_kept")
    )
