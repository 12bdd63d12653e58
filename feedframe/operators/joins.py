"""Lookups between runs, users and posts, as joins.

None of them hints a broadcast: the optimizer broadcasts a side whose size it knows to be
small, and adaptive execution splits skewed shuffle joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedframe.functions.once import computed
from feedframe.functions.posts import with_post_id
from feedframe.schemas import USER_SCHEMA


def typed_users(users: DataFrame) -> DataFrame:
    """Rows of ``raw`` user records with their fields as columns."""
    kept = [c for c in users.columns if c != "raw"]
    return computed(users, _u=F.from_json("raw", USER_SCHEMA)).select(*kept, "_u.*")


def _handle_rows(runs: DataFrame, users: DataFrame) -> DataFrame:
    """User records of each run that belong to the run's own handle."""
    handles = runs.select("run_id", F.lower(F.col("query")["handle"]).alias("_handle")).where(
        F.col("_handle").isNotNull()
    )
    named = users.withColumn("_handle", F.lower("username"))
    return named.join(handles, ["run_id", "_handle"])


def handle_user_ids(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct ``(run_id, user_id)`` of the records that carry the run's handle."""
    ids = F.array_distinct(F.array_compact(F.array("id", "pk")))
    return (
        _handle_rows(runs, users).select("run_id", F.explode(ids).alias("user_id")).distinct()
    )


def private_runs(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Runs for which a record of the handle says it is private."""
    private = users.where(F.col("is_private")).select(
        "run_id", F.lower("username").alias("_handle")
    )
    handle = F.lower(F.col("query")["handle"])
    return runs.withColumn("_handle", handle).join(private, ["run_id", "_handle"], "left_semi").select(*runs.columns)


def new_posts(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Posts of a batch whose id is not among ``seen`` (``run_id, post_id``) of the run.

    Posts without an id are always new.
    """
    keyed = with_post_id(batch)
    return keyed.join(seen.select("run_id", "post_id"), ["run_id", "post_id"], "left_anti").select(*batch.columns)


def recommended_edges(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Edges from the handle of each ``Chaining`` run to the users its responses list.

    Users that still carry the ``route`` they came by count only when it is ``chaining``,
    so that the seed's own profile record makes no edge.
    """
    if "route" in users.columns:
        users = users.where(F.col("route") == "chaining")
    seeds = runs.where(F.col("endpoint") == "Chaining").select(
        "run_id", F.col("query")["handle"].alias("seed_handle")
    )
    return seeds.join(users, "run_id").select(
        "run_id",
        "seed_handle",
        F.col("username").alias("recommended_handle"),
        F.coalesce("pk", "id").alias("recommended_id"),
    )
