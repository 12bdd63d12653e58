"""Filters over posts and the clean-up of finished runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import EMPTY_TIMELINE_CODES, RATE_LIMIT_PHRASES
from feedframe.functions.json import to_long
from feedframe.functions.once import computed
from feedframe.functions.posts import author_matches, author_missing, owner_ids, resolved_raw
from feedframe.functions.scalars import result_category
from feedframe.operators.joins import handle_user_ids
from feedframe.schemas import POST_AUTHOR_SCHEMA


def day_start(date: Column, tz: str = "UTC") -> Column:
    """Unix seconds at which a calendar day begins in a zone."""
    midnight = F.unix_date(date.cast("date")).cast("bigint") * 86400
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(midnight), tz))


def within_dates(taken_at: Column, start: Column, end: Column, tz: str = "UTC") -> Column:
    """Whether Unix seconds lie in whole days ``start`` .. ``end``, both included."""
    after = F.date_add(end.cast("date"), 1)
    return (taken_at >= day_start(start, tz)) & (taken_at < day_start(after, tz))


def between_dates(
    posts: DataFrame, start: str, end: str, tz: str = "UTC", taken_at: Column | None = None
) -> DataFrame:
    """Posts taken on the days ``start`` .. ``end``. Posts without ``taken_at`` go.

    Reads ``taken_at`` out of ``raw`` unless the column is given; given a stored column,
    the range reaches the Parquet scan.
    """
    if taken_at is not None:
        return posts.where(within_dates(taken_at, F.lit(start), F.lit(end), tz))
    own = to_long(F.from_json("raw", "taken_at STRING")["taken_at"])
    dated = computed(posts, _taken=own).where(within_dates(F.col("_taken"), F.lit(start), F.lit(end), tz))
    return dated.drop("_taken")


def _owned(posts: DataFrame, ids: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Keep rows with ``_direct`` set, or one of whose ``_owners`` is a known id.

    Ids meet posts by joins on the id, one for each of the two owner fields, so neither
    the ids of a run nor its posts are gathered anywhere. The second join concerns only
    posts whose two owner ids differ.
    """
    for n in (0, 1):
        known = ids.select(*[F.col(c).alias(f"_{c}{n}") for c in (*on, "user_id")], F.lit(True).alias(f"_hit{n}"))
        # Rows with nothing to look up get keys that match no id and spread over tasks.
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("raw"), F.lit(4096)).cast("string"))
        owner = F.coalesce(F.when(~F.col("_direct"), F.get("_owners", F.lit(n))), spread)
        match = owner == F.col(f"_user_id{n}")
        for c in on:
            match = match & (F.col(c) == F.col(f"_{c}{n}"))
        posts = posts.join(known, match, "left").drop(*[f"_{c}{n}" for c in (*on, "user_id")])
    hit = F.coalesce(F.col("_hit0"), F.col("_hit1"), F.lit(False))
    return posts.where(F.col("_direct") | hit).drop("_hit0", "_hit1", "_direct", "_owners", "_taken")


def _with_author(posts: DataFrame, handle: Column) -> DataFrame:
    author = F.col("_author")
    return computed(
        posts.withColumn("_author", F.from_json("raw", POST_AUTHOR_SCHEMA)),
        _taken=to_long(author["taken_at"]),
        _direct=author_matches(author, handle),
        _owners=F.when(author_missing(author), owner_ids(author["owner_id"])),
    ).drop("_author")


def by_author(posts: DataFrame, handle: str | Column, user_ids=None) -> DataFrame:
    """Posts of one handle: by author, by coauthor, or by id where no author is named.

    ``user_ids`` is a DataFrame with distinct values in ``user_id``, or a short list.
    """
    if isinstance(handle, str):
        handle = F.lit(handle)
    keyed = _with_author(posts, handle)
    if isinstance(user_ids, DataFrame):
        return _owned(keyed, user_ids.select("user_id").distinct(), ())
    ids = F.array(*[F.lit(str(u)) for u in user_ids or ()]).cast("array<string>")
    owned = F.coalesce(F.arrays_overlap("_owners", ids), F.lit(False))
    return keyed.where(F.col("_direct") | owned).drop("_direct", "_owners", "_taken")


def is_rate_limited(errors: Column) -> Column:
    """Whether any error message speaks of throttling. Never null."""

    def throttled(e: Column) -> Column:
        message = F.lower(F.coalesce(e["message"], F.lit("")))
        return reduce(Column.__or__, [message.contains(p) for p in RATE_LIMIT_PHRASES])

    return F.coalesce(F.exists(errors, throttled), F.lit(False))


def timeline_to_filter(endpoint: Column, result: Column) -> Column:
    """Whether the posts of a run are to be filtered by date and author."""
    return (
        (endpoint == "UserTimeline")
        & (result_category(result) == "success")
        & ~result.isin(*EMPTY_TIMELINE_CODES)
    )


def run_rules(runs: DataFrame, tz: str = "UTC") -> DataFrame:
    """What clean-up does to the posts of each run, and its parameters."""
    query = F.col("query")
    mode = F.when(timeline_to_filter(F.col("endpoint"), F.col("result")), "filter").when(
        (F.col("endpoint") == "Search") & (result_category(F.col("result")) == "success"), "resolve"
    )
    return runs.select(
        "run_id",
        F.coalesce(mode, F.lit("keep")).alias("_mode"),
        query["handle"].alias("_handle"),
        day_start(query["start_date"].try_cast("date"), tz).alias("_from"),
        day_start(F.date_add(query["end_date"].try_cast("date"), 1), tz).alias("_until"),
    )


def dated_posts(rules: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts of runs, resolved and cut to the dates of their run where its rule says so.

    Adds ``_mode``, ``_direct`` (author or coauthor matches) and ``_owners``.
    """
    joined = posts.join(rules, "run_id")
    raw = F.when(F.col("_mode") == "keep", F.col("raw")).otherwise(resolved_raw(F.col("raw")))
    keyed = _with_author(computed(joined, raw=raw).where(F.col("raw").isNotNull()), F.col("_handle"))
    in_dates = (F.col("_taken") >= F.col("_from")) & (F.col("_taken") < F.col("_until"))
    return keyed.where((F.col("_mode") != "filter") | F.coalesce(in_dates, F.lit(False)))


def postprocess(runs: DataFrame, posts: DataFrame, users: DataFrame, tz: str = "UTC") -> DataFrame:
    """Posts of all runs after clean-up, in one job.

    Successful timelines: media resolved, then filtered by the run's dates and handle.
    Successful searches: media resolved. Every other run keeps its posts as they are.

    Posts are read once, and only those with something to look up meet the ids, by joins
    on the id: no run's ids or posts are gathered anywhere.
    """
    ids = handle_user_ids(runs, users)
    keyed = dated_posts(run_rules(runs, tz), posts).withColumn("_direct", (F.col("_mode") != "filter") | F.col("_direct"))
    return _owned(keyed, ids, ("run_id",)).select(*posts.columns)
