"""End-to-end plans: from stored responses or files to clean tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import (
    HOME_FEED_KEY,
    LOGGED_OUT,
    NO_POSTS,
    SEARCH_KEY,
    SUCCESS,
    TEXT_UNAVAILABLE,
    TIMEOUT,
    UNAVAILABLE,
    USER_FEED_KEY,
)
from feedframe.functions.json import child
from feedframe.functions.scalars import page_text_state
from feedframe.operators.dedup import dedup_posts
from feedframe.operators.filters import day_start, is_rate_limited, postprocess
from feedframe.operators.joins import private_runs, typed_users
from feedframe.operators.paging import (
    cursor_kind,
    end_rules,
    first_stops,
    page_facts,
    page_info,
    page_state,
    page_stats,
    truncate_at_stop,
    v1_page_info,
    with_page_stats,
    with_stop_code,
)
from feedframe.operators.routing import node_rows, route_posts, with_nodes
from feedframe.session import materialize, size_by_rows
from feedframe.sources.responses import filter_api_responses, parse_responses, payload_rows

Cursors = Callable[[DataFrame], DataFrame]


class Collected(NamedTuple):
    """Tables of runs rebuilt from their response log."""

    runs: DataFrame
    posts: DataFrame
    users: DataFrame
    pages: DataFrame


def new_posts_of(parsed: DataFrame) -> DataFrame:
    """First arrivals of posts, without those of throttled pages."""
    usable = parsed.where(~is_rate_limited(F.col("errors")))
    return dedup_posts(route_posts(payload_rows(usable)))


# What a stored page says about itself, beside its facts, for telling paging from visits.
_FLAGS = ("timeline_feed", "search_feed", "failed", "single", "rate_limited")


def _with_flags(parsed: DataFrame) -> DataFrame:
    def any_has(*keys: str) -> Column:
        return F.exists("payloads", lambda p: F.coalesce(*[child(p, f"$.{k}") for k in keys]).isNotNull())

    silent = F.size("payloads") == 0
    transport = F.col("transport_error").isNotNull() if "transport_error" in parsed.columns else F.lit(False)
    return (
        parsed.withColumn("timeline_feed", any_has(HOME_FEED_KEY, USER_FEED_KEY))
        .withColumn("search_feed", any_has(SEARCH_KEY))
        .withColumn("failed", silent & ((F.size("errors") > 0) | transport))
    )


def is_paging(endpoint: Column, told: Column | None = None) -> Column:
    """Whether a response of a run continues its paging; every other one belongs to a visit.

    A timeline pages through responses that answer a feed, a search through those that
    answer a search, also with nothing in them; a response that is only an error counts
    as a failed page of either. Other endpoints do not page. A log that knows better says
    so in a boolean column ``paging`` of its own (``told``).
    """
    own = F.when(endpoint == "UserTimeline", F.col("timeline_feed")).when(endpoint == "Search", F.col("search_feed"))
    by_content = F.coalesce(own | F.col("failed"), F.lit(False))
    paged = F.coalesce(endpoint.isin("UserTimeline", "Search"), F.lit(False))
    return paged & (by_content if told is None else F.coalesce(told, by_content))


def _asked(requests: DataFrame, tz: str, caps: dict) -> DataFrame:
    """A row per run: its endpoint and what ends it. Endpoints that do not page have no limits."""
    query = F.col("query")
    runs = requests.select(
        "run_id",
        "endpoint",
        day_start(query["start_date"].try_cast("date"), tz).alias("start_unix"),
        F.when(F.col("endpoint") == "Search", query["max_posts"].try_cast("bigint")).alias("_max_posts"),
        *([cursor_kind(F.col("variables"), F.col("form")).alias("cursor_kind")] if _names_cursors(requests) else []),
    )
    limited = runs.join(end_rules(requests.sparkSession, **caps), "endpoint", "left")
    return limited.withColumn("post_cap", F.coalesce("_max_posts", "post_cap")).drop("_max_posts")


def _names_cursors(requests: DataFrame) -> bool:
    return {"variables", "form"} <= set(requests.columns)


def _both_cursors(parsed: DataFrame) -> DataFrame:
    """GraphQL cursors, and those of v1 pages beside them."""
    v1 = v1_page_info(parsed).withColumnRenamed("end_cursor", "v1_cursor").withColumnRenamed("has_next_page", "v1_more")
    return page_info(v1)


def _results(requests: DataFrame, states: DataFrame, stops: DataFrame, posts: DataFrame, users: DataFrame, visits: DataFrame | None) -> DataFrame:
    """``run_id, result, gated``: how each run ended, and whether before any paging."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))

    ended = (
        requests.select("run_id", "endpoint")
        .join(counted(states, "n_pages"), "run_id", "left")
        .join(counted(posts, "n_posts"), "run_id", "left")
        .join(counted(users, "n_users"), "run_id", "left")
        .join(stops.select("run_id", "stop_code"), "run_id", "left")
        .join(private_runs(requests, typed_users(users)).select("run_id", F.lit(True).alias("private")).distinct(), "run_id", "left")
    )
    if visits is None:
        ended = ended.withColumn("text", F.lit(None).cast("string")).withColumn("on_target", F.lit(None).cast("boolean"))
    else:
        seen = visits.groupBy("run_id").agg(F.min(F.struct("on_target", "text")).alias("seen"))
        ended = ended.join(seen.select("run_id", "seen.*"), "run_id", "left")
    endpoint, paged = F.col("endpoint"), F.col("n_pages").isNotNull()
    off_target = ~F.coalesce("on_target", F.lit(True))
    unavailable = F.coalesce(F.contains("text", F.lit(TEXT_UNAVAILABLE)), F.lit(False))
    # Gates come before paging, in this order; a run that they end has no pages.
    gate = (
        F.when(endpoint.isin("UserProfile", "Search") & off_target, LOGGED_OUT)
        .when((endpoint == "UserProfile") & unavailable, UNAVAILABLE)
        .otherwise(page_text_state(F.col("text"), endpoint, F.col("on_target"), F.col("private"), paged))
    )
    rest = (
        F.when(endpoint.isin("UserTimeline", "Search") & paged, F.col("stop_code"))
        .when(endpoint == "UserTimeline", TIMEOUT)
        .when(endpoint == "Search", NO_POSTS)
        .when(endpoint == "PostByShortcode", F.when(F.col("n_posts") > 0, SUCCESS).otherwise(TIMEOUT))
        .when(endpoint.isin("UserProfile", "Chaining"), F.when(F.col("n_users") > 0, SUCCESS).otherwise(TIMEOUT))
    )
    return ended.withColumn("_gate", gate).select("run_id", F.coalesce("_gate", rest).alias("result"), F.col("_gate").isNotNull().alias("gated"))


def rebuild_runs(
    pages: DataFrame,
    requests: DataFrame,
    tz: str = "UTC",
    visits: DataFrame | None = None,
    rules: dict[str, list[tuple[str, Column]]] | None = None,
    cursors: Cursors | None = None,
    **caps,
) -> Collected:
    """Rebuild runs of all endpoints from a response log: result, cleaned posts, users, pages.

    ``pages`` is the log (see ``PAGE_SCHEMA``); an optional boolean ``paging`` says which
    responses continue a paging, otherwise ``is_paging`` decides. All others are a visit's:
    their posts and users count, if the body is one JSON value, and they have no page state.
    ``requests`` has a row per run: ``run_id, endpoint, query``; with maps ``variables`` and
    ``form`` of the first paging request beside it, runs that page by ``max_id`` get the
    cursors of that kind. ``visits`` has the text of a run's visited page: ``run_id, text,
    on_target`` (one row per run), for the states that end a run before its paging.

    ``rules`` replaces the stop rules of an endpoint, ``cursors`` the way cursors are read
    (any function that adds ``end_cursor`` and ``has_next_page`` to parsed pages); ``caps``
    are limits for ``end_rules``; a search stops at its query's ``max_posts``.

    A run's ``result`` is null where its log ends before a rule does. Each body is parsed
    once, into a stored table; no later step moves a body.
    """
    size_by_rows(requests.sparkSession)
    asked = materialize(_asked(requests, tz, caps), "asked")
    kinds = "cursor_kind" in asked.columns and cursors is None
    read = cursors or (_both_cursors if kinds else page_info)
    told = ("paging",) if "paging" in pages.columns else ()
    parsed = _with_flags(with_nodes(parse_responses(filter_api_responses(pages))))
    carry = ("posts", "users", "timeline_feed", "search_feed", "failed", "single", *told, *(("v1_cursor", "v1_more") if kinds else ()))
    stored = materialize(page_facts(parsed.drop("endpoint", "start_unix"), carry=carry, cursors=read), "pages")

    paging = is_paging(F.col("endpoint"), F.col("paging") if told else None)
    usable = F.when(F.col("paging"), ~F.col("rate_limited")).otherwise(F.col("single"))

    def rows_of(field: str) -> DataFrame:
        found = node_rows(stored, field, *_FLAGS, *told).join(asked.select("run_id", "endpoint"), "run_id")
        return found.withColumn("paging", paging).where(usable).drop("endpoint", *_FLAGS)

    arrived = materialize(dedup_posts(rows_of("posts")), "posts")
    met = materialize(rows_of("users"), "users")
    facts = stored.drop("posts", "users").join(asked, "run_id").withColumn("paging", paging)
    if kinds:
        v1 = F.col("cursor_kind") == "v1_max_id"
        facts = facts.withColumn("end_cursor", F.when(v1, F.col("v1_cursor")).otherwise(F.col("end_cursor")))
        facts = facts.withColumn("has_next_page", F.when(v1, F.col("v1_more")).otherwise(F.col("has_next_page")))
        facts = facts.drop("v1_cursor", "v1_more", "cursor_kind")
    counted = with_page_stats(facts.drop("timeline_feed", "search_feed", "failed", "single"), page_stats(arrived))
    states = with_stop_code(page_state(counted), rules).drop("by_date", "by_shape", "no_progress_limit", "post_cap", "page_cap")
    states = materialize(states, "page-states")
    stops = first_stops(states)

    def before_stop(rows: DataFrame) -> DataFrame:
        joined = rows.join(stops.select("run_id", "stop_seq"), "run_id", "left")
        return joined.where(F.col("stop_seq").isNull() | (F.col("page_seq") <= F.col("stop_seq"))).drop("stop_seq")

    posts, users = before_stop(arrived), before_stop(met)
    results = materialize(_results(requests, states, stops, posts, users, visits), "results")
    gated = results.where("gated").select("run_id")
    runs = requests.join(results.select("run_id", "result"), "run_id", "left")
    kept = truncate_at_stop(states).join(gated, "run_id", "left_anti")

    def without_gated_pages(rows: DataFrame) -> DataFrame:
        flagged = rows.join(gated.withColumn("_gated", F.lit(True)), "run_id", "left")
        return flagged.where(~(F.col("paging") & F.col("_gated").isNotNull())).drop("paging", "_gated")

    posts, users = without_gated_pages(posts), without_gated_pages(users)
    return Collected(runs, postprocess(runs, posts, typed_users(users), tz), users, kept)
