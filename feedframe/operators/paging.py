"""Cursor paging over a stored response log: page cursors, page states, stop rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import (
    END_OF_FEED,
    MAX_PAGES,
    NO_PROGRESS_LIMIT,
    PAGE_CAPS,
    REACHED_START,
    RELOAD,
    SHAPE_ERROR,
    SUCCESS,
)
from feedframe.functions.once import computed
from feedframe.functions.json import child, counts, has_value, text_at
from feedframe.functions.posts import time_of
from feedframe.functions.walk import last_branch_first, shallowest
from feedframe.operators.filters import is_rate_limited
from feedframe.operators.routing import has_post_connection
from feedframe.operators.running import running
from feedframe.schemas import POST_TIME_SCHEMA
from feedframe.sources.responses import error_text, payload_nodes

# ---- cursors ---------------------------------------------------------------
def _is_page_info(info: Column) -> Column:
    # By path: a map of its values would cast each to one type, and fail on each that is another.
    return child(info, "$.end_cursor").isNotNull() | child(info, "$.has_next_page").isNotNull()


def page_info(parsed: DataFrame) -> DataFrame:
    """Add ``end_cursor, has_next_page`` of the shallowest ``page_info`` of each page.

    A page with one payload that holds its page info at the top, or under exactly one of
    its keys, is settled by path. Others (several payloads, deeper or equal places) are
    searched level by level in the order of the ``body``.
    """
    payload = F.when(F.size("payloads") == 1, F.get("payloads", F.lit(0)))
    # Of what stands under a key only the page info is read, not all of it.
    under = F.transform(
        F.map_values(F.try_variant_get(payload, "$", "map<string,struct<page_info:variant>>")), lambda v: v["page_info"]
    )
    places = computed(parsed, _top=child(payload, "$.page_info"), _under=F.filter(under, _is_page_info))
    known = F.when(_is_page_info(F.col("_top")), F.col("_top")).when(
        F.size("_under") == 1, F.get("_under", F.lit(0))
    )
    # A body without the name, and without an escape that could spell it, has no such key.
    named = F.contains("body", F.lit("page_info")) | F.contains("body", F.lit("\\"))
    unknown = (F.size("payloads") > 0) & F.col("_known").isNull() & named
    searched = computed(computed(places, _known=known), _nodes=F.when(unknown, payload_nodes(F.col("body"))))
    found = shallowest(F.col("_nodes").isNotNull(), F.coalesce("_nodes", F.array()), "$.page_info", _is_page_info)
    settled = computed(searched, _info=F.coalesce("_known", found))
    return (
        settled.withColumn("end_cursor", text_at(F.col("_info"), "$.end_cursor"))
        .withColumn("has_next_page", F.coalesce(counts(child(F.col("_info"), "$.has_next_page")), F.lit(False)))
        .drop("_top", "_under", "_known", "_nodes", "_info")
    )


def deep_first(parsed: DataFrame, *keys: str) -> DataFrame:
    """Add a VARIANT ``deep_<key>`` for each key: its value anywhere in the payloads.

    The last payload comes first, and the last child of each node. Settled by path when
    the last payload has all keys at its top; other rows are searched, for all keys in one
    descent.
    """
    last = F.try_element_at(F.col("payloads"), F.lit(-1))
    tops = computed(parsed, **{f"_top_{k}": child(last, f"$.{k}") for k in keys})
    open_ = (F.size("payloads") > 0) & ~reduce(Column.__and__, [F.col(f"_top_{k}").isNotNull() for k in keys])
    nodes = computed(tops, _nodes=F.when(open_, payload_nodes(F.col("body"))))
    found = computed(nodes, _deep=last_branch_first(F.col("_nodes").isNotNull(), F.coalesce("_nodes", F.array()), *keys))
    for k in keys:
        found = found.withColumn(f"deep_{k}", F.coalesce(F.col(f"_top_{k}"), F.try_parse_json(F.col("_deep")[k])))
    return found.drop("_nodes", "_deep", *[f"_top_{k}" for k in keys])


def v1_page_info(parsed: DataFrame) -> DataFrame:
    """Add ``end_cursor, has_next_page`` of pages that page by ``next_max_id``."""
    cursor, more = F.col("deep_next_max_id"), F.col("deep_more_available")
    return (
        deep_first(parsed, "next_max_id", "more_available")
        .withColumn("end_cursor", text_at(cursor, "$"))
        .withColumn("has_next_page", F.when(has_value(more), counts(more)).otherwise(F.coalesce(counts(cursor), F.lit(False))))
        .drop("deep_next_max_id", "deep_more_available")
    )


def cursor_kind(variables: Column, form: Column) -> Column:
    """``graphql`` or ``v1_max_id``, by what a request carries (two map columns)."""
    has_variables = F.coalesce(F.size(variables), F.lit(0)) > 0
    return F.when(~has_variables & form["max_id"].isNotNull(), "v1_max_id").otherwise("graphql")


# ---- page facts and states -------------------------------------------------
def page_facts(parsed: DataFrame, carry: tuple[str, ...] = (), cursors=None) -> DataFrame:
    """What each page says by itself: cursor, error text, connection, throttling.

    ``parsed`` has ``payloads`` and ``errors``; an optional ``transport_error`` counts
    first. Bodies are not carried on; ``carry`` names further columns that are.
    ``cursors`` adds ``end_cursor`` and ``has_next_page``; it is ``page_info`` unless a
    caller has another way to read them.
    """
    transport = F.col("transport_error") if "transport_error" in parsed.columns else None
    extra = [c for c in ("endpoint", "start_unix") if c in parsed.columns] + list(carry)
    return (cursors or page_info)(parsed).select(
        "run_id",
        "page_seq",
        "cursor_sent",
        *extra,
        "end_cursor",
        "has_next_page",
        error_text(F.col("errors"), transport).alias("error"),
        F.exists("payloads", has_post_connection).alias("connection_present"),
        is_rate_limited(F.col("errors")).alias("rate_limited"),
    )


def page_stats(new: DataFrame) -> DataFrame:
    """Per page: new posts, those with a timestamp, the oldest timestamp among them."""
    read = computed(new.select("run_id", "page_seq", "raw"), _post=F.from_json("raw", POST_TIME_SCHEMA))
    return (
        read.withColumn("_ts", time_of(F.col("_post")))
        .groupBy("run_id", "page_seq")
        .agg(
            F.count(F.lit(1)).alias("new_count"),
            F.count("_ts").alias("timestamped_count"),
            F.min("_ts").alias("oldest_in_batch_unix"),
        )
    )


def with_page_stats(facts: DataFrame, stats: DataFrame) -> DataFrame:
    """Page facts with the counts of their new posts; pages without new posts count 0."""
    return facts.join(stats, ["run_id", "page_seq"], "left").fillna(0, ["new_count", "timestamped_count"])


def page_state(pages: DataFrame) -> DataFrame:
    """State after each page, as the stop rules see it.

    Needs ``new_count`` and ``end_cursor`` per page. Adds ``iter_index``, ``all_count``
    and ``no_progress_streak``; ``cursor_sent`` becomes the cursor of the page before,
    except on a run's first page, which keeps the logged one.

    Where a column ``paging`` says so, a page is a visit's: its posts count in
    ``all_count`` of the pages after it, and it has no state, so it does not come out.
    """
    paging = F.col("paging") if "paging" in pages.columns else None
    state = running(
        pages.withColumnRenamed("cursor_sent", "_logged"),
        sums={"all_count": F.col("new_count")},
        previous={"_previous": F.col("end_cursor")},
        since={"no_progress_streak": F.col("new_count") > 0},
        counted=paging,
    )
    sent = F.when(F.col("iter_index") == 0, F.col("_logged")).otherwise(F.col("_previous"))
    state = state.withColumn("cursor_sent", sent).drop("_logged", "_previous")
    return state if paging is None else state.where("paging").drop("paging")


# ---- stop rules ------------------------------------------------------------
# Each rule is a column that holds its result code where it fires, else null.
def _code(condition: Column, code: str) -> Column:
    return F.when(condition, code)


def stop_unusable_error() -> Column:
    """An error, and no connection or no way to the promised next page."""
    error = F.coalesce(F.col("error"), F.lit("")) != ""
    connected = F.coalesce(F.col("connection_present"), F.lit(True))
    advanced = truthy_cursor() & ~F.col("end_cursor").eqNullSafe(F.col("cursor_sent"))
    return _code(error & (~connected | (F.coalesce("has_next_page", F.lit(False)) & ~advanced)), RELOAD)


def truthy_cursor() -> Column:
    return F.coalesce(F.col("end_cursor"), F.lit("")) != ""


def stop_end_of_feed() -> Column:
    return _code(~F.coalesce(F.col("has_next_page"), F.lit(False)) | ~truthy_cursor(), END_OF_FEED)


def stop_older_than_start() -> Column:
    """Not on a page asked for without a cursor, where old pinned posts come first."""
    older = F.col("oldest_in_batch_unix") < F.col("start_unix")
    return _code(F.col("cursor_sent").isNotNull() & older, REACHED_START)


def _number(limit: int | Column) -> Column:
    return limit if isinstance(limit, Column) else F.lit(limit)


def stop_no_progress(limit: int | Column = NO_PROGRESS_LIMIT) -> Column:
    limit = _number(limit)
    return _code((limit != 0) & (F.col("no_progress_streak") >= limit), END_OF_FEED)


def stop_post_cap(cap: int | Column = -1) -> Column:
    cap = _number(cap)
    return _code((cap > 0) & (F.col("all_count") >= cap), SUCCESS)


def stop_shape_error() -> Column:
    return _code((F.col("new_count") > 0) & (F.col("timestamped_count") == 0), SHAPE_ERROR)


def stop_page_cap(cap: int | Column = -1) -> Column:
    cap = _number(cap)
    return _code((cap > 0) & (F.col("iter_index") >= cap), MAX_PAGES)


def default_stop_rules(
    endpoint: str, post_cap: int = -1, page_cap: int | None = None, no_progress: int = NO_PROGRESS_LIMIT
) -> list[tuple[str, Column]]:
    """The ordered rules of an endpoint, as ``(name, column)`` pairs.

    The list may be changed or extended with any column that yields a code or null.
    """
    if page_cap is None:
        page_cap = PAGE_CAPS.get(endpoint, -1)
    timeline = endpoint == "UserTimeline"
    rules = [("unusable_error", stop_unusable_error()), ("end_of_feed", stop_end_of_feed())]
    if timeline:
        rules.append(("older_than_start", stop_older_than_start()))
    rules += [("no_progress", stop_no_progress(no_progress)), ("post_cap", stop_post_cap(post_cap))]
    if timeline:
        rules.append(("shape_error", stop_shape_error()))
    return [*rules, ("page_cap", stop_page_cap(page_cap))]


def stop_code(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that fires, null where the run goes on."""
    return F.coalesce(*[rule for _, rule in rules], F.lit(None).cast("string"))


def stop_rule(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that fires."""
    return F.coalesce(*[F.when(rule.isNotNull(), name) for name, rule in rules], F.lit(None).cast("string"))


#: Which rules end the paging of an endpoint, and its limits. Endpoints that do not page
#: have no row here: nothing ends or cuts their log.
END_RULES = {
    "UserTimeline": {"by_date": True, "by_shape": True, "page_cap": PAGE_CAPS["UserTimeline"]},
    "Search": {"by_date": False, "by_shape": False, "page_cap": PAGE_CAPS["Search"]},
}
_LIMITS = "endpoint string, by_date boolean, by_shape boolean, no_progress_limit bigint, post_cap bigint, page_cap bigint"


def end_rules(spark, post_cap: int = -1, page_cap: int | None = None, no_progress: int = NO_PROGRESS_LIMIT) -> DataFrame:
    """The end rules of the paging endpoints as a table of one row each."""
    rows = [(name, r["by_date"], r["by_shape"], no_progress, post_cap, r["page_cap"] if page_cap is None else page_cap) for name, r in END_RULES.items()]
    return spark.createDataFrame(rows, _LIMITS)


def rules_of_run() -> list[tuple[str, Column]]:
    """The ordered rules, by the limits that a run's row of ``end_rules`` put beside its pages."""
    return [
        ("unusable_error", stop_unusable_error()),
        ("end_of_feed", stop_end_of_feed()),
        ("older_than_start", F.when(F.col("by_date"), stop_older_than_start())),
        ("no_progress", stop_no_progress(F.col("no_progress_limit"))),
        ("post_cap", stop_post_cap(F.col("post_cap"))),
        ("shape_error", F.when(F.col("by_shape"), stop_shape_error())),
        ("page_cap", stop_page_cap(F.col("page_cap"))),
    ]


def with_stop_code(states: DataFrame, rules: dict[str, list[tuple[str, Column]]] | None = None, **caps) -> DataFrame:
    """Add ``stop_code`` by the rules of each run's ``endpoint``.

    ``rules`` replaces the ordered rules of an endpoint by a caller's, which may be any
    columns of the page states. Limits are those of ``end_rules``; a state that has
    limits of its own run (``post_cap`` and the like) keeps them. Pages of an endpoint that
    has no rules have no code.
    """
    limits = [c for c in ("by_date", "by_shape", "no_progress_limit", "post_cap", "page_cap") if c in states.columns]
    known = states if limits else states.join(end_rules(states.sparkSession, **caps), "endpoint", "left")
    code = F.when(F.col("page_cap").isNotNull(), stop_code(rules_of_run()))
    for endpoint, own in (rules or {}).items():
        code = F.when(F.col("endpoint") == endpoint, stop_code(own)).otherwise(code)
    return known.withColumn("stop_code", code).select(*states.columns, "stop_code")


def first_stops(states: DataFrame) -> DataFrame:
    """``run_id, stop_seq, stop_code`` of each run that stopped: a row per run, combined before the shuffle."""
    stopped = states.where(F.col("stop_code").isNotNull())
    return stopped.groupBy("run_id").agg(F.min("page_seq").alias("stop_seq"), F.min_by("stop_code", "page_seq").alias("stop_code"))


def truncate_at_stop(states: DataFrame) -> DataFrame:
    """Pages of each run up to and including the first with a ``stop_code``."""
    stops = first_stops(states).select("run_id", "stop_seq")
    return states.join(stops, "run_id", "left").where(F.col("stop_seq").isNull() | (F.col("page_seq") <= F.col("stop_seq"))).drop("stop_seq")


def run_results(truncated: DataFrame) -> DataFrame:
    """One row per run: its stop code, pages and posts."""
    return truncated.groupBy("run_id").agg(
        F.max("stop_code").alias("stop_code"),
        F.count(F.lit(1)).alias("pages"),
        F.max("all_count").alias("posts"),
    )
