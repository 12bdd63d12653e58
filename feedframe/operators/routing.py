"""Routing of response payloads to posts and users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import (
    CHAINING_KEY,
    CONNECTION_KEYS,
    FEED_ITEM_TYPENAME,
    HOME_FEED_KEY,
    IGNORE_FIRST_KEYS,
    IGNORE_LAST_KEYS,
    MEDIA_TYPENAME,
    PROFILE_KEY,
    SEARCH_GRID_TYPENAME,
    SEARCH_KEY,
    SHORTCODE_KEY,
    USER_FEED_KEY,
)
from feedframe.functions.once import computed, exploded
from feedframe.functions.json import bound, child, has_value, is_object, is_object_at, items_at, keys_of, text_at

# First match wins, so the order is part of the rule.
_ROUTES = (
    ("ignore", IGNORE_FIRST_KEYS),
    ("home_feed", (HOME_FEED_KEY,)),
    ("user_feed", (USER_FEED_KEY,)),
    ("shortcode", (SHORTCODE_KEY,)),
    ("search", (SEARCH_KEY,)),
    ("chaining", (CHAINING_KEY,)),
    ("profile", (PROFILE_KEY,)),
    ("ignore", IGNORE_LAST_KEYS),
)
_NONE = "array<variant>"


def _any(tests) -> Column:
    return reduce(Column.__or__, tests)


def route_of(payload: Column) -> Column:
    """Name of the route of a payload, by the keys it has."""

    # Each key is looked up once; asking for each known key among those present throws inside Spark on each that is.
    ranks = F.create_map(*[F.lit(x) for rank, (_, keys) in enumerate(_ROUTES) for key in keys for x in (key, rank)])
    first = F.array_min(F.transform(keys_of(payload), lambda key: F.try_element_at(ranks, key)))
    return F.coalesce(F.get(F.array(*[F.lit(name) for name, _ in _ROUTES]), first), F.lit("unknown"))


def route(payloads: DataFrame) -> DataFrame:
    """Add ``route`` to rows of ``payload``."""
    return computed(payloads, route=route_of(F.col("payload")))


def has_post_connection(payload: Column) -> Column:
    """Whether a payload carries a post connection object, empty or not."""
    return _any(is_object_at(payload, f"$.{k}") for k in CONNECTION_KEYS)


def _feed_nodes(payload: Column, key: str) -> Column:
    nodes = F.transform(items_at(payload, f"$.{key}.edges", "struct<node:variant>"), lambda e: e["node"])

    def kept(node: Column) -> Column:
        typename = text_at(node, "$.__typename")
        wrapped = (typename == FEED_ITEM_TYPENAME) & has_value(child(node, "$.media"))
        return F.coalesce((typename == MEDIA_TYPENAME) | wrapped, F.lit(False))

    return F.filter(nodes, kept)


def _search_items(payload: Column) -> Column:
    edges = items_at(payload, f"$.{SEARCH_KEY}.edges", "struct<node:struct<__typename:string,items:array<variant>>>")
    grids = F.filter(edges, lambda e: F.coalesce(e["node"]["__typename"] == SEARCH_GRID_TYPENAME, F.lit(False)))
    return F.flatten(F.transform(grids, lambda e: F.coalesce(e["node"]["items"], F.array().cast(_NONE))))


def post_nodes(route: Column, payload: Column) -> Column:
    """Array of the post nodes of one payload; nodes stay as they came, wrapped or not."""
    return (
        F.when(route == "home_feed", _feed_nodes(payload, HOME_FEED_KEY))
        .when(route == "user_feed", _feed_nodes(payload, USER_FEED_KEY))
        .when(route == "shortcode", F.filter(items_at(payload, f"$.{SHORTCODE_KEY}.items"), is_object))
        .when(route == "search", F.filter(_search_items(payload), is_object))
        .otherwise(F.array().cast(_NONE))
    )


def user_nodes(route: Column, payload: Column) -> Column:
    """Array of the user records of one payload. Users are not deduplicated here."""
    return (
        F.when(route == "chaining", items_at(payload, f"$.{CHAINING_KEY}.users"))
        .when(route == "profile", F.array(child(payload, f"$.{PROFILE_KEY}")))
        .otherwise(F.array().cast(_NONE))
    )


def _exploded(payloads: DataFrame, nodes, routes: tuple[str, ...]) -> DataFrame:
    routed = route(payloads).where(F.col("route").isin(*routes))
    rows = exploded(routed, nodes(F.col("route"), F.col("payload")), "pos", "node")
    return rows.select("run_id", "page_seq", "payload_idx", "pos", "route", F.to_json("node").alias("raw"))


def route_posts(payloads: DataFrame) -> DataFrame:
    """Every post node of every payload, in one pass over the payloads."""
    return _exploded(payloads, post_nodes, ("home_feed", "user_feed", "shortcode", "search"))


def feed_posts(payloads: DataFrame) -> DataFrame:
    return _exploded(payloads, post_nodes, ("home_feed", "user_feed"))


def shortcode_posts(payloads: DataFrame) -> DataFrame:
    return _exploded(payloads, post_nodes, ("shortcode",))


def search_posts(payloads: DataFrame) -> DataFrame:
    return _exploded(payloads, post_nodes, ("search",))


def route_users(payloads: DataFrame) -> DataFrame:
    """Every user record of every payload, in one pass over the payloads."""
    return _exploded(payloads, user_nodes, ("chaining", "profile"))


def chaining_users(payloads: DataFrame) -> DataFrame:
    return _exploded(payloads, user_nodes, ("chaining",))


def profile_users(payloads: DataFrame) -> DataFrame:
    return _exploded(payloads, user_nodes, ("profile",))


def _gathered(nodes) -> Column:
    """Array of ``(payload_idx, pos, route, raw)`` over all payloads of a page."""

    def of_payload(payload: Column, i: Column) -> Column:
        def routed(name: Column) -> Column:
            return F.transform(
                nodes(name, payload),
                lambda node, j: F.struct(
                    i.alias("payload_idx"), j.alias("pos"), name.alias("route"), F.to_json(node).alias("raw")
                ),
            )

        return bound(route_of(payload), routed)

    return F.flatten(F.transform("payloads", of_payload))


def with_nodes(parsed: DataFrame) -> DataFrame:
    """Add the ``posts`` and ``users`` of each page as arrays, to store beside its facts."""
    return parsed.withColumn("posts", _gathered(post_nodes)).withColumn("users", _gathered(user_nodes))


def node_rows(stored: DataFrame, field: str, *carry: str) -> DataFrame:
    """Rows of one of the arrays of ``with_nodes``; ``carry`` names columns of the page that go along."""
    return exploded(stored, F.col(field), "_node").select("run_id", "page_seq", *carry, "_node.*")
