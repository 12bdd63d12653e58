"""Column functions that read one post, given as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import FEED_ITEM_TYPENAME, MEDIA_TYPENAME
from feedframe.functions.once import computed
from feedframe.functions.json import child, counts, text_at, to_long, truthy, when_truthy
from feedframe.schemas import (
    OWNER_SCHEMA,
    POST_KEYS_SCHEMA,
    POST_SCHEMA,
    POST_SHAPE_SCHEMA,
    POST_TIME_SCHEMA,
)

# First and last second that a calendar date of four-digit year can hold.
_FIRST_SECOND = -62135596800
_LAST_SECOND = 253402300799


def typed_post(raw: Column) -> Column:
    """Struct view of a post."""
    return F.from_json(raw, POST_SCHEMA)


def post_id(raw: Column) -> Column:
    """Id of a post node, flat or wrapped: ``pk``, else ``id``, else the same of ``media``."""
    return id_of(F.from_json(raw, POST_KEYS_SCHEMA))


def id_of(keys: Column) -> Column:
    """The same of a post read as ``POST_KEYS_SCHEMA``."""

    def own(node: Column) -> Column:
        return F.coalesce(F.when(counts(node["pk"]), text_at(node["pk"], "$")), node["id"])

    return F.coalesce(own(keys), own(keys["media"]))


def with_post_id(posts: DataFrame) -> DataFrame:
    """Rows of ``raw`` with their ``post_id``. In two steps: an id names what it reads several
    times, and each time would be a parse."""
    read = computed(posts, _keys=F.from_json("raw", POST_KEYS_SCHEMA))
    return computed(read, post_id=id_of(F.col("_keys"))).drop("_keys")


def seconds(text: Column) -> Column:
    """Unix seconds that a calendar can show, else null."""
    value = to_long(text)
    return F.when(value.between(_FIRST_SECOND, _LAST_SECOND), value)


def post_timestamp(raw: Column, strict: bool = True) -> Column:
    """Unix seconds of a post.

    A ``caption.created_at`` key decides when it is there, even if its value is null;
    without it ``taken_at`` counts, then ``media.taken_at``. With ``strict=False`` a null
    under the caption key falls back as if the key were missing.
    """
    return time_of(F.from_json(raw, POST_TIME_SCHEMA), strict)


def time_of(node: Column, strict: bool = True) -> Column:
    """The same of a post read as ``POST_TIME_SCHEMA``."""
    created = child(node["caption"], "$.created_at")
    created_text = text_at(created, "$")
    fallback = F.coalesce(when_truthy(node["taken_at"]), node["media"]["taken_at"])
    decides = created.isNotNull() if strict else created_text.isNotNull()
    return seconds(F.when(decides, created_text).otherwise(fallback))


def owner_ids(owner_id: Column) -> Column:
    """Distinct author ids out of ``owner_id``, which is an object or a scalar."""
    parts = F.from_json(owner_id, OWNER_SCHEMA)
    from_object = F.array_distinct(F.array_compact(F.array(parts["pk"], parts["id"])))
    return (
        F.when(owner_id.isNull(), F.array().cast("array<string>"))
        .when(owner_id.startswith("{"), from_object)
        .otherwise(F.array(owner_id))
    )


def resolved_raw(raw: Column) -> Column:
    """JSON text of the media behind a post node; null for nodes that carry none."""
    shape = F.from_json(raw, POST_SHAPE_SCHEMA)
    return F.when(shape["__typename"] == MEDIA_TYPENAME, raw).when(
        shape["__typename"] == FEED_ITEM_TYPENAME, shape["media"]
    )


def author_matches(post: Column, handle: Column) -> Column:
    """Whether the author or a coauthor has this handle, letter case ignored. Never null."""
    wanted = F.lower(handle)
    by_author = truthy(post["user"]["username"]) & (F.lower(post["user"]["username"]) == wanted)
    by_coauthor = F.exists(
        post["coauthor_producers"], lambda c: F.lower(F.coalesce(c["username"], F.lit(""))) == wanted
    )
    return F.coalesce(by_author, F.lit(False)) | F.coalesce(by_coauthor, F.lit(False))


def author_missing(post: Column) -> Column:
    """Whether no author name is given, so that numeric ids may decide."""
    return F.coalesce(post["user"]["username"], F.lit("")) == ""
