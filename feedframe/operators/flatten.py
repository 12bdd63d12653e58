"""From raw post nodes to the flat table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.constants import BASE_URL
from feedframe.functions.once import computed
from feedframe.functions.posts import resolved_raw, typed_post
from feedframe.functions.scalars import (
    audio_label,
    count_media,
    foreign_owner,
    iso_utc,
    media_type_name,
    post_permalink,
    semi_join,
)
from feedframe.functions.json import to_long
from feedframe.schemas import FLAT_COLUMNS


def resolve_media(posts: DataFrame) -> DataFrame:
    """Replace wrapped nodes by their media; drop nodes of other types.

    ``observe`` the input and output to count what was dropped.
    """
    return computed(posts, raw=resolved_raw(F.col("raw"))).where(F.col("raw").isNotNull())


def _flat(post: Column, base_url: str) -> dict[str, Column]:
    user, owner, caption, location = post["user"], post["owner"], post["caption"], post["location"]
    slides = post["carousel_media"]
    tagged = F.transform(post["usertags"]["in"], lambda t: t["user"]["username"])
    renamed = {
        "url": post_permalink(post["code"], post["product_type"], base_url),
        "typename": post["__typename"],
        "media_type": media_type_name(post["media_type"]),
        "taken_at": to_long(post["taken_at"]),
        "taken_at_iso": iso_utc(post["taken_at"]),
        "caption_text": caption["text"],
        "caption_created_at_iso": iso_utc(caption["created_at"]),
        "num_images": count_media(post["image_versions2"], slides, "image_versions2"),
        "num_videos": count_media(post["video_dash_manifest"], slides, "video_dash_manifest"),
        "user_username": user["username"],
        "user_pk": user["pk"],
        "user_full_name": user["full_name"],
        "user_is_verified": user["is_verified"],
        "user_is_private": user["is_private"],
        "owner_id": foreign_owner(owner["id"], user["pk"]),
        "coauthor_usernames": semi_join(F.transform(post["coauthor_producers"], lambda c: c["username"])),
        "tagged_usernames": semi_join(tagged),
        "location_name": location["name"],
        "location_pk": location["pk"],
        "location_lat": location["lat"],
        "location_lng": location["lng"],
        "audio_label": audio_label(post["clips_metadata"]),
    }
    return {name: renamed[name] if name in renamed else post[name] for name in FLAT_COLUMNS}


def flatten_posts(
    posts: DataFrame, keep: tuple[str, ...] = (), resolve: bool = False, base_url: str = BASE_URL
) -> DataFrame:
    """One flat row per post, always with the same columns.

    ``keep`` names columns of ``posts`` to carry along in front. Wrapped nodes flatten
    to mostly nulls unless ``resolve`` is set, which drops other node types too.
    """
    if resolve:
        posts = resolve_media(posts)
    post = F.col("_post")
    flat = [c.cast(FLAT_COLUMNS[n]).alias(n) for n, c in _flat(post, base_url).items()]
    return posts.select(*keep, typed_post(F.col("raw")).alias("_post")).select(*keep, *flat)
