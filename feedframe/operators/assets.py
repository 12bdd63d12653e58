"""Images, videos and profile pictures of posts, as rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedframe.functions.once import computed, exploded
from feedframe.functions.json import non_empty, truthy
from feedframe.functions.manifests import (
    audio_track,
    best_video,
    distinct_base_urls,
    parse_manifest,
    representations,
)
from feedframe.functions.posts import typed_post
from feedframe.functions.scalars import image_file_name, is_post_href, video_file_names
from feedframe.operators.dedup import dedup_profile_pics
from feedframe.schemas import IMAGE_SCHEMA

_PIC = "array<struct<handle:string,profile_pic_url:string>>"


class Assets(NamedTuple):
    videos: DataFrame
    images: DataFrame
    profile_pics: DataFrame


def _read(posts: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Column]:
    post = F.col("_post")
    return posts.select(*keep, typed_post(F.col("raw")).alias("_post")), post


def _own_and_slides(post: Column, field: str) -> Column:
    slides = F.coalesce(
        F.transform(post["carousel_media"], lambda s: s[field]), F.array().cast("array<string>")
    )
    return F.concat(F.array(post[field]), slides)


def _manifests(posts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per manifest; ``idx`` counts the manifests of a post."""
    typed, post = _read(posts, keep)
    texts = F.filter(_own_and_slides(post, "video_dash_manifest"), truthy)
    found = exploded(typed.select(*keep, post["id"].alias("post_id"), texts.alias("_texts")), F.col("_texts"), "idx", "_xml")
    return found.select(*keep, "post_id", "idx", parse_manifest(F.col("_xml")).alias("_manifest"))


def video_audio_pairs(posts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best video and its audio per manifest; manifests without a video give no row."""
    reps = F.col("_reps")
    parsed = _manifests(posts, keep).withColumn("_reps", representations(F.col("_manifest")))
    pairs = computed(parsed, video_url=best_video(reps), audio_url=audio_track(reps))
    return pairs.where(F.col("video_url").isNotNull()).select(*keep, "post_id", "idx", "video_url", "audio_url")


def video_urls(posts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every distinct base URL of every manifest."""
    urls = exploded(_manifests(posts, keep), distinct_base_urls(F.col("_manifest")), "video_url")
    return urls.select(*keep, "post_id", "video_url")


def best_image(image_versions: Column) -> Column:
    """URL of the first candidate, which is the largest."""
    return F.get(F.from_json(image_versions, IMAGE_SCHEMA)["candidates"], F.lit(0))["url"]


def image_urls(posts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The post's own image, then those of its slides, with their position."""
    typed, post = _read(posts, keep)
    urls = F.filter(
        F.transform(_own_and_slides(post, "image_versions2"), best_image), lambda u: u.isNotNull()
    )
    images = exploded(typed.select(*keep, post["id"].alias("post_id"), urls.alias("_urls")), F.col("_urls"), "pos", "image_url")
    return images.drop("_urls")


def _first_per_handle(pics: Column) -> Column:
    handles = F.transform(pics, lambda p: p["handle"])
    return F.filter(pics, lambda p, i: F.array_position(handles, p["handle"]) == i + 1)


def post_profile_pics(posts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pictures named in a post: author, top likers, owner; the first of each handle."""
    typed, post = _read(posts, keep)
    user, owner = post["user"], post["owner"]

    def pic(handle: Column, url: Column) -> Column:
        return F.struct(handle.alias("handle"), url.alias("profile_pic_url"))

    likers = F.transform(
        post["facepile_top_likers"],
        lambda k: pic(F.coalesce(non_empty(k["username"]), k["id"]), k["profile_pic_url"]),
    )
    pics = F.concat(
        F.array(pic(user["username"], user["hd_profile_pic_url_info"]["url"])),
        F.coalesce(likers, F.array().cast(_PIC)),
        F.array(pic(owner["username"], owner["profile_pic_url"])),
    )
    complete = F.filter(
        pics, lambda p: (F.coalesce(p["handle"], F.lit("")) != "") & (F.coalesce(p["profile_pic_url"], F.lit("")) != "")
    )
    pics = exploded(typed.select(*keep, complete.alias("_pics")), _first_per_handle(F.col("_pics")), "pos", "_pic")
    return pics.select(*keep, "pos", "_pic.*")


def _with_picture(users: DataFrame) -> DataFrame:
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("username", "profile_pic_url")]
    return users.where(given[0] & given[1]).withColumnRenamed("username", "handle")


def user_profile_pics(users: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """First picture of each handle among user records."""
    return dedup_profile_pics(_with_picture(users), order).select("handle", "profile_pic_url")


def union_pics(posts: DataFrame, users: DataFrame, post_order, user_order) -> DataFrame:
    """Pictures of posts and users together with ``_order``: posts first, each in order.

    Both orders must have the same column types.
    """

    def ordered(pics: DataFrame, source: int, order) -> DataFrame:
        place = F.struct(F.lit(source).alias("source"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        return pics.select(place.alias("_order"), "handle", "profile_pic_url")

    own = post_profile_pics(posts, keep=tuple(post_order))
    of_posts = own.select(
        F.struct(F.lit(0).alias("source"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(post_order)]).alias("_order"),
        F.col("pos").alias("_pos"),
        "handle",
        "profile_pic_url",
    )
    of_users = ordered(_with_picture(users), 1, user_order).withColumn("_pos", F.lit(0))
    return of_posts.unionByName(of_users)


def assets(posts: DataFrame, users: DataFrame, post_order, user_order) -> Assets:
    """Videos, images and distinct profile pictures of posts and users."""
    pics = union_pics(posts, users, post_order, user_order)
    return Assets(
        video_urls(posts),
        image_urls(posts).select("post_id", "image_url"),
        dedup_profile_pics(pics, ("_order", "_pos")).select("handle", "profile_pic_url"),
    )


def image_plan(
    posts: DataFrame,
    include_profile_pics: bool = False,
    users: DataFrame | None = None,
    user_order: tuple[str, ...] = ("run_id", "page_seq", "payload_idx", "pos"),
) -> DataFrame:
    """What an image download would fetch: ``url`` and ``name``.

    Pictures are not deduplicated over posts here, those of user records are.
    """
    plan = image_urls(posts).select(
        F.col("image_url").alias("url"), image_file_name(F.col("post_id"), F.col("image_url")).alias("name")
    )
    if not include_profile_pics:
        return plan
    pics = post_profile_pics(posts).select("handle", "profile_pic_url")
    if users is not None:
        pics = pics.unionByName(user_profile_pics(users, user_order))
    return plan.unionByName(
        pics.select(F.col("profile_pic_url").alias("url"), F.concat("handle", F.lit(".png")).alias("name"))
    )


def video_plan(posts: DataFrame, merge: bool = False, keep_streams: bool = False) -> DataFrame:
    """What a video download would fetch, and the names that would remain (``saved``)."""
    names = video_file_names(F.col("post_id"), F.col("idx"))
    video, audio, merged = F.col("video_name"), F.col("audio_name"), F.col("merged_name")
    has_audio = F.coalesce(F.col("audio_url"), F.lit("")) != ""
    streams = F.when(has_audio, F.array(video, audio)).otherwise(F.array(video))
    if merge:
        joined = F.array(merged, video, audio) if keep_streams else F.array(merged)
        streams = F.when(has_audio, joined).otherwise(F.array(video))
    return (
        video_audio_pairs(posts)
        .select("post_id", "idx", "video_url", "audio_url", names.alias("_names"))
        .select("post_id", "idx", "video_url", "audio_url", "_names.*")
        .withColumn("audio_name", F.when(has_audio, audio))
        .withColumn("saved", streams)
    )


# Text that holds no tags of its own: comments and the insides of some elements.
_NO_TAGS = r"(?is)<!--.*?-->|<(script|style|textarea|template)\b.*?</\1\s*>"
# An anchor's start tag; what stands in quotes may hold any character.
_ANCHOR = r"""(?is)<a(?=[\s/>])([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>"""
# One attribute: its name, and its value with quotes or without.
_ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
# Named character references of link targets, the ampersand's last.
_ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&amp;", "&"))


def _target(attributes: Column) -> Column:
    """Value of the first ``href`` of a start tag; null when it has none."""
    names = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), 1)
    values = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), 2)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))
    value = F.get(F.filter(pairs, lambda p: p["name"] == "href"), F.lit(0))["value"]
    quoted = value.startswith('"') | value.startswith("'")
    plain = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    for name, character in _ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(character))
    return F.trim(plain)


def hrefs(html: Column) -> Column:
    """Link targets of the anchors of a stored page, in page order.

    Names in any case, values in double, single or no quotes, character references
    resolved; comments and scripts hold no anchors, and an anchor without ``href`` is none.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, _NO_TAGS, " "), F.lit(_ANCHOR), 1)
    return F.filter(F.transform(tags, _target), lambda h: h.isNotNull())


def post_links(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Links of stored pages that lead to posts, with their position among all links."""
    links = exploded(pages, hrefs(F.col("html")), "pos", "href").select(*keep, "pos", "href")
    return links.where(is_post_href(F.col("href")))


def lowest_post_link(links: Column) -> Column:
    """Last of an array of link targets that leads to a post."""
    return F.try_element_at(F.filter(links, is_post_href), F.lit(-1))
