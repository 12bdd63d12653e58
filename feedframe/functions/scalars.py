"""Scalar functions: labels, links, names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedframe.constants import (
    BASE_URL,
    FAILED_TO_LOAD,
    IMAGE_EXTENSIONS,
    INPUT_EXTENSIONS,
    NO_POSTS,
    PRIVATE,
    RESULT_CATEGORIES,
    TEXT_FAILED,
    TEXT_NO_POSTS,
    TEXT_PRIVATE,
    TEXT_RETRY,
    TEXT_SORRY,
    TEXT_UNAVAILABLE,
    UNAVAILABLE,
)
from feedframe.functions.json import non_empty, truthy
from feedframe.functions.posts import seconds

_SHORTCODE = r"/(?:p|reel|tv)/([A-Za-z0-9_-]+)/?"


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


# ---- time ------------------------------------------------------------------
def iso_utc(ts: Column) -> Column:
    """ISO text with ``+00:00`` of Unix seconds, whatever the session zone."""
    s = seconds(ts.cast("string"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))
    rest = F.pmod(s, F.lit(86400))
    clock = [F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60]
    text = F.format_string("%sT%02d:%02d:%02d+00:00", day.cast("string"), *[c.cast("int") for c in clock])
    return F.when(s.isNotNull(), text)


def unix_to_timestamp(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def from_iso(text: Column) -> Column:
    """Timestamp of ISO text read as UTC wall time: a zone suffix is dropped, not applied."""
    wall = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)"
    read = non_empty(F.regexp_extract(text, wall, 1))
    missing = F.when(F.length(read) == 10, "T00:00:00Z").when(F.length(read) == 16, ":00Z").otherwise("Z")
    return F.try_to_timestamp(F.concat(read, missing))


# ---- post labels -----------------------------------------------------------
def post_permalink(code: Column, product_type: Column, base_url: str = BASE_URL) -> Column:
    kind = F.when(product_type == "clips", "reel/").otherwise("p/")
    return F.when(truthy(code), F.concat(F.lit(base_url), kind, code, F.lit("/")))


def audio_label(clips_metadata: Column) -> Column:
    asset = clips_metadata["music_info"]["music_asset_info"]
    title = non_empty(asset["title"])
    artist = non_empty(asset["display_artist"])
    music = F.when(artist.isNull(), title).otherwise(F.concat(title, F.lit(" — "), artist))
    return F.coalesce(non_empty(clips_metadata["original_sound_info"]["original_audio_title"]), music)


def count_media(own: Column, slides: Column, field: str) -> Column:
    """How many of a post and its carousel slides carry a non-empty ``field``."""
    on_slides = F.size(F.filter(slides, lambda s: truthy(s[field])))
    return truthy(own).cast("bigint") + F.coalesce(F.greatest(on_slides, F.lit(0)), F.lit(0)).cast("bigint")


def semi_join(values: Column) -> Column:
    """Non-empty texts joined by ``;``; null when none is left."""
    return non_empty(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), ";"))


def media_type_name(media_type: Column) -> Column:
    return (
        F.when(media_type == "1", "photo")
        .when(media_type == "2", "video")
        .when(media_type == "8", "carousel")
        .otherwise(media_type)
    )


def foreign_owner(owner_id: Column, user_pk: Column) -> Column:
    """Owner id, given only when it differs from the author's."""
    return F.when(~owner_id.eqNullSafe(user_pk), owner_id)


# ---- links and file names --------------------------------------------------
def is_post_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(_SHORTCODE)), F.lit(False))


def extract_shortcode(url: Column) -> Column:
    return non_empty(F.regexp_extract(url, _SHORTCODE, 1))


def is_post_href(href: Column) -> Column:
    """Whether a link of a stored page leads to a post."""
    return F.coalesce(
        href.startswith("/p/")
        | href.startswith("/reel/")
        | F.rlike(href, F.lit(r"^/[A-Za-z0-9_.-]+/(?:p|reel)/[A-Za-z0-9_.-]+/?\n?\z")),
        F.lit(False),
    )


def image_file_name(post_id: Column, url: Column) -> Column:
    """``<post_id>_<stem>.png``, the stem ending at the first listed extension that occurs."""
    tail = F.substring_index(url, "/", -1)
    stem = tail
    for extension in reversed(IMAGE_EXTENSIONS):
        stem = F.when(tail.contains(extension), F.substring_index(tail, extension, 1)).otherwise(stem)
    return F.concat(post_id, F.lit("_"), stem, F.lit(".png"))


def video_file_names(post_id: Column, idx: Column) -> Column:
    """Struct of the video, audio and merged names of one manifest."""
    base = F.concat(post_id, F.when(idx > 0, F.concat(F.lit("_"), idx.cast("string"))).otherwise(""))
    return F.struct(
        F.concat(base, F.lit("_video.mp4")).alias("video_name"),
        F.concat(base, F.lit("_audio.mp4")).alias("audio_name"),
        F.concat(base, F.lit(".mp4")).alias("merged_name"),
    )


def safe_target(text: Column) -> Column:
    """Text fit for a file name: each run of other characters becomes one ``_``."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def result_file_name(target: Column, endpoint: Column, start: Column, end: Column) -> Column:
    """``<target>_<endpoint>[_<start>_<end>].json``; dates only when a start is given."""
    dates = F.when(start.isNotNull(), F.concat_ws("_", start, end))
    return F.concat(F.concat_ws("_", safe_target(target), endpoint, dates), F.lit(".json"))


def input_stem(path: Column) -> Column:
    """File name without its longest known input extension (else without its last one)."""
    name = F.substring_index(path, "/", -1)
    known = "|".join(e.replace(".", r"\.") for e in sorted(INPUT_EXTENSIONS, key=len, reverse=True))
    return F.when(
        F.rlike(name, F.lit(f"(?:{known})$")), F.regexp_replace(name, f"(?:{known})$", "")
    ).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))


# ---- codes -----------------------------------------------------------------
def result_category(code: Column) -> Column:
    """``success``, ``retry``, ``crash``, ``partial`` or ``unknown``."""
    return F.coalesce(F.try_element_at(_literal_map(RESULT_CATEGORIES), code), F.lit("unknown"))


def page_text_state(
    text: Column,
    endpoint: Column,
    on_target: Column,
    known_private: Column,
    has_feed: Column,
) -> Column:
    """Result code that the text of a stored page stands for, null when it says nothing.

    ``on_target``: the page's URL is the one asked for; ``known_private``: a user record
    of the run marks the handle private; ``has_feed``: the run has a feed response.
    """

    def shows(phrase: str) -> Column:
        return F.coalesce(text.contains(phrase), F.lit(False))

    private_text = shows(TEXT_PRIVATE[0]) | shows(TEXT_PRIVATE[1])
    gate = shows(TEXT_RETRY) & shows(TEXT_FAILED) & F.coalesce(on_target, F.lit(False))
    private = F.coalesce(known_private, F.lit(False))
    no_feed = ~F.coalesce(has_feed, F.lit(False))
    timeline = (
        F.when(shows(TEXT_UNAVAILABLE), UNAVAILABLE)
        .when(shows(TEXT_SORRY), NO_POSTS)
        .when(private_text, PRIVATE)
        .when(gate & private, PRIVATE)
        .when(gate, FAILED_TO_LOAD)
        .when(no_feed & private, PRIVATE)
        .when(no_feed & shows(TEXT_NO_POSTS), NO_POSTS)
    )
    return (
        F.when(endpoint == "UserTimeline", timeline)
        .when((endpoint == "PostByShortcode") & shows(TEXT_SORRY), UNAVAILABLE)
        .when((endpoint == "Chaining") & shows(TEXT_UNAVAILABLE), UNAVAILABLE)
    )
