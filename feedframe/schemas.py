"""Schemas of the records the engine reads and of the flat table it writes.

``POST_SCHEMA`` lists only fields that some operator uses. Three kinds of field are
STRING although JSON may hold something else there:

* ids and Unix seconds, because JSON may carry them as numbers or as text;
* ``image_versions2`` and ``owner_id``, because their JSON shape matters (an empty
  object counts as missing; an owner may be an object or a scalar). ``from_json``
  keeps the compact JSON text of an object that lands in a STRING field;
* ``is_dash_eligible``, whose JSON type is not fixed anywhere.
"""

from __future__ import annotations

from pyspark.sql import types as T

POST_SCHEMA = """
`__typename` STRING, id STRING, pk STRING, code STRING, media_type STRING, product_type STRING,
taken_at STRING,
caption STRUCT<text: STRING, created_at: STRING>,
caption_is_edited BOOLEAN, title STRING, headline STRING, accessibility_caption STRING,
like_count BIGINT, comment_count BIGINT, view_count BIGINT, play_count BIGINT, fb_like_count BIGINT,
media_repost_count BIGINT, comments_disabled BOOLEAN, like_and_view_counts_disabled BOOLEAN,
image_versions2 STRING, video_dash_manifest STRING,
carousel_media ARRAY<STRUCT<image_versions2: STRING, video_dash_manifest: STRING>>,
carousel_media_count BIGINT, has_audio BOOLEAN, is_dash_eligible STRING,
original_width BIGINT, original_height BIGINT,
user STRUCT<username: STRING, pk: STRING, full_name: STRING, is_verified: BOOLEAN, is_private: BOOLEAN,
            hd_profile_pic_url_info: STRUCT<url: STRING>>,
owner STRUCT<id: STRING, username: STRING, profile_pic_url: STRING>,
owner_id STRING,
coauthor_producers ARRAY<STRUCT<username: STRING>>,
usertags STRUCT<`in`: ARRAY<STRUCT<user: STRUCT<username: STRING>>>>,
location STRUCT<name: STRING, pk: STRING, lat: DOUBLE, lng: DOUBLE>,
clips_metadata STRUCT<
  original_sound_info: STRUCT<original_audio_title: STRING>,
  music_info: STRUCT<music_asset_info: STRUCT<title: STRING, display_artist: STRING>>>,
is_paid_partnership BOOLEAN,
facepile_top_likers ARRAY<STRUCT<username: STRING, id: STRING, profile_pic_url: STRING>>
"""

# Small schemas for operators that read a few keys of a post, so that the parser
# skips the rest of the text.
POST_KEYS_SCHEMA = "pk VARIANT, id STRING, media STRUCT<pk: VARIANT, id: STRING>"
POST_TIME_SCHEMA = "caption VARIANT, taken_at STRING, media STRUCT<taken_at: STRING>"
POST_SHAPE_SCHEMA = "`__typename` STRING, media STRING"
POST_AUTHOR_SCHEMA = """
taken_at STRING, user STRUCT<username: STRING>, owner_id STRING,
coauthor_producers ARRAY<STRUCT<username: STRING>>
"""
IMAGE_SCHEMA = "candidates ARRAY<STRUCT<url: STRING>>"
OWNER_SCHEMA = "pk STRING, id STRING"

USER_SCHEMA = "username STRING, id STRING, pk STRING, is_private BOOLEAN, profile_pic_url STRING"

MANIFEST_SCHEMA = """
BaseURL ARRAY<STRING>,
Period ARRAY<STRUCT<
  BaseURL: ARRAY<STRING>,
  AdaptationSet: ARRAY<STRUCT<
    _mimeType: STRING,
    BaseURL: ARRAY<STRING>,
    Representation: ARRAY<STRUCT<_mimeType: STRING, _bandwidth: STRING, BaseURL: ARRAY<STRING>>>>>>>
"""

RUN_DOCUMENT_SCHEMA = """
run_id STRING, part BIGINT, `first` BIGINT,
query STRUCT<endpoint: STRING, query: MAP<STRING, STRING>, params: MAP<STRING, STRING>,
             start_date: STRING, end_date: STRING>,
result STRING, posts ARRAY<STRING>, users ARRAY<STRING>, time_started STRING, time_taken STRING
"""

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("page_seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("cursor_sent", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

FLAT_COLUMNS = {
    # identity
    "id": "string",
    "pk": "string",
    "code": "string",
    "url": "string",
    "typename": "string",
    "media_type": "string",
    "product_type": "string",
    # timing
    "taken_at": "bigint",
    "taken_at_iso": "string",
    # content
    "caption_text": "string",
    "caption_created_at_iso": "string",
    "caption_is_edited": "boolean",
    "title": "string",
    "headline": "string",
    "accessibility_caption": "string",
    # engagement
    "like_count": "bigint",
    "comment_count": "bigint",
    "view_count": "bigint",
    "play_count": "bigint",
    "fb_like_count": "bigint",
    "media_repost_count": "bigint",
    "comments_disabled": "boolean",
    "like_and_view_counts_disabled": "boolean",
    # media shape
    "num_images": "bigint",
    "num_videos": "bigint",
    "carousel_media_count": "bigint",
    "has_audio": "boolean",
    "is_dash_eligible": "string",
    "original_width": "bigint",
    "original_height": "bigint",
    # author
    "user_username": "string",
    "user_pk": "string",
    "user_full_name": "string",
    "user_is_verified": "boolean",
    "user_is_private": "boolean",
    "owner_id": "string",
    "coauthor_usernames": "string",
    "tagged_usernames": "string",
    # context
    "location_name": "string",
    "location_pk": "string",
    "location_lat": "double",
    "location_lng": "double",
    "audio_label": "string",
    "is_paid_partnership": "boolean",
}
FLAT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FLAT_COLUMNS.items())
