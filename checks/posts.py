"""Queries over posts: projection, filters, flat table, scalar functions, assets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import feedframe as ff
from checks import adapters as a
from checks.registry import query
from feedframe.functions import posts as post_fns
from feedframe.functions import scalars
from feedframe.functions.json import to_long
from feedframe.operators.assets import best_image, union_pics
from feedframe.functions.manifests import (
    audio_track,
    best_video,
    distinct_base_urls,
    parse_manifest,
    representations,
)

RESOLVED = a.RESOLVED_SQL

# ---- expected values of a post, in terms of the derived columns -------------
OWN_IMAGE = "(d % 8 NOT IN (1, 2))"
ISO = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"
USER_GIVEN = "d % 12 <> 0"
FLAT_DUCK = f"""
  d, id, pk, code,
  CASE WHEN code IS NOT NULL THEN 'https://www.instagram.com/' || CASE WHEN product_type = 'clips' THEN 'reel/' ELSE 'p/' END || code || '/' END AS url,
  CASE WHEN typename = 'XDTFeedItem' THEN 'XDTMediaDict' ELSE typename END AS typename,
  CASE media_type WHEN '1' THEN 'photo' WHEN '2' THEN 'video' WHEN '8' THEN 'carousel' ELSE media_type END AS media_type,
  product_type, taken_at, {ISO.format('taken_at')} AS taken_at_iso,
  CASE WHEN caption_form <> 0 THEN text END AS caption_text,
  CASE WHEN caption_form NOT IN (0, 1, 2) THEN {ISO.format('created_at')} END AS caption_created_at_iso,
  d % 2 = 1 AS caption_is_edited, lang AS title, CAST(NULL AS VARCHAR) AS headline, source AS accessibility_caption,
  n_chars AS like_count, CAST(quality AS BIGINT) AS comment_count, d * 3 AS view_count, CAST(NULL AS BIGINT) AS play_count,
  d % 5 AS fb_like_count, CAST(toxic AS BIGINT) AS media_repost_count, quality = 1 AS comments_disabled,
  false AS like_and_view_counts_disabled,
  CAST({OWN_IMAGE} AS BIGINT) + CAST(slides >= 1 AS BIGINT) AS num_images,
  CAST(d % 5 = 1 AS BIGINT) + CAST(slides >= 2 AS BIGINT) + CAST(slides >= 3 AS BIGINT) AS num_videos,
  slides AS carousel_media_count, d % 3 = 0 AS has_audio, '1' AS is_dash_eligible,
  CAST(1080 AS BIGINT) AS original_width, d % 1000 + 1 AS original_height,
  CASE WHEN {USER_GIVEN} THEN username END AS user_username, CASE WHEN {USER_GIVEN} THEN user_pk END AS user_pk,
  CASE WHEN {USER_GIVEN} THEN source || ' ' || lang END AS user_full_name,
  CASE WHEN {USER_GIVEN} THEN d % 2 = 0 END AS user_is_verified, CASE WHEN {USER_GIVEN} THEN false END AS user_is_private,
  CASE WHEN d % 2 = 1 THEN 'o' || d WHEN NOT {USER_GIVEN} THEN user_pk END AS owner_id,
  CASE WHEN lang = 'en' THEN 'en;' || source END AS coauthor_usernames,
  CASE WHEN d % 5 = 0 THEN source || ';' || lang END AS tagged_usernames,
  CASE WHEN d % 9 > 1 THEN lang || '-town' END AS location_name, CASE WHEN d % 9 > 1 THEN CAST(d % 31 AS VARCHAR) END AS location_pk,
  CASE WHEN d % 9 > 1 THEN (d % 90) + CAST(0.5 AS DOUBLE) END AS location_lat,
  CASE WHEN d % 9 > 1 THEN (d % 180) - CAST(0.25 AS DOUBLE) END AS location_lng,
  CASE d % 6 WHEN 1 THEN lang WHEN 2 THEN source || ' — ' || lang WHEN 3 THEN source END AS audio_label,
  d % 20 = 0 AS is_paid_partnership
"""


def _resolved(spark, sf):
    return ff.resolve_media(a.posts(spark, sf))


# ---- projection -------------------------------------------------------------
@query(RESOLVED + "SELECT d, id, coalesce(pk, '-') AS pk, length(text) AS text_chars FROM m")
def prj_1_resolve_media(spark, sf):
    fields = F.from_json("raw", "id STRING, pk STRING").alias("f")
    return _resolved(spark, sf).select("d", fields, F.length("text").cast("bigint").alias("text_chars")).select(
        "d", "f.id", F.coalesce("f.pk", F.lit("-")).alias("pk"), "text_chars"
    )


@query(
    f"""WITH p AS ({a.POSTS_SQL})
    SELECT d, CASE WHEN typename = 'XDTFeedItem' AND d % 70 = 0 THEN NULL WHEN pk <> '' THEN pk ELSE id END AS post_id FROM p"""
)
def prj_2_post_id(spark, sf):
    return a.posts(spark, sf).select("d", post_fns.post_id(F.col("raw")).alias("post_id"))


@query(
    f"""WITH p AS ({a.POSTS_SQL})
    SELECT d, CASE WHEN typename = 'XDTFeedItem' THEN CASE WHEN d % 70 <> 0 THEN taken_at END
      WHEN caption_form IN (0, 2) THEN taken_at WHEN caption_form = 1 THEN NULL ELSE created_at END AS ts FROM p"""
)
def prj_3_post_timestamp(spark, sf):
    return a.posts(spark, sf).select("d", post_fns.post_timestamp(F.col("raw")).alias("ts"))


@query(RESOLVED + f"SELECT {FLAT_DUCK} FROM m")
def prj_4_flatten_posts(spark, sf):
    return ff.flatten_posts(a.posts(spark, sf), keep=("d",), resolve=True)


@query(
    f"""WITH p AS ({a.POSTS_SQL})
    SELECT d, CASE WHEN d % 19 = 0 THEN '' WHEN owner_form = 2 THEN 'p' || d || ',' || owner_key ELSE owner_key END AS owner_ids
    FROM p WHERE typename <> 'XDTFeedItem'"""
)
def prj_5_owner_ids(spark, sf):
    owner = F.from_json("raw", "owner_id STRING")["owner_id"]
    plain = a.posts(spark, sf).where(F.col("typename") != "XDTFeedItem")
    return plain.select("d", F.array_join(post_fns.owner_ids(owner), ",").alias("owner_ids"))


# ---- filters ----------------------------------------------------------------
@query(RESOLVED + "SELECT d, taken_at FROM m WHERE taken_at >= 1704153600 AND taken_at < 1706832000")
def flt_1_between_dates(spark, sf):
    kept = ff.between_dates(_resolved(spark, sf), "2024-01-02", "2024-02-01")
    return kept.select("d", "taken_at")


@query(RESOLVED + "SELECT d, taken_at FROM m WHERE taken_at >= 1704171600 AND taken_at < 1706850000")
def flt_1_between_dates_zone(spark, sf):
    kept = ff.between_dates(_resolved(spark, sf), "2024-01-02", "2024-02-01", tz="America/New_York")
    return kept.select("d", "taken_at")


@query(
    RESOLVED
    + f"""SELECT d FROM m WHERE (lower(username) = 'en' AND {USER_GIVEN}) OR lang = 'en'
    OR ((username IS NULL OR NOT {USER_GIVEN}) AND d % 19 <> 0 AND owner_key IN ('own3', 'own9', 'own12'))"""
)
def flt_2_by_author_list(spark, sf):
    return ff.by_author(_resolved(spark, sf), "EN", ["own3", "own9", "own12"]).select("d")


@query(
    RESOLVED
    + f""", ids AS (SELECT DISTINCT 'own' || (doc_id % 500) AS user_id FROM documents WHERE lang = 'de')
    SELECT d FROM m WHERE (lower(username) = 'src3' AND {USER_GIVEN}) OR (lang = 'en' AND source = 'src3')
    OR ((username IS NULL OR NOT {USER_GIVEN}) AND d % 19 <> 0 AND owner_key IN (SELECT user_id FROM ids))"""
)
def flt_2_by_author_table(spark, sf):
    ids = a.table(spark, sf, "documents").where("lang = 'de'").select(
        F.concat(F.lit("own"), (F.col("doc_id") % 500).cast("string")).alias("user_id")
    )
    return ff.by_author(_resolved(spark, sf), "SRC3", ids).select("d")


@query(
    """SELECT page_id, url, regexp_matches(u, '/(?:p|reel|tv)/([A-Za-z0-9_-]+)/?') AS is_post FROM (
      SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url || '/tv/x_' || page_id
        WHEN page_id % 6 = 2 THEN url || '/p/A-' || page_id || '/?a=1' END AS u FROM pages) p WHERE u IS NOT NULL
    UNION ALL SELECT page_id, url, false FROM pages WHERE page_id % 6 = 5"""
)
def flt_3_is_post_url(spark, sf):
    return _urls(spark, sf).select("page_id", "url", scalars.is_post_url(F.col("u")).alias("is_post"))


def _urls(spark, sf):
    i = F.col("page_id")
    number = i.cast("string")
    u = (
        F.when(i % 3 == 0, F.col("url"))
        .when(i % 3 == 1, F.concat("url", F.lit("/tv/x_"), number))
        .when(i % 6 == 2, F.concat("url", F.lit("/p/A-"), number, F.lit("/?a=1")))
    )
    return a.table(spark, sf, "pages").select("page_id", "url", u.alias("u"))


@query(
    """SELECT page_id, url, nullif(regexp_extract(CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url || '/tv/x_' || page_id
        WHEN page_id % 6 = 2 THEN url || '/p/A-' || page_id || '/?a=1' END, '/(?:p|reel|tv)/([A-Za-z0-9_-]+)/?', 1), '') AS shortcode FROM pages"""
)
def scl_10_extract_shortcode(spark, sf):
    return _urls(spark, sf).select("page_id", "url", scalars.extract_shortcode(F.col("u")).alias("shortcode"))


@query(
    """SELECT doc_id, href, href LIKE '/p/%' OR href LIKE '/reel/%' OR regexp_matches(href, '^/[A-Za-z0-9_.-]+/(?:p|reel)/[A-Za-z0-9_.-]+/?$') AS is_post
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/p/' WHEN 1 THEN '/' || source || '/reel/' || doc_id WHEN 2 THEN '/' || source || '/tv/' || doc_id
      WHEN 3 THEN '/' || lang || '/p/' || doc_id || '/extra' ELSE '/reel/' || lang END AS href FROM documents) h"""
)
def flt_4_is_post_href(spark, sf):
    d, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    href = (
        F.when(d % 5 == 0, "/p/")
        .when(d % 5 == 1, F.concat(F.lit("/"), source, F.lit("/reel/"), d))
        .when(d % 5 == 2, F.concat(F.lit("/"), source, F.lit("/tv/"), d))
        .when(d % 5 == 3, F.concat(F.lit("/"), lang, F.lit("/p/"), d, F.lit("/extra")))
        .otherwise(F.concat(F.lit("/reel/"), lang))
    )
    return a.table(spark, sf, "documents").select("doc_id", href.alias("href")).withColumn(
        "is_post", scalars.is_post_href(F.col("href"))
    )


# ---- scalar functions over the flat table -----------------------------------
def _flat_part(spark, sf, *columns):
    return ff.flatten_posts(a.posts(spark, sf), keep=("d",), resolve=True).select("d", *columns)


def _flat_query(name, *columns):
    """One registered query per scalar, over its own columns of the flat table: Spark then
    parses only the fields behind them."""

    def run(spark, sf):
        return _flat_part(spark, sf, *columns)

    run.__name__ = name
    query(RESOLVED + f"SELECT d, {', '.join(columns)} FROM (SELECT {FLAT_DUCK} FROM m) f")(run)


_flat_query("scl_1_iso_utc", "taken_at_iso", "caption_created_at_iso")
_flat_query("scl_2_post_permalink", "url")
_flat_query("scl_3_audio_label", "audio_label")
_flat_query("scl_4_count_media", "num_images", "num_videos")
_flat_query("scl_5_semi_join", "coauthor_usernames", "tagged_usernames")
_flat_query("scl_6_media_type_name", "media_type")
_flat_query("scl_7_flat_owner_id", "owner_id")
_flat_query("scl_8_name_lists", "coauthor_usernames", "tagged_usernames", "user_username")
_flat_query("scl_9_location", "location_name", "location_pk", "location_lat", "location_lng")


@query(
    """SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN id || '_' || stem || '.png' ELSE id || '_' || stem || CASE n_chars % 5 WHEN 4 THEN '?x' WHEN 2 THEN '.webp' ELSE '' END || '.png' END AS name
    FROM (SELECT doc_id, n_chars, doc_id || '_' || source AS id, 'n' || doc_id || '.x' AS stem FROM documents) d"""
)
def scl_11_image_file_name(spark, sf):
    kind = F.col("n_chars") % 5
    stem = F.concat(F.lit("n"), F.col("doc_id"), F.lit(".x"))
    tail = (
        F.when(kind == 0, ".jpg?q=.png")
        .when(kind == 1, ".heic")
        .when(kind == 2, ".webp.heic")
        .when(kind == 3, "")
        .otherwise("?x")
    )
    url = F.concat(F.lit("https://img.example/.jpg/"), stem, tail)
    post_id = F.concat_ws("_", F.col("doc_id").cast("string"), "source")
    return a.table(spark, sf, "documents").select("doc_id", scalars.image_file_name(post_id, url).alias("name"))


@query(
    """SELECT l_orderkey, l_linenumber, base || '_video.mp4' AS video_name, base || '_audio.mp4' AS audio_name, base || '.mp4' AS merged_name
    FROM (SELECT l_orderkey, l_linenumber, l_orderkey || CASE WHEN l_linenumber > 1 THEN '_' || (l_linenumber - 1) ELSE '' END AS base FROM lineitem) n"""
)
def scl_12_video_file_names(spark, sf):
    names = scalars.video_file_names(F.col("l_orderkey").cast("string"), F.col("l_linenumber") - 1)
    return a.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", names.alias("n")).select(
        "l_orderkey", "l_linenumber", "n.*"
    )


@query("SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_') AS safe FROM documents")
def scl_13_safe_target(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", scalars.safe_target(F.col("text")).alias("safe"))


@query(
    f"""WITH r AS ({a.RUNS_SQL})
    SELECT run_id, trim(regexp_replace(coalesce(handle, shortcode, keyword), '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || endpoint
      || CASE WHEN start_date IS NOT NULL THEN '_' || start_date || '_' || end_date ELSE '' END || '.json' AS file_name
    FROM r WHERE coalesce(handle, shortcode, keyword) IS NOT NULL"""
)
def scl_14_result_file_name(spark, sf):
    q = F.col("query")
    target = F.coalesce(q["handle"], q["shortcode"], q["keyword"])
    name = scalars.result_file_name(target, F.col("endpoint"), q["start_date"], q["end_date"])
    return a.runs(spark, sf).where(target.isNotNull()).select("run_id", name.alias("file_name"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'a.b' || doc_id WHEN 4 THEN 'noext' || doc_id ELSE source || '.v1_' || doc_id END AS stem FROM documents"""
)
def scl_15_input_stem(spark, sf):
    d, source = F.col("doc_id"), F.col("source")
    name = F.concat(source, F.lit(".v1_"), d)
    path = (
        F.when(d % 5 == 0, F.concat(F.lit("/in/"), name, F.lit(".json.gz")))
        .when(d % 5 == 1, F.concat(F.lit("s3://b/x.json/"), name, F.lit(".ndjson")))
        .when(d % 5 == 2, F.concat(name, F.lit(".jsonl.gz")))
        .when(d % 5 == 3, F.concat(F.lit("a.b"), d, F.lit(".txt")))
        .otherwise(F.concat(F.lit("/in/noext"), d))
    )
    return a.table(spark, sf, "documents").select("doc_id", scalars.input_stem(path).alias("stem"))


@query(
    """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS unix_s, epoch_us(ts)::BIGINT AS iso_us, epoch_us(ts)::BIGINT AS iso_zone_us FROM events"""
)
def scl_16_timestamps(spark, sf):
    text = F.col("ts").cast("string")
    seconds = F.unix_seconds(F.to_timestamp(F.concat(text, F.lit("Z"))))
    return a.table(spark, sf, "events").select(
        "event_id",
        F.unix_seconds(scalars.unix_to_timestamp(seconds)).alias("unix_s"),
        F.unix_micros(scalars.from_iso(text)).alias("iso_us"),
        F.unix_micros(scalars.from_iso(F.concat(text, F.lit("+05:00")))).alias("iso_zone_us"),
    )


_CATEGORY = """CASE WHEN k % 15 < 7 THEN 'success' WHEN k % 15 < 11 THEN 'retry' WHEN k % 15 < 13 THEN 'crash'
  WHEN k % 15 = 13 THEN 'partial' ELSE 'unknown' END"""


@query(f"WITH r AS ({a.RUNS_SQL}) SELECT run_id, result, {_CATEGORY} AS category FROM r")
def scl_17_result_category(spark, sf):
    return a.runs(spark, sf).select("run_id", "result", scalars.result_category(F.col("result")).alias("category"))


@query(
    f"""WITH s AS ({a.STORED_SQL})
    SELECT page_id, endpoint, CASE
      WHEN endpoint = 'UserTimeline' THEN CASE
        WHEN page_id % 9 = 0 THEN 'profile is not available' WHEN page_id % 9 = 1 THEN 'no posts' WHEN page_id % 9 = 2 THEN 'account is private'
        WHEN page_id % 9 = 4 AND on_target AND known_private THEN 'account is private' WHEN page_id % 9 = 4 AND on_target THEN 'failed to load'
        WHEN NOT has_feed AND known_private THEN 'account is private' WHEN NOT has_feed AND page_id % 9 = 5 THEN 'no posts' END
      WHEN endpoint = 'PostByShortcode' AND page_id % 9 = 1 THEN 'profile is not available' END AS code
    FROM s"""
)
def scl_18_page_text_state(spark, sf):
    stored = a.derive(spark, sf, a.STORED_SQL, "pages")
    state = scalars.page_text_state(
        F.concat("html", "phrase"), F.col("endpoint"), F.col("on_target"), F.col("known_private"), F.col("has_feed")
    )
    return stored.select("page_id", "endpoint", state.alias("code"))


# ---- manifests --------------------------------------------------------------
@query(a.MANIFESTS_DUCK + "SELECT l_orderkey, l_linenumber, url_a, video_url FROM best")
def top_1_best_video(spark, sf):
    reps = representations(parse_manifest(F.col("xml")))
    return a.manifests(spark, sf).withColumn("r", reps).select(
        "l_orderkey", "l_linenumber", "url_a", best_video(F.col("r")).alias("video_url")
    )


@query(a.MANIFESTS_DUCK + "SELECT l_orderkey, l_linenumber, url_a, audio_url FROM best")
def top_2_audio_track(spark, sf):
    reps = representations(parse_manifest(F.col("xml")))
    return a.manifests(spark, sf).withColumn("r", reps).select(
        "l_orderkey", "l_linenumber", "url_a", audio_track(F.col("r")).alias("audio_url")
    )


@query(RESOLVED + f"SELECT d, CASE WHEN d % 8 NOT IN (1, 2, 3) THEN {a.IMG} END AS image_url FROM m")
def top_3_best_image(spark, sf):
    own = F.from_json("raw", "image_versions2 STRING")["image_versions2"]
    return _resolved(spark, sf).select("d", best_image(own).alias("image_url"))


@query(
    a.MANIFESTS_DUCK
    + """SELECT l_orderkey, l_linenumber, url_a, CASE WHEN broken THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(
      [url_a, url_b, audio, CASE WHEN audio IS NOT NULL THEN 'https://v.example/first-audio' END], lambda x: x IS NOT NULL))), ' ') END AS urls FROM best"""
)
def set_3_distinct_base_urls(spark, sf):
    urls = distinct_base_urls(F.col("m"))
    return a.manifests(spark, sf).withColumn("m", parse_manifest(F.col("xml"))).select(
        "l_orderkey", "l_linenumber", "url_a", F.coalesce(F.array_join(urls, " "), F.lit("")).alias("urls")
    )


# ---- assets -----------------------------------------------------------------
_VIDEO = "'https://vid.example/' || d || '?a=1&b=2'"
_LOW = "'https://vid.example/low/' || d"
_SLIDE = "'https://vid.example/s/' || d"
_AUDIO = "CASE WHEN d % 2 = 0 THEN 'https://aud.example/' || d END"
PAIRS_DUCK = f"""
pairs AS (
  SELECT d, id AS post_id, 0 AS idx, {_VIDEO} AS video_url, {_AUDIO} AS audio_url FROM m WHERE d % 5 = 1
  UNION ALL
  SELECT d, id AS post_id, CASE WHEN d % 5 = 1 THEN 2 ELSE 1 END AS idx, {_SLIDE} AS video_url, NULL AS audio_url FROM m WHERE slides >= 3
)"""
IMAGES_DUCK = f"""
images AS (
  SELECT d, id AS post_id, 0 AS pos, {a.IMG} AS image_url, '{{0}}' AS x FROM m WHERE d % 8 NOT IN (1, 2, 3)
  UNION ALL
  SELECT d, id AS post_id, CASE WHEN d % 8 NOT IN (1, 2, 3) THEN 1 ELSE 0 END AS pos, 'https://img.example/s1/' || d || '.heic' AS image_url, '' AS x
  FROM m WHERE slides >= 1
)"""
PICS_DUCK = f"""
all_pics AS (
  SELECT d, 0 AS o, username AS handle, {a.PIC} AS url FROM m WHERE {USER_GIVEN} AND d % 5 <> 4
  UNION ALL SELECT d, 1, 'L' || (d % 7), 'https://pic.example/l' FROM m WHERE d % 4 = 2
  UNION ALL SELECT d, 2, coalesce(username, '8'), 'https://pic.example/again' FROM m WHERE d % 4 = 2
  UNION ALL SELECT d, 3, CASE WHEN d % 4 = 3 THEN username ELSE 'owner' || (d % 50) END, 'https://pic.example/o/' || d FROM m
),
pics AS (
  SELECT d, o, handle, url AS profile_pic_url FROM (
    SELECT *, row_number() OVER (PARTITION BY d, handle ORDER BY o) AS rn FROM all_pics WHERE handle IS NOT NULL) z WHERE rn = 1
)"""


@query(RESOLVED + f", {PAIRS_DUCK} SELECT d, post_id, idx, video_url, audio_url FROM pairs")
def gen_1_video_audio_pairs(spark, sf):
    return ff.video_audio_pairs(_resolved(spark, sf), keep=("d",))


@query(
    RESOLVED
    + f""", v AS (
      SELECT d, id AS post_id, unnest(list_filter([{_VIDEO}, {_LOW}, {_AUDIO}], lambda x: x IS NOT NULL)) AS video_url FROM m WHERE d % 5 = 1
      UNION ALL SELECT d, id, {_SLIDE} FROM m WHERE slides >= 2
      UNION ALL SELECT d, id, unnest([{_SLIDE}, {_LOW}]) FROM m WHERE slides >= 3)
    SELECT d, post_id, video_url FROM v"""
)
def gen_2_video_urls(spark, sf):
    return ff.video_urls(_resolved(spark, sf), keep=("d",))


@query(RESOLVED + f", {IMAGES_DUCK} SELECT d, post_id, pos, image_url FROM images")
def gen_3_image_urls(spark, sf):
    return ff.image_urls(_resolved(spark, sf), keep=("d",))


@query(RESOLVED + f", {PICS_DUCK} SELECT d, handle, profile_pic_url FROM pics")
def gen_4_post_profile_pics(spark, sf):
    return ff.post_profile_pics(_resolved(spark, sf), keep=("d",)).drop("pos")


USER_PICS_DUCK = f"""
SELECT username AS handle, profile_pic_url FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY CAST(substr(run_id, 2) AS BIGINT), pos) AS rn
  FROM ({a.USERS_DUCK}) u WHERE profile_pic_url IS NOT NULL) z WHERE rn = 1
"""


def _user_rows(spark, sf):
    return ff.typed_users(a.users(spark, sf)).withColumn("run_no", F.substring("run_id", 2, 20).cast("bigint"))


@query(USER_PICS_DUCK)
def gen_5_user_profile_pics(spark, sf):
    return ff.user_profile_pics(_user_rows(spark, sf), ("run_no", "pos"))


@query(
    RESOLVED
    + f""", {PICS_DUCK}, both_pics AS (
      SELECT 0 AS src, d AS a, o AS b, handle, profile_pic_url FROM pics
      UNION ALL SELECT 1, 0, 0, handle, profile_pic_url FROM ({USER_PICS_DUCK}) u),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY src, a, b) AS rn FROM both_pics)
    SELECT handle, profile_pic_url FROM ranked WHERE rn = 1"""
)
def agg_2_dedup_profile_pics(spark, sf):
    users = _user_rows(spark, sf)
    return ff.assets(_resolved(spark, sf), users, ("d",), ("run_no",)).profile_pics


@query(
    RESOLVED
    + f""", {PICS_DUCK}, {IMAGES_DUCK}, both_pics AS (
      SELECT 0 AS src, d AS a, o AS b, handle, profile_pic_url FROM pics
      UNION ALL SELECT 1, 0, 0, handle, profile_pic_url FROM ({USER_PICS_DUCK}) u),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY src, a, b) AS rn FROM both_pics),
    v AS (
      SELECT id AS post_id, unnest(list_filter([{_VIDEO}, {_LOW}, {_AUDIO}], lambda x: x IS NOT NULL)) AS video_url FROM m WHERE d % 5 = 1
      UNION ALL SELECT id, {_SLIDE} FROM m WHERE slides >= 2
      UNION ALL SELECT id, unnest([{_SLIDE}, {_LOW}]) FROM m WHERE slides >= 3)
    SELECT 'image' AS kind, post_id AS owner, image_url AS url FROM images
    UNION ALL SELECT 'video', post_id, video_url FROM v
    UNION ALL SELECT 'picture', handle, profile_pic_url FROM ranked WHERE rn = 1"""
)
def gen_6_assets(spark, sf):
    videos, images, pics = ff.assets(_resolved(spark, sf), _user_rows(spark, sf), ("d",), ("run_no",))
    return (
        images.select(F.lit("image").alias("kind"), F.col("post_id").alias("owner"), F.col("image_url").alias("url"))
        .unionByName(videos.select(F.lit("video").alias("kind"), F.col("post_id").alias("owner"), F.col("video_url").alias("url")))
        .unionByName(pics.select(F.lit("picture").alias("kind"), F.col("handle").alias("owner"), F.col("profile_pic_url").alias("url")))
    )


@query(
    RESOLVED
    + f""", {PICS_DUCK}
    SELECT 0 AS source, d, handle, profile_pic_url FROM pics
    UNION ALL SELECT 1, CAST(substr(run_id, 2) AS BIGINT), username, profile_pic_url FROM ({a.USERS_DUCK}) u WHERE profile_pic_url IS NOT NULL"""
)
def set_2_union_assets(spark, sf):
    both = union_pics(_resolved(spark, sf), _user_rows(spark, sf), ("d",), ("run_no",))
    return both.select(F.col("_order.source").alias("source"), F.col("_order.o0").alias("d"), "handle", "profile_pic_url")


_IMAGE_NAME = """post_id || '_' || CASE WHEN image_url LIKE '%s1/%' THEN CAST(d AS VARCHAR)
  WHEN d % 4 = 2 THEN d || '?s=1' ELSE CAST(d AS VARCHAR) END || '.png'"""


@query(
    RESOLVED
    + f""", {PICS_DUCK}, {IMAGES_DUCK}
    SELECT image_url AS url, {_IMAGE_NAME} AS name FROM images
    UNION ALL SELECT profile_pic_url, handle || '.png' FROM pics
    UNION ALL SELECT profile_pic_url, handle || '.png' FROM ({USER_PICS_DUCK}) u"""
)
def gen_7_image_plan(spark, sf):
    users = _user_rows(spark, sf).drop("run_id")
    return ff.image_plan(_resolved(spark, sf), include_profile_pics=True, users=users, user_order=("run_no", "pos"))


def _saved(merge: bool, keep: bool) -> str:
    video, audio, merged = "base || '_video.mp4'", "base || '_audio.mp4'", "base || '.mp4'"
    both = f"{video} || ' ' || {audio}"
    with_audio = both if not merge else (f"{merged} || ' ' || {both}" if keep else merged)
    return f"CASE WHEN audio_url IS NOT NULL THEN {with_audio} ELSE {video} END"


def _video_plan_query(name, merge, keep):
    def run(spark, sf):
        plan = ff.video_plan(_resolved(spark, sf), merge=merge, keep_streams=keep)
        return plan.withColumn("saved", F.array_join("saved", " "))

    run.__name__ = name
    query(
        RESOLVED
        + f""", {PAIRS_DUCK}, named AS (SELECT *, post_id || CASE WHEN idx > 0 THEN '_' || idx ELSE '' END AS base FROM pairs)
        SELECT post_id, idx, video_url, audio_url, base || '_video.mp4' AS video_name,
          CASE WHEN audio_url IS NOT NULL THEN base || '_audio.mp4' END AS audio_name, base || '.mp4' AS merged_name,
          {_saved(merge, keep)} AS saved FROM named"""
    )(run)


_video_plan_query("gen_7_video_plan", False, False)
_video_plan_query("gen_7_video_plan_merged", True, False)
_video_plan_query("gen_7_video_plan_merged_kept", True, True)


# ---- stored pages -----------------------------------------------------------
# The links to posts that the adapter put into each page, in their order.
_LINKS = """
WITH l AS (SELECT page_id, list_filter(['/p/A' || page_id || '/', '/some.one/reel/B-' || page_id || '/', CASE WHEN page_id % 3 = 0 THEN '/reel/D' || page_id END,
  '/p/U' || page_id || '/', '/p/Q' || page_id || '/?x=1&y=2'], lambda x: x IS NOT NULL) AS links FROM pages)
"""


def _stored(spark, sf):
    return a.derive(spark, sf, a.STORED_SQL, "pages").select("page_id", F.col("page_html").alias("html"))


@query(_LINKS + "SELECT page_id, generate_subscripts(links, 1) AS place, unnest(links) AS href FROM l")
def gen_8_post_links(spark, sf):
    links = ff.post_links(_stored(spark, sf))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("bigint")
    return links.select("page_id", place.alias("place"), "href")


@query(_LINKS + "SELECT page_id, links[-1] AS href FROM l")
def top_4_lowest_post_link(spark, sf):
    from feedframe.operators.assets import hrefs, lowest_post_link

    return _stored(spark, sf).select("page_id", lowest_post_link(hrefs(F.col("html"))).alias("href"))
