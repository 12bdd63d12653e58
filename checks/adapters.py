"""Record shapes built from the driver tables.

Each adapter has two halves. The *derivation* is SQL text that both Spark and DuckDB
understand: columns computed from a driver table, one row per record. On the Spark side
the derived columns are then written into JSON (or XML) text, so that the engine's own
parsers run over it. The oracle starts from the same derived columns and says directly
what the engine should find.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedframe.functions.once import computed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a driver table that one task makes text of, about.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table over enough tasks for the text that is made of them, much larger than they are.

    Splits of a Parquet file go by bytes, its rows by row groups: of a file of many splits
    one task may get all rows. What tasks get is counted, which reads no column. Tables
    that the files themselves spread well stay as read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    tasks, most, total = dealt[0], dealt[1] or 0, dealt[2] or 0
    if tasks * 2 > cores and most <= TASK_ROWS:
        return rows
    # By a number of each row: dealing rows out in turn would sort them all first.
    numbered = rows.withColumn("_row_number", F.monotonically_increasing_id())
    return numbered.repartition(max(cores, -(-total // TASK_ROWS)), "_row_number").drop("_row_number")


def derive(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a derivation over driver tables, the first of them spread. Spark reads them from ``sf_dir``."""
    frames = {n: table(spark, sf_dir, n) for n in tables}
    frames[tables[0]] = spread(frames[tables[0]])
    for n in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **frames)


# ---- JSON text -------------------------------------------------------------
def js(value: Column) -> Column:
    """JSON string of a text column, ``null`` for null."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )


def jq(value: Column) -> Column:
    """JSON string of a column that has no characters to escape, ``null`` for null."""
    return F.coalesce(F.concat(F.lit('"'), value.cast("string"), F.lit('"')), F.lit("null"))


def jn(value: Column) -> Column:
    """JSON number or boolean of a column, ``null`` for null."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def _part(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def jo(**fields) -> Column:
    """JSON object; the values are JSON text, as columns or literals. A field whose text
    is SQL null is left out."""
    parts = [F.concat(F.lit(f'"{k.rstrip("_")}":'), _part(v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def jkey(key: str, value) -> Column:
    return F.concat(F.lit(f'{{"{key}":'), _part(value), F.lit("}"))


def ja(*items) -> Column:
    """JSON array; items that are SQL null are left out."""
    return F.concat(F.lit("["), F.concat_ws(",", *[_part(i) for i in items]), F.lit("]"))


def nulled(condition: Column, value) -> Column:
    """JSON ``null`` where the condition holds, else the value."""
    return F.when(condition, F.lit("null")).otherwise(_part(value))


# ---- A1: posts out of documents and labels ---------------------------------
POSTS_SQL = """
SELECT d.doc_id AS d, d.text AS text, d.lang AS lang, d.source AS source, d.n_chars AS n_chars,
  l.quality AS quality, l.toxic AS toxic,
  CAST(floor(d.doc_id / 4) AS BIGINT) AS g,
  CASE WHEN d.doc_id % 10 = 0 THEN 'XDTFeedItem' WHEN d.doc_id % 10 = 9 THEN 'XDTPromoUnit'
       ELSE 'XDTMediaDict' END AS typename,
  CASE WHEN d.doc_id % 11 = 3 THEN NULL WHEN d.doc_id % 11 = 4 THEN ''
       ELSE CAST(d.doc_id AS STRING) END AS pk,
  CAST(d.doc_id AS STRING) || '_' || d.source AS id,
  CASE WHEN d.doc_id % 13 = 5 THEN NULL ELSE 'c' || CAST(d.doc_id AS STRING) END AS code,
  CASE WHEN d.doc_id % 3 = 0 THEN 'clips' ELSE 'feed' END AS product_type,
  CASE WHEN d.doc_id % 5 = 0 THEN '1' WHEN d.doc_id % 5 = 1 THEN '2' WHEN d.doc_id % 5 = 2 THEN '8'
       WHEN d.doc_id % 5 = 3 THEN '4' END AS media_type,
  CASE WHEN d.doc_id % 17 = 7 THEN NULL
       ELSE 1704067200 + d.doc_id * 3600 + (d.doc_id % 4) * 86400 END AS taken_at,
  d.doc_id % 7 AS caption_form,
  1704067200 + d.doc_id * 3600 + 60 AS created_at,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL
       WHEN d.doc_id % 3 = 1 THEN 'Handle' || CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING)
       ELSE d.source END AS username,
  'u' || CAST(d.doc_id % 97 AS STRING) AS user_pk,
  CASE WHEN d.doc_id % 8 < 6 THEN 'own' || CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING)
       ELSE 'x' || CAST(d.doc_id AS STRING) END AS owner_key,
  d.doc_id % 3 AS owner_form,
  d.doc_id % 4 AS slides,
  CASE WHEN d.doc_id % 4 = 0 THEN '.jpg' WHEN d.doc_id % 4 = 1 THEN '.webp'
       WHEN d.doc_id % 4 = 2 THEN '' ELSE '.png' END AS extension
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

# Derived text columns that Spark writes into the JSON and the oracle expects back.
IMG = "'https://img.example/a/' || CAST(d AS STRING) || extension || '?s=1'"
PIC = "'https://pic.example/' || CAST(d AS STRING)"


_MANIFEST = (
    '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet mimeType="video/mp4">%s'
    "</AdaptationSet><AdaptationSet>%s</AdaptationSet></Period></MPD>"
)
_VIDEO_REP = '<Representation bandwidth="%s"><BaseURL>%s</BaseURL></Representation>'
_AUDIO_REP = '<Representation bandwidth="64" mimeType="audio/mp4"><BaseURL>%s</BaseURL></Representation>'


def jstruct(*fields: Column) -> Column:
    """JSON object of typed columns, nulls written out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def joined(obj: Column, **fields) -> Column:
    """A JSON object with further fields, whose values are JSON text."""
    parts = [F.concat(F.lit(f'"{k}":'), _part(v)) for k, v in fields.items()]
    return F.concat(F.substring(obj, F.lit(1), F.length(obj) - 1), F.lit(","), F.concat_ws(",", *parts), F.lit("}"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns of A1 with ``raw``, the JSON text of the post node."""
    c, lit, fmt = F.col, F.lit, F.format_string
    d = c("d")
    p = derive(spark, sf_dir, POSTS_SQL, "documents", "labels")

    low = fmt(_VIDEO_REP, lit("900"), fmt("https://vid.example/low/%d", d))
    video = fmt(_VIDEO_REP, lit("12000"), fmt("https://vid.example/%d?a=1&amp;b=2", d))
    slide_video = fmt("https://vid.example/s/%d", d)
    audio = F.when(d % 2 == 0, fmt(_AUDIO_REP, fmt("https://aud.example/%d", d))).otherwise("")
    own_manifest = F.when(d % 5 == 1, fmt(_MANIFEST, F.concat(low, video), audio))

    # Typed columns write themselves; only fields whose JSON shape varies are text.
    picture = F.when(d % 5 != 4, F.struct(F.expr(PIC).alias("url")))
    user = F.when(
        d % 12 != 0,
        F.struct(
            c("username"),
            c("user_pk").alias("pk"),
            F.concat_ws(" ", "source", "lang").alias("full_name"),
            (d % 2 == 0).alias("is_verified"),
            lit(False).alias("is_private"),
            picture.alias("hd_profile_pic_url_info"),
        ),
    )
    owner = F.struct(
        F.when(d % 2 == 0, c("user_pk")).otherwise(fmt("o%d", d)).alias("id"),
        F.when(d % 4 == 3, c("username")).otherwise(fmt("owner%d", d % 50)).alias("username"),
        fmt("https://pic.example/o/%d", d).alias("profile_pic_url"),
    )
    name = lambda column: F.struct(column.alias("username"))
    coauthors = F.when(c("lang") == "en", F.array(name(lit("en")), lit(None), name(c("source"))))
    tag = lambda column: F.struct(column.alias("user"))
    tags = F.when(
        d % 5 == 0,
        F.struct(F.array(tag(name(c("source"))), tag(lit(None)), tag(name(c("lang")))).alias("in")),
    )
    liker = lambda n, i, u: F.struct(n.alias("username"), i.alias("id"), lit(u).alias("profile_pic_url"))
    likers = F.when(
        d % 4 == 2,
        F.array(
            liker(lit(""), fmt("L%d", d % 7), "https://pic.example/l"),
            liker(lit("nopic"), lit("9"), ""),
            liker(c("username"), lit("8"), "https://pic.example/again"),
        ),
    )
    typed = jstruct(
        F.when(c("typename") == "XDTFeedItem", "XDTMediaDict").otherwise(c("typename")).alias("__typename"),
        "pk",
        "id",
        "code",
        c("media_type").cast("int").alias("media_type"),
        "product_type",
        "taken_at",
        (d % 2 == 1).alias("caption_is_edited"),
        c("lang").alias("title"),
        lit(None).cast("string").alias("headline"),
        c("source").alias("accessibility_caption"),
        c("n_chars").alias("like_count"),
        c("quality").alias("comment_count"),
        (d * 3).alias("view_count"),
        lit(None).cast("int").alias("play_count"),
        (d % 5).alias("fb_like_count"),
        c("toxic").alias("media_repost_count"),
        (c("quality") == 1).alias("comments_disabled"),
        lit(False).alias("like_and_view_counts_disabled"),
        own_manifest.alias("video_dash_manifest"),
        c("slides").alias("carousel_media_count"),
        (d % 3 == 0).alias("has_audio"),
        lit(1).alias("is_dash_eligible"),
        lit(1080).alias("original_width"),
        (d % 1000 + 1).alias("original_height"),
        user.alias("user"),
        owner.alias("owner"),
        coauthors.alias("coauthor_producers"),
        tags.alias("usertags"),
        (d % 20 == 0).alias("is_paid_partnership"),
        likers.alias("facepile_top_likers"),
    )
    created = (
        F.when(c("caption_form") == 1, ',"created_at":null')
        .when(c("caption_form") == 2, "")
        .when(c("caption_form") == 3, fmt(',"created_at":"%d"', c("created_at")))
        .otherwise(fmt(',"created_at":%d', c("created_at")))
    )
    caption = nulled(c("caption_form") == 0, F.concat(lit('{"text":'), js(c("text")), created, lit("}")))
    image = (
        F.when(d % 8 == 1, "{ }")
        .when(d % 8 == 2, "null")
        .when(d % 8 == 3, '{"candidates":[]}')
        .otherwise(fmt('{"candidates":[{"url":"%s","width":1080},{"url":"https://img.example/small.jpg"}]}', F.expr(IMG)))
    )
    escaped = lambda xml: F.replace(xml, lit('"'), lit('\\"'))
    # The second slide has audio only: it counts as a video, but none comes of it.
    slides = [
        fmt('{"image_versions2":{"candidates":[{"url":"https://img.example/s1/%d.heic"}]}}', d),
        fmt('{"image_versions2":{},"video_dash_manifest":"%s"}', escaped(fmt(_MANIFEST, lit(""), fmt(_AUDIO_REP, slide_video)))),
        fmt(
            '{"image_versions2":null,"video_dash_manifest":"%s"}',
            escaped(fmt(_MANIFEST, F.concat(fmt(_VIDEO_REP, lit("12000"), slide_video), low), lit(""))),
        ),
    ]
    carousel = nulled(c("slides") == 0, ja(*[F.when(c("slides") > n, s) for n, s in enumerate(slides)]))
    owner_id = (
        F.when(d % 19 == 0, "null")
        .when(c("owner_form") == 0, fmt('{"pk":"%s","id":"%s"}', "owner_key", "owner_key"))
        .when(c("owner_form") == 1, fmt('"%s"', "owner_key"))
        .otherwise(fmt('{"pk":"p%d","id":"%s"}', d, "owner_key"))
    )
    location = (
        F.when(d % 9 == 0, "null")
        .when(d % 9 == 1, '"somewhere"')
        .otherwise(fmt('{"name":"%s-town","pk":%d,"lat":%d.5,"lng":%s}', "lang", d % 31, d % 90, (d % 180).cast("double") - 0.25))
    )
    clips = (
        F.when(d % 6 == 0, "null")
        .when(d % 6 == 1, fmt('{"original_sound_info":{"original_audio_title":"%s"}}', "lang"))
        .when(d % 6 == 2, fmt('{"music_info":{"music_asset_info":{"title":"%s","display_artist":"%s"}}}', "source", "lang"))
        .when(d % 6 == 3, fmt('{"music_info":{"music_asset_info":{"title":"%s","display_artist":""}}}', "source"))
        .otherwise("{}")
    )
    media = joined(
        typed,
        caption=caption,
        image_versions2=image,
        carousel_media=carousel,
        owner_id=owner_id,
        location=location,
        clips_metadata=clips,
    )
    feed_item = c("typename") == "XDTFeedItem"
    raw = (
        F.when(feed_item & (d % 70 == 0), '{"__typename":"XDTFeedItem","media":null}')
        .when(feed_item, F.concat(lit('{"__typename":"XDTFeedItem","media":'), c("_media"), lit("}")))
        .otherwise(c("_media"))
    )
    return computed(computed(p, _media=media), raw=raw, pos=d).drop("_media")


# Derived columns of the resolved media, for oracles: wrapped nodes with a media and
# plain media nodes.
RESOLVED_SQL = f"""
WITH p AS ({POSTS_SQL}),
m AS (SELECT * FROM p WHERE typename = 'XDTMediaDict' OR (typename = 'XDTFeedItem' AND d % 70 <> 0))
"""

# Timeline runs over A1: one run per group of four posts, named by the group.
POST_RUNS_SQL = """
SELECT CAST(floor(doc_id / 4) AS BIGINT) AS g,
  'g' || CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) AS run_id,
  CASE WHEN CAST(floor(doc_id / 4) AS BIGINT) % 5 = 4 THEN 'Search' ELSE 'UserTimeline' END AS endpoint,
  CASE WHEN CAST(floor(doc_id / 4) AS BIGINT) % 7 = 3 THEN 'no posts'
       WHEN CAST(floor(doc_id / 4) AS BIGINT) % 7 = 4 THEN 'response_shape_error'
       WHEN CAST(floor(doc_id / 4) AS BIGINT) % 7 = 5 THEN 'failed to load'
       ELSE 'scraped until first ever post was reached' END AS result,
  'HANDLE' || CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) AS handle,
  CAST(floor(min(doc_id) / 24) AS BIGINT) AS first_day
FROM documents
GROUP BY CAST(floor(doc_id / 4) AS BIGINT)
"""


def post_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose posts are A1, with dates of three days from the day of the first post."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("first_day").cast("int"))
    dates = {"start_date": start.cast("string"), "end_date": F.date_add(start, 2).cast("string")}
    query = F.create_map(F.lit("handle"), F.col("handle"), *[x for k, v in dates.items() for x in (F.lit(k), v)])
    return derive(spark, sf_dir, POST_RUNS_SQL, "documents").select(
        "run_id",
        "endpoint",
        query.alias("query"),
        "result",
        F.lit("2024-02-01 10:00:00").cast("timestamp").alias("time_started"),
        F.concat(F.lit("0:00:"), F.lpad((F.col("g") % 60).cast("string"), 2, "0")).alias("time_taken"),
        "g",
    )


def run_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 as posts of those runs: ``run_id, page_seq, payload_idx, pos, raw``."""
    return posts(spark, sf_dir).select(
        F.concat(F.lit("g"), F.col("g").cast("string")).alias("run_id"),
        F.col("d").alias("page_seq"),
        F.lit(0).alias("payload_idx"),
        "pos",
        "raw",
        "d",
    )


def run_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User records of those runs: the handle's own, except in every third run, and one more."""
    g = F.col("g")
    own = jo(
        username=js(F.concat(F.lit("handle"), g.cast("string"))),
        id=js(F.concat(F.lit("own"), g.cast("string"))),
        pk=jn(g),
        is_private=jn(g % 4 == 0),
    )
    other = jo(username='"somebody"', id=js(F.concat(F.lit("x"), (g * 4 + 6).cast("string"))), is_private="true")
    runs = derive(spark, sf_dir, POST_RUNS_SQL, "documents")
    return runs.select(
        "run_id", F.posexplode(F.filter(F.array(F.when(g % 3 != 0, own), other), lambda r: r.isNotNull())).alias("pos", "raw")
    )


# ---- A2: page log out of events --------------------------------------------
PAGES_SQL = """
SELECT event_id, user_id, k,
  'u' || CAST(user_id AS STRING) AS run_id,
  event_id AS page_seq,
  CASE WHEN user_id % 3 = 0 THEN 'Search' ELSE 'UserTimeline' END AS endpoint,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1701388800 + (user_id % 20) * 86400 END AS start_unix,
  CASE WHEN user_id % 2 = 0 THEN 'seed' || CAST(user_id AS STRING) END AS cursor_sent,
  CASE WHEN k % 7 = 6 THEN 'document' ELSE 'xhr' END AS resource_type,
  CASE WHEN k % 5 = 0 THEN 'https://www.instagram.com/graphql/query/?n=' || CAST(k AS STRING)
       WHEN k % 5 = 1 THEN 'https://www.instagram.com/api/v1/feed/' || CAST(k AS STRING)
       WHEN k % 5 = 2 THEN 'https://www.instagram.com/static/' || CAST(k AS STRING)
       ELSE 'https://www.instagram.com/api/graphql' END AS url,
  CASE WHEN k % 29 = 7 THEN 'timeout' END AS transport_error,
  k % 43 <> 0 AND k % 29 <> 7 AS connected,
  CASE WHEN k % 29 = 7 OR k % 43 = 0 OR k % 37 = 0 THEN NULL ELSE 'c' || CAST(event_id AS STRING) END AS end_cursor,
  k % 29 <> 7 AND k % 43 <> 0 AND k % 41 <> 0 AS has_next,
  CASE WHEN event_type = 'error' AND k % 29 <> 7 THEN
    CASE WHEN k = 63 THEN 'Please wait a few minutes before you try again.' ELSE 'side fragment ' || CAST(k AS STRING) END
  END AS message,
  event_type = 'error' AND k = 63 AS rate_limited,
  CASE WHEN k % 10 = 5 OR k % 43 = 0 OR k % 29 = 7 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 60 END AS id0,
  CASE WHEN k % 10 = 5 OR k % 43 = 0 OR k % 29 = 7 THEN NULL ELSE (CAST(floor(value) AS BIGINT) + k) % 60 END AS id1,
  CASE WHEN k % 47 = 0 THEN NULL ELSE 1704067200 + event_id * 60 - k * 86400 END AS taken_at
FROM (SELECT event_id, user_id, event_type, value, CAST({k} AS BIGINT) AS k FROM events) e
"""
K_SPARK = "get_json_object(props, '$.k')"
K_DUCK = "json_extract(props, '$.k')"
PAGES_DUCK = PAGES_SQL.format(k=K_DUCK)

FEED = "xdt_api__v1__feed__user_timeline_graphql_connection"
SERP = "xdt_fbsearch__top_serp_graphql"


def _post(id_: Column, taken_at: Column) -> Column:
    # A nested page info, which must not be taken for the page's own.
    deep = jkey("page_info", '{"end_cursor":"nested","has_next_page":true}')
    return jo(__typename='"XDTMediaDict"', pk=jq(id_), taken_at=jn(taken_at), clips_stream=deep)


def page_bodies(e: DataFrame, post=_post) -> DataFrame:
    """A2 page log with bodies, out of the derived columns (batch or stream)."""
    c = F.col
    info = jo(end_cursor=jq(c("end_cursor")), has_next_page=jn(c("has_next")))
    nodes = [c("_node0"), c("_node1")]
    e = computed(e, _node0=post(c("id0"), c("taken_at")), _node1=post(c("id1"), c("taken_at")))
    feed_edges = F.when(c("id0").isNull(), F.lit("[]")).otherwise(ja(*[jkey("node", n) for n in nodes]))
    feed = jkey(FEED, nulled(~c("connected"), jo(edges=feed_edges, page_info=info)))
    grid = jkey("node", jo(__typename='"XDTTopSerpMediaGridUnit"', items=F.when(c("id0").isNull(), F.lit("[]")).otherwise(ja(*nodes))))
    other = jkey("node", jo(__typename='"XDTTopSerpAccountsUnit"', items=ja(nodes[0])))
    serp = jkey(SERP, nulled(~c("connected"), jo(edges=ja(other, grid), page_info=info)))
    data = F.when(c("endpoint") == "Search", serp).otherwise(feed)
    errors = F.when(c("message").isNotNull(), ja(jkey("message", js(c("message"))), '{"message":"second"}'))
    body = F.when(c("transport_error").isNull(), jo(data=data, errors=errors))
    return computed(e, body=body).select(
        "run_id", "page_seq", "url", "resource_type", "cursor_sent", "endpoint", "start_unix", "transport_error", "body"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_bodies(derive(spark, sf_dir, PAGES_SQL.format(k=K_SPARK), "events"))


# What the engine should know of each page, for oracles.
PAGE_STATE_DUCK = f"""
WITH e AS ({PAGES_DUCK}),
arrivals AS (
  SELECT run_id, page_seq, pid, taken_at, pos,
    row_number() OVER (PARTITION BY run_id, pid ORDER BY page_seq, pos) AS rn
  FROM (
    SELECT run_id, page_seq, id0 AS pid, taken_at, 0 AS pos FROM e WHERE id0 IS NOT NULL AND NOT rate_limited
    UNION ALL
    SELECT run_id, page_seq, id1 AS pid, taken_at, 1 AS pos FROM e WHERE id1 IS NOT NULL AND NOT rate_limited
  ) a
),
stats AS (
  SELECT run_id, page_seq, count(*) AS new_count, count(taken_at) AS timestamped_count, min(taken_at) AS oldest
  FROM arrivals WHERE rn = 1 GROUP BY run_id, page_seq
),
facts AS (
  SELECT e.*, coalesce(transport_error, message || '; second') AS error,
    coalesce(new_count, 0) AS new_count, coalesce(timestamped_count, 0) AS timestamped_count, oldest,
    row_number() OVER (PARTITION BY e.run_id ORDER BY e.page_seq) - 1 AS iter_index
  FROM e LEFT JOIN stats s ON e.run_id = s.run_id AND e.page_seq = s.page_seq
),
states AS (
  SELECT run_id, page_seq, endpoint, start_unix, end_cursor, has_next, error, connected, iter_index,
    new_count, timestamped_count, oldest,
    CASE WHEN iter_index = 0 THEN cursor_sent ELSE lag(end_cursor) OVER w END AS sent,
    CAST(sum(new_count) OVER w AS BIGINT) AS all_count,
    iter_index - coalesce(max(CASE WHEN new_count > 0 THEN iter_index END) OVER w, -1) AS streak
  FROM facts
  WINDOW w AS (PARTITION BY run_id ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
"""
# Caps low enough for every rule to fire.
CAPS = {"post_cap": 40, "page_cap": 25, "no_progress": 3}
RULES_DUCK = {
    "unusable_error": "CASE WHEN error IS NOT NULL AND (NOT connected OR (has_next AND (end_cursor IS NULL OR end_cursor IS NOT DISTINCT FROM sent))) THEN 'something went wrong - reload' END",
    "end_of_feed": "CASE WHEN NOT has_next OR end_cursor IS NULL THEN 'scraped until first ever post was reached' END",
    "older_than_start": "CASE WHEN sent IS NOT NULL AND oldest < start_unix THEN 'scraped until user-specified starting date was reached' END",
    "no_progress": f"CASE WHEN streak >= {CAPS['no_progress']} THEN 'scraped until first ever post was reached' END",
    "post_cap": f"CASE WHEN all_count >= {CAPS['post_cap']} THEN 'success' END",
    "shape_error": "CASE WHEN new_count > 0 AND timestamped_count = 0 THEN 'response_shape_error' END",
    "page_cap": f"CASE WHEN iter_index >= {CAPS['page_cap']} THEN 'max_paginations_reached' END",
}
TIMELINE_RULES = tuple(RULES_DUCK)
SEARCH_RULES = tuple(n for n in RULES_DUCK if n not in ("older_than_start", "shape_error"))
STOPS_DUCK = PAGE_STATE_DUCK + f""",
coded AS (
  SELECT *, CASE WHEN endpoint = 'Search' THEN coalesce({', '.join(RULES_DUCK[n] for n in SEARCH_RULES)})
    ELSE coalesce({', '.join(RULES_DUCK[n] for n in TIMELINE_RULES)}) END AS stop_code
  FROM states
),
kept AS (
  SELECT * FROM (
    SELECT *, min(CASE WHEN stop_code IS NOT NULL THEN iter_index END) OVER (PARTITION BY run_id) AS first_stop FROM coded
  ) z WHERE first_stop IS NULL OR iter_index <= first_stop
)
"""


# ---- A3, A4: users out of customers, requests and runs out of orders --------
CODES = (
    "success",
    "scraped until user-specified starting date was reached",
    "scraped until first ever post was reached",
    "no posts",
    "account is private",
    "profile is not available",
    "max_paginations_reached",
    "bad internet",
    "timeout error",
    "something went wrong - reload",
    "failed to load",
    "target crashed",
    "logged out while scraping",
    "response_shape_error",
    "some new code",
)
_CODE_CASE = " ".join(f"WHEN o_orderkey % 15 = {n} THEN '{code}'" for n, code in enumerate(CODES))
RUNS_SQL = f"""
SELECT o_orderkey AS k, o_custkey,
  'r' || CAST(o_orderkey AS STRING) AS run_id,
  CAST(floor(o_orderkey / 2) AS BIGINT) AS request_id,
  CASE WHEN o_orderkey % 6 = 0 THEN 'UserTimeline' WHEN o_orderkey % 6 = 1 THEN 'UserProfile'
       WHEN o_orderkey % 6 = 2 THEN 'PostByShortcode' WHEN o_orderkey % 6 = 3 THEN 'Chaining'
       WHEN o_orderkey % 6 = 4 THEN 'Search' ELSE 'Hashtag' END AS endpoint,
  CASE WHEN o_orderkey % 6 = 2 OR o_orderkey % 6 = 4 OR o_orderkey % 7 = 0 THEN NULL
       ELSE 'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS handle,
  CASE WHEN o_orderkey % 6 = 2 AND o_orderkey % 7 <> 0 THEN 'S' || CAST(o_custkey AS STRING) END AS shortcode,
  CASE WHEN o_orderkey % 6 = 4 AND o_orderkey % 7 <> 0 THEN o_orderpriority || ' & ' || o_orderstatus END AS keyword,
  CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 11 <> 5 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS start_date,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS end_date,
  CASE {_CODE_CASE} END AS result,
  '0:00:' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS time_taken
FROM orders
"""
QUERY_KEYS = ("handle", "shortcode", "keyword", "start_date", "end_date")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a run, or its request, per order. The query map holds only keys with a value."""
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in QUERY_KEYS]), F.array(*[F.col(k) for k in QUERY_KEYS]))
    return (
        derive(spark, sf_dir, RUNS_SQL, "orders")
        .withColumn("query", F.map_filter(pairs, lambda _, v: v.isNotNull()))
        .select("run_id", "request_id", "k", "o_custkey", "endpoint", "query", "result", "time_taken")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: two user records per run, of its customer and of the next one by number.

    The record of the next one comes in by ``chaining``.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.posexplode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("pos", "c_custkey"),
    )
    record = jo(
        username=js(F.col("c_name")),
        id=js(F.concat(F.lit("u"), F.col("c_custkey").cast("string"))),
        pk=jn(F.col("c_custkey")),
        is_private=jn(F.col("c_acctbal") < 0),
        profile_pic_url=F.when(F.col("c_custkey") % 5 > 0, js(F.concat(F.lit("https://pic.example/"), F.col("c_mktsegment")))),
    )
    return orders.join(table(spark, sf_dir, "customer"), "c_custkey").select(
        "run_id",
        F.when(F.col("pos") == 0, "profile").otherwise("chaining").alias("route"),
        "pos",
        record.alias("raw"),
    )


USERS_DUCK = """
SELECT 'r' || CAST(o.o_orderkey AS VARCHAR) AS run_id, o.pos, c.c_custkey, c.c_name AS username,
  'u' || CAST(c.c_custkey AS VARCHAR) AS id, CAST(c.c_custkey AS VARCHAR) AS pk, c.c_acctbal < 0 AS is_private,
  CASE WHEN c.c_custkey % 5 > 0 THEN 'https://pic.example/' || c.c_mktsegment END AS profile_pic_url
FROM (SELECT o_orderkey, o_custkey AS c, 0 AS pos FROM orders
      UNION ALL SELECT o_orderkey, o_custkey + 1 AS c, 1 AS pos FROM orders) o
JOIN customer c ON c.c_custkey = o.c
"""


# ---- A5: manifests out of lineitems -----------------------------------------
MANIFESTS_SQL = """
SELECT l_orderkey, l_linenumber, l_returnflag,
  CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS post_id,
  CAST(floor(l_quantity) AS BIGINT) * 1000 AS bw_a,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS bw_b,
  'https://v.example/a?p=' || CAST(l_partkey AS STRING) || '&s=' || CAST(l_suppkey AS STRING) AS url_a,
  'https://v.example/b?p=' || CAST(l_partkey AS STRING) || '&l=' || CAST(l_linenumber AS STRING) AS url_b,
  CASE WHEN l_returnflag = 'A' THEN 'https://v.example/audio/' || CAST(l_partkey AS STRING) END AS audio,
  l_returnflag <> 'N' OR l_linenumber % 2 = 0 AS has_video,
  l_suppkey % 23 = 5 AS broken
FROM lineitem
"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: one manifest per lineitem. The mime type stands on the representation or on
    its set, a bandwidth may be no number, one representation has no URL, and some
    manifests are cut short."""
    m = derive(spark, sf_dir, MANIFESTS_SQL, "lineitem")
    c = F.col

    def rep(attrs: Column, url: Column) -> Column:
        escaped = F.replace(url, F.lit("&"), F.lit("&amp;"))
        return F.concat(F.lit("<Representation "), attrs, F.lit("><BaseURL>"), escaped, F.lit("</BaseURL></Representation>"))

    on_rep = c("l_linenumber") % 2 == 1
    mime = F.when(~c("has_video"), "text/vtt").otherwise("video/mp4")
    own = F.when(on_rep, F.concat(F.lit('mimeType="'), mime, F.lit('" '))).otherwise("")
    of_set = F.when(on_rep, F.lit(' mimeType="audio/none"')).otherwise(F.concat(F.lit(' mimeType="'), mime, F.lit('"')))
    first = F.concat(own, F.lit('bandwidth="'), c("bw_a").cast("string"), F.lit('"'))
    second = F.concat(own, F.lit('bandwidth="'), F.coalesce(c("bw_b").cast("string"), F.lit("n/a")), F.lit('"'))
    audio = F.when(c("audio").isNull(), "").otherwise(
        F.concat(F.lit('<AdaptationSet mimeType="audio/mp4">'), rep(F.lit('bandwidth="1"'), F.lit("https://v.example/first-audio")),
                 rep(F.lit('bandwidth="1"'), c("audio")), F.lit("</AdaptationSet>"))
    )
    xml = F.concat(
        F.lit('<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet'), of_set, F.lit(">"),
        rep(first, c("url_a")), rep(second, c("url_b")),
        F.lit('<Representation bandwidth="99999999" mimeType="video/mp4"></Representation></AdaptationSet>'), audio,
        F.when(c("broken"), "</Per").otherwise("</Period></MPD>"),
    )
    return computed(m, xml=xml)


MANIFESTS_DUCK = f"""
WITH m AS ({MANIFESTS_SQL}),
best AS (
  SELECT *, CASE WHEN broken OR NOT has_video THEN NULL
    WHEN bw_a > coalesce(bw_b, 0) OR (bw_a = coalesce(bw_b, 0) AND url_a > url_b) THEN url_a ELSE url_b END AS video_url,
    CASE WHEN NOT broken THEN audio END AS audio_url
  FROM m
)
"""


# ---- A6: stored pages -------------------------------------------------------
STORED_SQL = """
SELECT page_id, url, html,
  html || '<a class="x" href="/p/A' || CAST(page_id AS STRING) || '/">1</a><a href=''/some.one/reel/B-' || CAST(page_id AS STRING)
    || '/''>2</a><a href="/tv/C' || CAST(page_id AS STRING) || '/">3</a>'
    || CASE WHEN page_id % 3 = 0 THEN '<a href="/reel/D' || CAST(page_id AS STRING) || '">4</a>' ELSE '' END
    || '<a href="/about/p/">5</a><A CLASS=big HREF=/p/U' || CAST(page_id AS STRING) || '/>6</A>'
    || '<a data-href="/p/NO/" href="/about">7</a><!-- <a href="/p/HID/">8</a> --><script>s = "<a href=/p/JS/>"</script><abbr href="/p/AB/">'
    || '<a title="a > b" href="/p/Q' || CAST(page_id AS STRING) || '/?x=1&amp;y=2">9</a><a name="/p/none/">10</a>' AS page_html,
  CASE WHEN page_id % 4 = 0 THEN 'PostByShortcode' WHEN page_id % 4 = 1 THEN 'Search' ELSE 'UserTimeline' END AS endpoint,
  CASE WHEN page_id % 9 = 0 THEN ' Profile isn''t available ' WHEN page_id % 9 = 1 THEN ' Sorry, this page isn''t available '
       WHEN page_id % 9 = 2 THEN ' This account is private ' WHEN page_id % 9 = 3 THEN ' Retry '
       WHEN page_id % 9 = 4 THEN ' Retry Failed to Load ' WHEN page_id % 9 = 5 THEN ' No Posts Yet '
       ELSE '' END AS phrase,
  page_id % 5 <> 0 AS on_target, page_id % 7 < 2 AS known_private, page_id % 11 = 0 AS has_feed
FROM pages
"""


# ---- A7: response bodies out of conversations -------------------------------
BODIES_SQL = """
SELECT conv_id, turn, role, text,
  'conv' || CAST(conv_id AS STRING) AS run_id, turn AS page_seq,
  conv_id % 4 AS form,
  (conv_id + turn) % 10 AS kind,
  'm' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS key
FROM conversations
"""


def _payload() -> Column:
    """The payload of a turn, by its kind; the whole text of the turn is in it."""
    c = F.col
    post = jo(__typename='"XDTMediaDict"', pk=js(c("key")), caption=jkey("text", js(c("text"))))
    wrapped = jo(__typename='"XDTFeedItem"', media=jo(id=js(c("key"))))
    hollow = '{"__typename":"XDTFeedItem","media":null}'
    other = jo(__typename='"XDTAd"', pk='"ad"')
    edges = ja(jkey("node", post), '{"node":null}', jkey("node", hollow), jkey("node", other), jkey("node", wrapped))
    info = jo(end_cursor=js(c("key")), has_next_page="true")
    user = jo(username=js(c("role")), pk=js(c("key")))
    serp = jo(edges=ja(jkey("node", jo(__typename='"XDTTopSerpMediaGridUnit"', items=ja(jo(pk=js(c("key"))), post))),
                       jkey("node", jo(__typename='"XDTTopSerpAccountsUnit"', items=ja(post)))))
    return (
        F.when(c("kind") == 0, jo(xdt_notification_badge="1", xdt_api__v1__feed__timeline__connection=jkey("edges", edges)))
        .when(c("kind") == 1, jkey("xdt_api__v1__feed__timeline__connection", jo(edges=edges, page_info=info)))
        .when(c("kind") == 2, jkey(FEED, jo(edges=edges, page_info=info)))
        .when(c("kind") == 3, jkey("xdt_api__v1__media__shortcode__web_info", jkey("items", ja(jo(pk=js(c("key"))), "null"))))
        .when(c("kind") == 4, jkey(SERP, serp))
        .when(c("kind") == 5, jkey("xdt_api__v1__discover__chaining", jkey("users", ja(user, jo(username='"second"')))))
        .when(c("kind") == 6, jkey("user", user))
        .when(c("kind") == 7, jkey("highlights", '{"edges":[]}'))
        .when(c("kind") == 8, jkey(FEED, "null"))
        .otherwise(jkey("xdt_viewer", jkey("note", js(c("text")))))
    )


def bodies(turns: DataFrame) -> DataFrame:
    """A7 bodies (batch or stream). Form 0: one JSON value, spread over lines; 1: two JSON
    lines, one broken line between; 2: a failure; 3: cut-off text."""
    c = F.col
    whole = F.concat(F.lit('{"status":"ok",\n "data":'), c("_payload"), F.lit(',\n "errors":[{"message":"side"},"no object",{"code":7}]}\n'))
    lines = F.concat(jkey("data", c("_payload")), F.lit('\r\n{"data": broken\n\n'), jkey("data", jkey("user", jkey("username", '"line two"'))))
    failed = F.concat(F.lit('{"status":"fail","message":'), F.when(c("turn") % 2 == 0, js(c("role"))).otherwise('""'), F.lit("}"))
    body = F.when(c("form") == 0, whole).when(c("form") == 1, lines).when(c("form") == 2, failed).otherwise(
        F.concat(F.lit('{"data":{"user":'), js(c("text")))
    )
    return computed(computed(turns, _payload=_payload()), body=body).drop("_payload", "role", "text")


def response_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(derive(spark, sf_dir, BODIES_SQL, "conversations"))


BODIES_DUCK = f"""
WITH b AS ({BODIES_SQL}),
payloads AS (
  SELECT run_id, page_seq, 0 AS payload_idx, kind, key, role, text FROM b WHERE form IN (0, 1)
  UNION ALL
  SELECT run_id, page_seq, 1 AS payload_idx, 6 AS kind, NULL AS key, 'line two' AS role, NULL AS text FROM b WHERE form = 1
)
"""
