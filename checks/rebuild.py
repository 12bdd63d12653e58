"""Whole runs of all five endpoints, rebuilt from a log with visit responses between the pages.

The log is A2's, two numbers apart, with a visit's response in front of some pages: profiles,
suggested users, single posts, side fragments, and bodies of several lines, which a visit
does not read. Runs of three more endpoints have visit responses only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

import feedframe as ff
from checks import adapters as a
from checks.registry import query

LOG_SQL = (
    "SELECT *, CASE WHEN user_id % 9 = 4 THEN 'UserProfile' WHEN user_id % 9 = 5 THEN 'PostByShortcode' WHEN user_id % 9 = 7 THEN 'Chaining' ELSE endpoint END AS asked,"
    " CASE WHEN k % 4 = 1 OR user_id % 9 IN (4, 5, 7) THEN (k + user_id) % 6 ELSE -1 END AS visit, (event_id * 7 + k) % 60 AS seen_id FROM ({}) z"
)
#: Sequence numbers far apart: a run's pages are no dense range.
STEP = 1_000_003


def _log(spark, sf):
    c = F.col
    e = a.derive(spark, sf, LOG_SQL.format(a.PAGES_SQL.format(k=a.K_SPARK)), "events")
    handle = F.concat(F.lit("Handle"), c("user_id").cast("string"))
    named = jo_user(handle)
    profile = a.jo(username=a.js(handle), pk=a.js(F.concat(F.lit("u"), c("user_id").cast("string"))), is_private=a.jn(c("user_id") % 8 == 3))
    suggested = a.jkey("users", a.ja(a.jo(username='"friend"', pk='"f1"'), a.jo(username='"other"', id='"f2"')))
    shown = a.jkey("items", a.ja(_post(c("seen_id"), c("taken_at"), named)))
    line = F.concat(a.jkey("data", a.jkey("user", profile)), F.lit("\n"), a.jkey("data", a.jkey("user", '{"username":"line"}')))
    data = (
        F.when(c("visit") == 0, a.jkey("user", profile))
        .when(c("visit") == 1, a.jkey("xdt_api__v1__discover__chaining", suggested))
        .when(c("visit") == 2, a.jkey("xdt_api__v1__media__shortcode__web_info", shown))
        .when(c("visit") == 3, a.jkey("xdt_notification_badge", "1"))
        .otherwise(a.jkey("highlights", '{"edges":[]}'))
    )
    visit = F.when(c("visit") == 4, line).otherwise(a.jkey("data", data))
    seen = e.where("visit >= 0").select("run_id", (c("page_seq") * STEP).alias("page_seq"), _api("url"), _api("resource_type"), F.lit(None).cast("string").alias("cursor_sent"), F.lit(None).cast("string").alias("transport_error"), visit.alias("body"))
    paged = a.page_bodies(e.where("asked = endpoint").withColumn("page_seq", c("page_seq") * STEP + 7), _named(named)).drop("endpoint", "start_unix")
    return seen.unionByName(paged.withColumn("url", _api("url")).withColumn("resource_type", _api("resource_type")))


def _api(column):
    return F.lit({"url": "https://www.instagram.com/graphql/query", "resource_type": "xhr"}[column]).alias(column)


def jo_user(handle):
    return a.jkey("username", a.js(F.lower(handle)))


def _post(id_, taken_at, user):
    """Posts with an even id name their author, others have no author and no owner."""
    return a.jo(__typename='"XDTMediaDict"', pk=a.jq(id_), taken_at=a.jn(taken_at), user=F.when(id_ % 2 == 0, user))


def _named(user):
    return lambda id_, taken_at: _post(id_, taken_at, user)


def _requests(spark, sf):
    c = F.col
    e = a.derive(spark, sf, LOG_SQL.format(a.PAGES_SQL.format(k=a.K_SPARK)), "events")
    runs = e.select("run_id", "user_id", c("asked").alias("endpoint"), "start_unix").distinct()
    day = F.date_format(F.timestamp_seconds("start_unix"), "yyyy-MM-dd")
    pairs = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("handle", "start_date", "end_date", "max_posts")]),
        F.array(F.concat(F.lit("handle"), c("user_id").cast("string")), day, F.date_format(F.date_add(F.to_date(day), 40), "yyyy-MM-dd"), F.when(c("user_id") % 2 == 0, "30")),
    )
    return runs.select("run_id", "endpoint", F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("query"))


def _visits(spark, sf):
    """The visited page of some runs: private, unavailable, empty, or away from the target."""
    c = F.col
    e = a.derive(spark, sf, LOG_SQL.format(a.PAGES_SQL.format(k=a.K_SPARK)), "events").select("run_id", "user_id").distinct()
    text = F.when(c("user_id") % 11 == 2, "x This account is private y").when(c("user_id") % 11 == 3, "Profile isn't available").when(c("user_id") % 11 == 4, "Sorry, this page isn't available").otherwise("grid")
    return e.where("user_id % 2 = 0 OR user_id % 11 < 5").select("run_id", text.alias("text"), (c("user_id") % 13 != 6).alias("on_target"))


_CAPS = {"page_cap": 25, "no_progress": 3}

_LOG_DUCK = f"""
WITH e AS ({LOG_SQL.format(a.PAGES_DUCK)}),
req AS (SELECT DISTINCT run_id, user_id, asked, start_unix FROM e),
paged AS (SELECT *, page_seq * {STEP} + 7 AS seq FROM e WHERE asked = endpoint),
arrivals AS (
  SELECT run_id, seq, pid, taken_at, paging, row_number() OVER (PARTITION BY run_id, pid ORDER BY seq, pos) AS rn FROM (
    SELECT run_id, seq, id0 AS pid, taken_at, 0 AS pos, true AS paging FROM paged WHERE id0 IS NOT NULL AND NOT rate_limited
    UNION ALL SELECT run_id, seq, id1, taken_at, 1, true FROM paged WHERE id1 IS NOT NULL AND NOT rate_limited
    UNION ALL SELECT run_id, page_seq * {STEP}, seen_id, taken_at, 0, false FROM e WHERE visit = 2) z),
posts AS (SELECT * FROM arrivals WHERE rn = 1),
stats AS (SELECT run_id, seq, count(*) AS new_count, count(taken_at) AS timestamped_count, min(taken_at) AS oldest FROM posts GROUP BY ALL),
every AS (SELECT run_id, seq, true AS paging FROM paged UNION ALL SELECT run_id, page_seq * {STEP}, false FROM e WHERE visit >= 0),
totals AS (SELECT run_id, seq, paging, coalesce(new_count, 0) AS new_count, coalesce(timestamped_count, 0) AS timestamped_count, oldest,
  CAST(sum(coalesce(new_count, 0)) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS all_count FROM every LEFT JOIN stats USING (run_id, seq)),
facts AS (SELECT p.run_id, p.seq, p.asked, p.user_id, p.start_unix, p.end_cursor, p.has_next, p.connected, p.cursor_sent, coalesce(transport_error, message || '; second') AS error,
  t.new_count, t.timestamped_count, t.oldest, t.all_count, row_number() OVER (PARTITION BY p.run_id ORDER BY p.seq) - 1 AS iter_index
  FROM paged p JOIN totals t ON p.run_id = t.run_id AND p.seq = t.seq),
states AS (SELECT *, CASE WHEN iter_index = 0 THEN cursor_sent ELSE lag(end_cursor) OVER w END AS sent,
  iter_index - coalesce(max(CASE WHEN new_count > 0 THEN iter_index END) OVER w, -1) AS streak
  FROM facts WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
coded AS (SELECT *, coalesce({a.RULES_DUCK['unusable_error']}, {a.RULES_DUCK['end_of_feed']}, {a.RULES_DUCK['older_than_start']}, {a.RULES_DUCK['no_progress']},
  CASE WHEN asked = 'Search' AND user_id % 2 = 0 AND all_count >= 30 THEN 'success' END, CASE WHEN asked <> 'Search' THEN {a.RULES_DUCK['shape_error']} END,
  {a.RULES_DUCK['page_cap']}) AS stop_code FROM states),
stops AS (SELECT run_id, min(seq) AS stop_seq, arg_min(stop_code, seq) AS stop_code FROM coded WHERE stop_code IS NOT NULL GROUP BY run_id),
users AS (SELECT e.run_id, page_seq * {STEP} AS seq, 0 AS pos, 'Handle' || user_id AS username, 'u' || user_id AS pk, user_id % 8 = 3 AS is_private FROM e LEFT JOIN stops s USING (run_id)
    WHERE visit = 0 AND (stop_seq IS NULL OR page_seq * {STEP} <= stop_seq)
  UNION ALL SELECT e.run_id, page_seq * {STEP}, u.pos, u.username, u.pk, NULL FROM e LEFT JOIN stops s USING (run_id), (VALUES (0, 'friend', 'f1'), (1, 'other', NULL)) u(pos, username, pk)
    WHERE visit = 1 AND (stop_seq IS NULL OR page_seq * {STEP} <= stop_seq)),
kept AS (SELECT p.* FROM posts p LEFT JOIN stops s USING (run_id) WHERE stop_seq IS NULL OR seq <= stop_seq),
seen AS (SELECT *, CASE WHEN user_id % 2 = 0 OR user_id % 11 < 5 THEN user_id % 11 ELSE 9 END AS t, (user_id % 2 = 0 OR user_id % 11 < 5) AND user_id % 13 = 6 AS away FROM req),
gates AS (SELECT run_id, CASE
    WHEN asked IN ('UserProfile', 'Search') AND away THEN 'logged out while scraping'
    WHEN asked IN ('UserProfile', 'Chaining', 'UserTimeline') AND t = 3 THEN 'profile is not available'
    WHEN asked = 'PostByShortcode' AND t = 4 THEN 'profile is not available'
    WHEN asked = 'UserTimeline' AND t = 4 THEN 'no posts' WHEN asked = 'UserTimeline' AND t = 2 THEN 'account is private'
    WHEN asked = 'UserTimeline' AND NOT EXISTS (SELECT 1 FROM paged p WHERE p.run_id = seen.run_id)
      AND EXISTS (SELECT 1 FROM users u WHERE u.run_id = seen.run_id AND u.is_private) THEN 'account is private' END AS gate FROM seen),
results AS (SELECT r.run_id, r.asked, r.user_id, r.start_unix, gate, coalesce(gate, CASE
    WHEN asked IN ('UserTimeline', 'Search') THEN stop_code
    WHEN asked = 'PostByShortcode' THEN CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.run_id = r.run_id) THEN 'success' ELSE 'timeout error' END
    ELSE CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.run_id = r.run_id) THEN 'success' ELSE 'timeout error' END END) AS result
  FROM req r JOIN gates USING (run_id) LEFT JOIN stops USING (run_id))
"""


def _rebuilt(spark, sf):
    return ff.rebuild_runs(_log(spark, sf), _requests(spark, sf), visits=_visits(spark, sf), **_CAPS)


@query(_LOG_DUCK + "SELECT run_id, asked AS endpoint, result FROM results")
def pln_1_rebuild_runs_results(spark, sf):
    return _rebuilt(spark, sf).runs.select("run_id", "endpoint", "result")


@query(
    _LOG_DUCK
    + """SELECT k.run_id, CAST(k.pid AS VARCHAR) AS post_id, k.seq AS page_seq, k.taken_at FROM kept k JOIN results r USING (run_id)
    WHERE NOT (k.paging AND gate IS NOT NULL) AND (r.asked <> 'UserTimeline'
      OR coalesce(result IN ('something went wrong - reload', 'response_shape_error', 'no posts', 'account is private', 'profile is not available') OR result IS NULL, true)
      OR (k.pid % 2 = 0 AND k.taken_at >= start_unix AND k.taken_at < start_unix + 41 * 86400))"""
)
def pln_1_rebuild_runs_posts(spark, sf):
    posts = _rebuilt(spark, sf).posts
    return posts.select("run_id", "post_id", "page_seq", F.get_json_object("raw", "$.taken_at").cast("bigint").alias("taken_at"))


@query(_LOG_DUCK + "SELECT run_id, seq AS page_seq, pos, username, pk FROM users")
def pln_1_rebuild_runs_users(spark, sf):
    return ff.typed_users(_rebuilt(spark, sf).users).select("run_id", "page_seq", "pos", "username", "pk")


@query(
    _LOG_DUCK
    + """SELECT c.run_id, c.seq AS page_seq, iter_index, sent AS cursor_sent, new_count, all_count, streak AS no_progress_streak, c.stop_code
    FROM coded c LEFT JOIN stops s USING (run_id) JOIN results r USING (run_id) WHERE gate IS NULL AND (stop_seq IS NULL OR c.seq <= stop_seq)"""
)
def pln_1_rebuild_runs_pages(spark, sf):
    pages = _rebuilt(spark, sf).pages
    return pages.select("run_id", "page_seq", "iter_index", "cursor_sent", "new_count", "all_count", "no_progress_streak", "stop_code")
