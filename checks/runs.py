"""Queries over response logs and runs: sources, routing, paging, joins, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

import feedframe as ff
from checks import adapters as a
from checks.registry import query
from feedframe.operators import paging
from feedframe.operators.filters import is_rate_limited
from feedframe.operators.routing import has_post_connection, route_of
from feedframe.sources.responses import error_text

# ---- response bodies (A7) ---------------------------------------------------


def _parsed(spark, sf):
    return ff.parse_responses(a.response_pages(spark, sf))


def _payloads(spark, sf):
    return ff.payload_rows(_parsed(spark, sf))


@query(
    a.BODIES_DUCK
    + """SELECT run_id, page_seq, CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS payloads,
    CASE form WHEN 0 THEN 'side; {"code":7}' WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN role ELSE 'status: fail' END END AS error FROM b"""
)
def src_7_parse_responses(spark, sf):
    return _parsed(spark, sf).select(
        "run_id", "page_seq", F.size("payloads").alias("payloads"), error_text(F.col("errors")).alias("error")
    )


@query(
    a.BODIES_DUCK
    + """SELECT run_id, page_seq, payload_idx, CASE kind WHEN 0 THEN 'ignore' WHEN 1 THEN 'home_feed' WHEN 2 THEN 'user_feed' WHEN 3 THEN 'shortcode'
    WHEN 4 THEN 'search' WHEN 5 THEN 'chaining' WHEN 6 THEN 'profile' WHEN 7 THEN 'ignore' WHEN 8 THEN 'user_feed' ELSE 'unknown' END AS route FROM payloads"""
)
def rte_1_route(spark, sf):
    return ff.route(_payloads(spark, sf)).drop("payload")


_FEED_POSTS = """
SELECT run_id, page_seq, payload_idx, 0 AS pos, key AS post_id, length(text) AS text_chars, 'XDTMediaDict' AS typename FROM payloads WHERE kind IN (1, 2)
UNION ALL SELECT run_id, page_seq, payload_idx, 1, key, NULL, 'XDTFeedItem' FROM payloads WHERE kind IN (1, 2)
"""
_SHORT_POSTS = "SELECT run_id, page_seq, payload_idx, 0 AS pos, key AS post_id, NULL AS text_chars, NULL AS typename FROM payloads WHERE kind = 3"
_SEARCH_POSTS = """
SELECT run_id, page_seq, payload_idx, 0 AS pos, key AS post_id, NULL AS text_chars, NULL AS typename FROM payloads WHERE kind = 4
UNION ALL SELECT run_id, page_seq, payload_idx, 1, key, length(text), 'XDTMediaDict' FROM payloads WHERE kind = 4
"""


def _post_columns(posts):
    from feedframe.functions.posts import post_id

    fields = F.from_json("raw", "`__typename` STRING, caption STRUCT<text: STRING>")
    return posts.select(
        "run_id",
        "page_seq",
        "payload_idx",
        "pos",
        post_id(F.col("raw")).alias("post_id"),
        F.length(fields["caption"]["text"]).cast("bigint").alias("text_chars"),
        fields["__typename"].alias("typename"),
    )


@query(a.BODIES_DUCK + _FEED_POSTS)
def rte_2_feed_posts(spark, sf):
    return _post_columns(ff.feed_posts(_payloads(spark, sf)))


@query(a.BODIES_DUCK + _SHORT_POSTS)
def rte_3_shortcode_posts(spark, sf):
    return _post_columns(ff.shortcode_posts(_payloads(spark, sf)))


@query(a.BODIES_DUCK + _SEARCH_POSTS)
def rte_4_search_posts(spark, sf):
    return _post_columns(ff.search_posts(_payloads(spark, sf)))


@query(
    a.BODIES_DUCK
    + """SELECT run_id, page_seq, payload_idx, 0 AS pos, CASE kind WHEN 5 THEN 'chaining' ELSE 'profile' END AS route, role AS username, key AS pk FROM payloads WHERE kind IN (5, 6)
    UNION ALL SELECT run_id, page_seq, payload_idx, 1, 'chaining', 'second', NULL FROM payloads WHERE kind = 5"""
)
def rte_5_users(spark, sf):
    users = _payloads(spark, sf)
    both = ff.chaining_users(users).unionByName(ff.profile_users(users))
    return ff.typed_users(both).select("run_id", "page_seq", "payload_idx", "pos", "route", "username", "pk")


@query(a.BODIES_DUCK + "SELECT run_id, page_seq, payload_idx, kind IN (0, 1, 2, 4) AS connected FROM payloads")
def rte_6_has_post_connection(spark, sf):
    return _payloads(spark, sf).select(
        "run_id", "page_seq", "payload_idx", has_post_connection(F.col("payload")).alias("connected")
    )


_ALL_POSTS = f"SELECT * FROM ({_FEED_POSTS}) f UNION ALL SELECT * FROM ({_SHORT_POSTS}) s UNION ALL SELECT * FROM ({_SEARCH_POSTS}) q"


@query(
    a.BODIES_DUCK
    + f"""SELECT run_id, post_id, page_seq, payload_idx, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, post_id ORDER BY page_seq, payload_idx, pos) AS rn FROM ({_ALL_POSTS}) p) z WHERE rn = 1"""
)
def agg_1_dedup_posts(spark, sf):
    return ff.dedup_posts(ff.route_posts(_payloads(spark, sf))).select("run_id", "post_id", "page_seq", "payload_idx", "pos")


@query(
    f"""WITH p AS ({a.POSTS_SQL}),
    k AS (SELECT d, 's' || (d % 3) AS run_id, CASE WHEN typename = 'XDTFeedItem' AND d % 70 = 0 OR d % 40 = 0 THEN NULL ELSE CAST(d % 40 AS VARCHAR) END AS pid FROM p)
    SELECT run_id, d FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pid ORDER BY d) AS rn FROM k) z WHERE pid IS NULL OR rn = 1"""
)
def agg_1_dedup_posts_few_keys(spark, sf):
    """Few keys with very many copies, and posts without an id (a number 0 is none)."""
    d = F.col("d")
    raw = F.when((d % 10 == 0) & (d % 70 == 0), F.col("raw")).otherwise(
        F.concat(F.lit('{"pk":'), (d % 40).cast("string"), F.lit(',"x":'), F.col("raw"), F.lit("}"))
    )
    posts = a.posts(spark, sf).select(F.concat(F.lit("s"), (d % 3).cast("string")).alias("run_id"), "d", raw.alias("raw"))
    return ff.dedup_posts(posts, order=("d",)).select("run_id", "d")


@query(
    a.BODIES_DUCK
    + f"""SELECT DISTINCT n.run_id, n.post_id, n.page_seq, n.payload_idx, n.pos FROM ({_ALL_POSTS}) n
    WHERE n.page_seq >= 2 AND NOT EXISTS (SELECT 1 FROM ({_ALL_POSTS}) o WHERE o.run_id = n.run_id AND o.post_id = n.post_id AND o.page_seq < 2)"""
)
def join_3_new_posts(spark, sf):
    from feedframe.functions.posts import post_id

    posts = ff.route_posts(_payloads(spark, sf))
    seen = posts.where("page_seq < 2").select("run_id", post_id(F.col("raw")).alias("post_id")).distinct()
    new = ff.new_posts(posts.where("page_seq >= 2"), seen)
    return _post_columns(new).select("run_id", "post_id", "page_seq", "payload_idx", "pos")


@query(
    a.BODIES_DUCK
    + """SELECT run_id, page_seq, CASE WHEN form = 0 AND kind IN (1, 2) THEN key END AS end_cursor, form = 0 AND kind IN (1, 2) AS has_next_page
    FROM b WHERE form <> 1
    UNION ALL SELECT run_id, page_seq, CASE WHEN kind IN (1, 2) THEN key END, kind IN (1, 2) FROM b WHERE form = 1"""
)
def pag_1_page_info(spark, sf):
    return ff.page_info(_parsed(spark, sf)).select("run_id", "page_seq", "end_cursor", "has_next_page")


# ---- deep search and v1 pages, over conversations ---------------------------
def _v1_pages(spark, sf):
    turns = a.derive(spark, sf, a.BODIES_SQL, "conversations")
    c = F.col
    # next_max_id at the top, nested below a list, nested twice (the last one counts), or absent.
    top = a.jo(items="[]", next_max_id=a.js(c("key")), more_available=F.when(c("turn") % 2 == 0, "false"))
    nested = a.jo(feed=a.ja('{"x":1}', a.jo(y=a.jo(next_max_id=a.js(c("key")), text=a.js(c("text"))))), more_available="1")
    twice = a.jo(zz=a.jo(next_max_id='"early"'), aa=a.jo(next_max_id=a.js(c("key"))))
    nothing = a.jo(items=a.ja(a.js(c("text"))))
    data = F.when(c("form") == 0, top).when(c("form") == 1, nested).when(c("form") == 2, twice).otherwise(nothing)
    return ff.parse_responses(turns.select("run_id", "page_seq", a.jkey("data", data).alias("body")))


@query(a.BODIES_DUCK + "SELECT run_id, page_seq, CASE WHEN form <> 3 THEN key END AS cursor FROM b")
def pag_2_deep_first(spark, sf):
    found = paging.deep_first(_v1_pages(spark, sf), "next_max_id")
    return found.select("run_id", "page_seq", F.try_variant_get("deep_next_max_id", "$", "string").alias("cursor"))


@query(
    a.BODIES_DUCK
    + """SELECT run_id, page_seq, CASE WHEN form <> 3 THEN key END AS end_cursor,
    CASE form WHEN 0 THEN turn % 2 <> 0 WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS has_next_page FROM b"""
)
def pag_3_v1_page_info(spark, sf):
    return ff.v1_page_info(_v1_pages(spark, sf)).select("run_id", "page_seq", "end_cursor", "has_next_page")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'graphql' WHEN o_orderkey % 4 = 1 THEN 'v1_max_id' ELSE 'graphql' END AS kind FROM orders"""
)
def pag_4_cursor_kind(spark, sf):
    k = F.col("o_orderkey")
    empty = F.create_map().cast("map<string,string>")
    variables = F.when(k % 3 == 0, F.create_map(F.lit("after"), F.col("o_orderstatus"))).when(k % 3 == 1, empty)
    form = F.when(k % 4 == 1, F.create_map(F.lit("max_id"), k.cast("string"))).when(k % 4 == 2, empty)
    return a.table(spark, sf, "orders").select("o_orderkey", paging.cursor_kind(variables, form).alias("kind"))


# ---- page log (A2) ----------------------------------------------------------
@query(
    f"""WITH e AS ({a.PAGES_DUCK}) SELECT run_id, page_seq FROM e WHERE resource_type = 'xhr'
    AND (url LIKE 'https://www.instagram.com/api/graphql%' OR url LIKE 'https://www.instagram.com/api/v1%' OR url LIKE 'https://www.instagram.com/graphql%')"""
)
def src_9_filter_api_responses(spark, sf):
    return ff.filter_api_responses(a.pages(spark, sf)).select("run_id", "page_seq")


@query(
    f"""WITH e AS ({a.PAGES_DUCK}) SELECT run_id, response_count, response_count > 0 AS has_activity FROM (
    SELECT run_id, count(CASE WHEN resource_type = 'xhr' AND k % 5 <> 2 THEN 1 END) AS response_count FROM e GROUP BY run_id) c"""
)
def agg_5_response_counts(spark, sf):
    return ff.response_counts(a.pages(spark, sf))


@query(f"WITH e AS ({a.PAGES_DUCK}) SELECT run_id, page_seq, rate_limited FROM e")
def flt_5_is_rate_limited(spark, sf):
    return ff.parse_responses(a.pages(spark, sf)).select("run_id", "page_seq", is_rate_limited(F.col("errors")).alias("rate_limited"))


@query(f"WITH e AS ({a.PAGES_DUCK}) SELECT run_id, page_seq, coalesce(transport_error, message || '; second') AS error FROM e")
def pag_6_error_text(spark, sf):
    return ff.parse_responses(a.pages(spark, sf)).select(
        "run_id", "page_seq", error_text(F.col("errors"), F.col("transport_error")).alias("error")
    )


@query(a.PAGE_STATE_DUCK + "SELECT run_id, page_seq, end_cursor, has_next AS has_next_page, error, connected AS connection_present, rate_limited FROM e_facts".replace("e_facts", "facts"))
def pag_1_page_facts(spark, sf):
    facts = ff.page_facts(ff.parse_responses(a.pages(spark, sf)))
    return facts.select("run_id", "page_seq", "end_cursor", "has_next_page", "error", "connection_present", "rate_limited")


def _new_posts(spark, sf):
    from feedframe.plans.lifecycle import new_posts_of

    return new_posts_of(ff.parse_responses(a.pages(spark, sf)))


@query(a.PAGE_STATE_DUCK + "SELECT run_id, page_seq, new_count, timestamped_count, oldest AS oldest_in_batch_unix FROM stats")
def agg_3_page_stats(spark, sf):
    return ff.page_stats(_new_posts(spark, sf))


def _counted_pages(spark, sf):
    """Page facts with counts, as a pipeline would read them back from its stored table."""
    from feedframe.operators.routing import node_rows, with_nodes
    from feedframe.session import materialize

    stored = materialize(ff.page_facts(with_nodes(ff.parse_responses(a.pages(spark, sf))), carry=("posts",)), "pages")
    new = ff.dedup_posts(node_rows(stored.where(~F.col("rate_limited")), "posts"))
    return materialize(ff.with_page_stats(stored.drop("posts"), ff.page_stats(new)), "counted")


@query(
    a.PAGE_STATE_DUCK
    + """SELECT run_id, page_seq, iter_index, sent AS cursor_sent, end_cursor, has_next AS has_next_page, new_count, all_count, oldest AS oldest_in_batch_unix,
    timestamped_count, error, start_unix, streak AS no_progress_streak, connected AS connection_present FROM states"""
)
def pag_5_page_state(spark, sf):
    return ff.page_state(_counted_pages(spark, sf)).drop("endpoint", "rate_limited")


_RULES = {
    "pag_7_unusable_error": ("unusable_error", paging.stop_unusable_error),
    "pag_8_end_of_feed": ("end_of_feed", paging.stop_end_of_feed),
    "pag_9_older_than_start": ("older_than_start", paging.stop_older_than_start),
    "pag_10_no_progress": ("no_progress", lambda: paging.stop_no_progress(a.CAPS["no_progress"])),
    "pag_11_post_cap": ("post_cap", lambda: paging.stop_post_cap(a.CAPS["post_cap"])),
    "pag_12_shape_error": ("shape_error", paging.stop_shape_error),
    "pag_13_page_cap": ("page_cap", lambda: paging.stop_page_cap(a.CAPS["page_cap"])),
}


def _rule_query(name, rule, column):
    def run(spark, sf):
        return ff.page_state(_counted_pages(spark, sf)).select("run_id", "page_seq", column().alias("code"))

    run.__name__ = name
    query(a.PAGE_STATE_DUCK + f"SELECT run_id, page_seq, {a.RULES_DUCK[rule]} AS code FROM states")(run)


for _name, (_rule, _column) in _RULES.items():
    _rule_query(_name, _rule, _column)


def _coded(spark, sf):
    return ff.with_stop_code(ff.page_state(_counted_pages(spark, sf)), **a.CAPS)


@query(a.STOPS_DUCK + "SELECT run_id, page_seq, stop_code FROM coded")
def pag_14_stop_code(spark, sf):
    return _coded(spark, sf).select("run_id", "page_seq", "stop_code")


@query(a.STOPS_DUCK + "SELECT run_id, page_seq, iter_index, all_count, stop_code FROM kept")
def pag_15_truncate_at_stop(spark, sf):
    return ff.truncate_at_stop(_coded(spark, sf)).select("run_id", "page_seq", "iter_index", "all_count", "stop_code")


@query(
    a.PAGE_STATE_DUCK
    + f"""SELECT run_id, page_seq, CASE WHEN new_count = 2 AND streak = 0 AND iter_index >= 4 THEN 'two new' ELSE {a.RULES_DUCK['end_of_feed']} END AS code,
    CASE WHEN new_count = 2 AND streak = 0 AND iter_index >= 4 THEN 'own' WHEN NOT has_next OR end_cursor IS NULL THEN 'end_of_feed' END AS rule FROM states"""
)
def udf_1_own_stop_rule(spark, sf):
    """A caller's rule in front of a built-in one."""
    own = F.when((F.col("new_count") == 2) & (F.col("iter_index") >= 4), "two new")
    rules = [("own", own), ("end_of_feed", paging.stop_end_of_feed())]
    states = ff.page_state(_counted_pages(spark, sf))
    return states.select("run_id", "page_seq", ff.stop_code(rules).alias("code"), paging.stop_rule(rules).alias("rule"))


@query(f"WITH e AS ({a.PAGES_DUCK}) SELECT run_id, page_seq, CASE WHEN connected THEN 'x' || page_seq END AS end_cursor, connected AS has_next_page FROM e")
def udf_2_own_cursor(spark, sf):
    """A caller's way to read cursors: any function that adds the two columns."""

    def by_sequence(parsed):
        connected = F.exists("payloads", has_post_connection)
        cursor = F.when(connected, F.concat(F.lit("x"), F.col("page_seq").cast("string")))
        return parsed.withColumn("end_cursor", cursor).withColumn("has_next_page", connected)

    parsed = ff.parse_responses(a.pages(spark, sf))
    return by_sequence(parsed).select("run_id", "page_seq", "end_cursor", "has_next_page")


# ---- requests, runs, users (A3, A4) -----------------------------------------
_MISSING = """CASE endpoint
  WHEN 'UserTimeline' THEN array_to_string(list_filter([CASE WHEN handle IS NULL THEN 'handle' END, CASE WHEN start_date IS NULL THEN 'start_date' END], lambda x: x IS NOT NULL), ', ')
  WHEN 'UserProfile' THEN CASE WHEN handle IS NULL THEN 'handle' ELSE '' END WHEN 'Chaining' THEN CASE WHEN handle IS NULL THEN 'handle' ELSE '' END
  WHEN 'PostByShortcode' THEN CASE WHEN shortcode IS NULL THEN 'shortcode' ELSE '' END WHEN 'Search' THEN CASE WHEN keyword IS NULL THEN 'keyword' ELSE '' END END"""


@query(
    f"""WITH r AS ({a.RUNS_SQL}), x AS (SELECT run_id, endpoint, {_MISSING} AS missing FROM r)
    SELECT run_id, missing, coalesce(missing = '', false) AS is_valid, CASE WHEN missing IS NULL THEN 'unsupported endpoint: ' || endpoint
      WHEN missing <> '' THEN 'missing required fields: ' || missing END AS reason FROM x"""
)
def src_8_validate_requests(spark, sf):
    return ff.validate_requests(a.runs(spark, sf)).select(
        "run_id", F.array_join("missing", ", ").alias("missing"), "is_valid", "reason"
    )


@query(
    f"""WITH r AS ({a.RUNS_SQL}), u AS ({a.USERS_DUCK}), h AS (SELECT r.run_id, u.id, u.pk FROM r JOIN u ON r.run_id = u.run_id AND lower(r.handle) = lower(u.username))
    SELECT run_id, id AS user_id FROM h UNION SELECT run_id, pk FROM h"""
)
def join_1_handle_user_ids(spark, sf):
    return ff.handle_user_ids(a.runs(spark, sf), ff.typed_users(a.users(spark, sf)))


@query(
    f"""WITH r AS ({a.RUNS_SQL}), u AS ({a.USERS_DUCK}) SELECT run_id, endpoint FROM r
    WHERE EXISTS (SELECT 1 FROM u WHERE u.run_id = r.run_id AND lower(u.username) = lower(r.handle) AND u.is_private)"""
)
def join_2_private_runs(spark, sf):
    return ff.private_runs(a.runs(spark, sf), ff.typed_users(a.users(spark, sf))).select("run_id", "endpoint")


@query(
    f"""WITH r AS ({a.RUNS_SQL}), u AS ({a.USERS_DUCK}) SELECT r.run_id, r.handle AS seed_handle, u.username AS recommended_handle, u.pk AS recommended_id
    FROM r JOIN u ON u.run_id = r.run_id WHERE r.endpoint = 'Chaining' AND u.pos = 1"""
)
def join_4_recommended_edges(spark, sf):
    return ff.recommended_edges(a.runs(spark, sf), ff.typed_users(a.users(spark, sf)))


@query(
    f"""WITH r AS ({a.RUNS_SQL}), u AS ({a.USERS_DUCK})
    SELECT run_id, coalesce(handle, shortcode, keyword) AS target, result, time_taken,
      (SELECT count(*) FROM lineitem l WHERE 'r' || l.l_orderkey = r.run_id) AS post_count,
      (SELECT count(*) FROM u WHERE u.run_id = r.run_id) AS user_count FROM r"""
)
def agg_4_run_summary(spark, sf):
    posts = a.table(spark, sf, "lineitem").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"))
    return ff.run_summary(a.runs(spark, sf), posts, a.users(spark, sf))


@query(
    f"""WITH r AS ({a.RUNS_SQL}) SELECT category, count(*) AS runs FROM (
    SELECT CASE WHEN k % 15 < 7 THEN 'success' WHEN k % 15 < 11 THEN 'retry' WHEN k % 15 < 13 THEN 'crash' WHEN k % 15 = 13 THEN 'partial' ELSE 'unknown' END AS category
    FROM r) c GROUP BY category"""
)
def rpt_1_runs_by_category(spark, sf):
    return ff.runs_by_category(a.runs(spark, sf))


@query(
    f"""WITH r AS ({a.RUNS_SQL}), q AS (SELECT request_id FROM r UNION SELECT -1 - c_custkey FROM customer)
    SELECT request_id FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.request_id = q.request_id AND (k % 15 < 7 OR k % 15 >= 13))"""
)
def rpt_2_to_recollect(spark, sf):
    runs = a.runs(spark, sf)
    # Requests: those of the runs, and one per customer that never ran.
    idle = a.table(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("request_id"))
    return ff.to_recollect(runs.select("request_id").distinct().unionByName(idle), runs)


# ---- clean-up of runs over A1 -----------------------------------------------
CLEAN_DUCK = f"""
WITH p AS ({a.POSTS_SQL}), r AS ({a.POST_RUNS_SQL}),
j AS (
  SELECT p.*, r.run_id, CASE WHEN r.g % 7 IN (3, 4, 5) AND endpoint = 'UserTimeline' THEN 'keep' WHEN r.g % 7 IN (4, 5) THEN 'keep'
      WHEN endpoint = 'Search' THEN 'resolve' ELSE 'filter' END AS mode,
    1704067200 + first_day * 86400 AS t0, 1704067200 + (first_day + 3) * 86400 AS t1,
    typename = 'XDTMediaDict' OR (typename = 'XDTFeedItem' AND d % 70 <> 0) AS resolvable,
    d % 12 <> 0 AND lower(coalesce(username, '')) = 'handle' || p.g AS direct,
    (d % 12 = 0 OR username IS NULL) AND d % 19 <> 0 AS by_id
  FROM p JOIN r ON p.g = r.g
),
dated AS (SELECT * FROM j WHERE mode = 'keep' OR (resolvable AND (mode = 'resolve' OR (taken_at >= t0 AND taken_at < t1))))
"""
_OWN_ID = "(by_id AND (owner_key = 'own' || g AND g % 3 <> 0))"


@query(CLEAN_DUCK + f"SELECT run_id, d FROM dated WHERE mode <> 'filter' OR direct OR {_OWN_ID}")
def flt_6_postprocess(spark, sf):
    users = ff.typed_users(a.run_users(spark, sf))
    return ff.postprocess(a.post_runs(spark, sf), a.run_posts(spark, sf), users).select("run_id", "d")


@query(
    CLEAN_DUCK
    + """SELECT run_id, count(*) AS dropped FROM dated WHERE mode = 'filter' AND g % 3 = 0 GROUP BY run_id HAVING count(CASE WHEN direct THEN 1 END) = 0"""
)
def rpt_3_author_filter_alarm(spark, sf):
    users = ff.typed_users(a.run_users(spark, sf))
    return ff.author_filter_alarm(a.post_runs(spark, sf), a.run_posts(spark, sf), users)
