import json

import pytest
from pyspark.sql import functions as F

import feedframe as ff
from feedframe.operators import paging
from feedframe.operators.routing import has_post_connection
from feedframe.operators.running import running

FEED = "xdt_api__v1__feed__user_timeline_graphql_connection"
SERP = "xdt_fbsearch__top_serp_graphql"
END = "scraped until first ever post was reached"


def feed(*nodes, cursor="C", more=True):
    return {"data": {FEED: {"edges": [{"node": n} for n in nodes], "page_info": {"end_cursor": cursor, "has_next_page": more}}}}


def media(pk, **more):
    return {"__typename": "XDTMediaDict", "pk": pk, **more}


def parsed_rows(frame):
    out = ff.parse_responses(frame).select(
        "page_seq", F.transform("payloads", lambda p: F.to_json(p)).alias("p"), F.transform("errors", lambda e: e["message"]).alias("e")
    )
    return [(r.p, r.e) for r in out.orderBy("page_seq").collect()]


def test_bodies_are_json_or_json_lines(logged):
    rows = parsed_rows(
        logged(
            {"data": {"a": 1}, "errors": [{"message": "side"}, 5]},
            '{"data":{"a":1}}\n\nbroken\n{"data":{"b":2}} trailing\r\n{"data":{"c":3}}',
            {"status": "fail", "message": "limited"},
            {"status": "fail"},
            [1, 2],
            "  ",
            None,
            {"data": None, "errors": {"message": "no list"}},
            json.dumps({"data": {"a": 1}}, indent=2),
        )
    )
    assert rows == [
        (['{"a":1}'], ["side"]),
        (['{"a":1}', '{"c":3}'], []),
        ([], ["limited"]),
        ([], ["status: fail"]),
        ([], []),
        ([], []),
        ([], []),
        ([], []),
        (['{"a":1}'], []),
    ]


def routed(frame):
    return ff.payload_rows(ff.parse_responses(frame))


def test_feed_keeps_media_and_wrapped_nodes(logged):
    nodes = [media("1"), {"__typename": "XDTFeedItem", "media": {"pk": "2"}}, {"__typename": "XDTFeedItem", "media": None}, None, {"__typename": "Ad"}]
    rows = ff.route_posts(routed(logged(feed(*nodes)))).orderBy("pos").collect()
    assert [(r.pos, json.loads(r.raw).get("pk")) for r in rows] == [(0, "1"), (1, None)]


def test_dedup_over_overlapping_pages(logged):
    posts = ff.route_posts(routed(logged(feed(media("1")), feed(media("1"), media("2"), media("2")))))
    assert [(r.page_seq, r.post_id) for r in ff.dedup_posts(posts).orderBy("page_seq", "pos").collect()] == [(0, "1"), (1, "2")]


def test_search_takes_grid_items_only(logged):
    serp = {"data": {SERP: {"edges": [{"node": {"__typename": "XDTTopSerpMediaGridUnit", "items": [{"pk": "a"}, {"pk": "b"}]}}, {"node": {"__typename": "XDTTopSerpAccountsUnit", "items": [{"pk": "c"}]}}, {}]}}}
    assert {json.loads(r.raw)["pk"] for r in ff.search_posts(routed(logged(serp))).collect()} == {"a", "b"}


def test_ignore_keys_beat_a_feed(logged):
    body = feed(media("1"))
    body["data"]["xdt_notification_badge"] = 1
    assert ff.route_posts(routed(logged(body))).isEmpty()


def test_post_connection(logged):
    frame = routed(logged(feed(media("1")), feed(), {"data": {FEED: None}}, {"data": {"xdt_viewer": {}}}, {"data": {SERP: {"edges": []}}}, {"data": {FEED: "text"}}))
    got = frame.select("page_seq", has_post_connection(F.col("payload")).alias("c")).orderBy("page_seq").collect()
    assert [r.c for r in got] == [True, True, False, False, True, False]


def info(cursor, more=True):
    return {"page_info": {"end_cursor": cursor, "has_next_page": more}}


def test_page_info_is_the_shallowest_in_document_order(logged):
    nested = feed(media("1", clips_stream=info("NESTED")), cursor="PAGE")
    frame = logged(
        nested,
        {"data": {"foo": {"bar": 1}}},
        {"data": {"z": info("first", False), "a": info("second")}},
        {"data": {"a": [{"b": {"c": info("deep")}}], "t": '{"page_info":{"end_cursor":"text"}}'}},
        '{"data":{"x":1}}\n' + json.dumps({"data": {"y": info("line")}}),
        {"data": {"page_info": {"has_next_page": 1}, "a": info("below")}},
        {"data": {"page_info": {"other": 1}, "a": info("used")}},
    )
    got = ff.page_info(ff.parse_responses(frame)).orderBy("page_seq").collect()
    assert [(r.end_cursor, r.has_next_page) for r in got] == [
        ("PAGE", True), (None, False), ("first", False), ("deep", True), ("line", True), (None, True), ("used", True),
    ]


def test_v1_pages_take_the_last_found_value(logged):
    frame = logged(
        {"data": {"items": [], "next_max_id": "30", "more_available": True}},
        {"data": {"zz": {"next_max_id": "early"}, "aa": {"next_max_id": "late"}}},
        {"data": {"items": []}},
        {"data": {"next_max_id": "5", "more_available": False}},
    )
    got = ff.v1_page_info(ff.parse_responses(frame)).orderBy("page_seq").collect()
    assert [(r.end_cursor, r.has_next_page) for r in got] == [("30", True), ("late", True), (None, False), ("5", False)]


STATE = (
    "iter_index bigint, cursor_sent string, end_cursor string, has_next_page boolean, new_count bigint, all_count bigint, "
    "oldest_in_batch_unix bigint, timestamped_count bigint, error string, start_unix bigint, no_progress_streak bigint, connection_present boolean"
)
BASE = dict(
    iter_index=1, cursor_sent="CUR", end_cursor="CUR2", has_next_page=True, new_count=5, all_count=10, oldest_in_batch_unix=1700000000,
    timestamped_count=5, error=None, start_unix=1600000000, no_progress_streak=0, connection_present=True,
)
RELOAD = "something went wrong - reload"


def cases():
    p = paging
    older = "scraped until user-specified starting date was reached"
    return [
        (p.stop_end_of_feed(), {"has_next_page": False}, END),
        (p.stop_end_of_feed(), {"end_cursor": None}, END),
        (p.stop_end_of_feed(), {"end_cursor": ""}, END),
        (p.stop_end_of_feed(), {}, None),
        (p.stop_older_than_start(), {"cursor_sent": None, "oldest_in_batch_unix": 1}, None),
        (p.stop_older_than_start(), {"oldest_in_batch_unix": 1}, older),
        (p.stop_older_than_start(), {"start_unix": None}, None),
        (p.stop_older_than_start(), {}, None),
        (p.stop_post_cap(10), {}, "success"),
        (p.stop_post_cap(11), {}, None),
        (p.stop_post_cap(-1), {"all_count": 9999}, None),
        (p.stop_page_cap(5), {"iter_index": 5}, "max_paginations_reached"),
        (p.stop_page_cap(5), {"iter_index": 4}, None),
        (p.stop_page_cap(-1), {"iter_index": 10**6}, None),
        (p.stop_no_progress(3), {"no_progress_streak": 3}, END),
        (p.stop_no_progress(3), {"no_progress_streak": 2}, None),
        (p.stop_no_progress(0), {"no_progress_streak": 9}, None),
        (p.stop_shape_error(), {"timestamped_count": 0}, "response_shape_error"),
        (p.stop_shape_error(), {"new_count": 0, "timestamped_count": 0}, None),
        (p.stop_shape_error(), {}, None),
        (p.stop_unusable_error(), {"error": "boom"}, None),
        (p.stop_unusable_error(), {"error": "boom", "new_count": 0, "no_progress_streak": 2}, None),
        (p.stop_unusable_error(), {"error": "boom", "connection_present": False}, RELOAD),
        (p.stop_unusable_error(), {"error": "boom", "end_cursor": "CUR"}, RELOAD),
        (p.stop_unusable_error(), {"error": "boom", "end_cursor": None}, RELOAD),
        (p.stop_unusable_error(), {"error": "boom", "end_cursor": None, "has_next_page": False}, None),
        (p.stop_unusable_error(), {"connection_present": False}, None),
    ]


def test_searches_of_odd_bodies(spark, logged):
    """Strings that look like objects, deep nesting, several payloads, keys with odd names."""
    deep = {"next_max_id": "deep", "page_info": {"end_cursor": "E", "has_next_page": True}}
    for _ in range(60):
        deep = {"x": [1, deep, "{"]}
    bodies = [
        json.dumps({"data": {"a": 1}}) + "\n" + json.dumps({"data": "{oops"}),
        {"data": deep},
        {"data": {"z": {"page_info": {"end_cursor": "first", "has_next_page": True}}, "a": {"page_info": {"end_cursor": "second", "has_next_page": False}}}},
        {"data": {"t": '{"page_info":{"end_cursor":"text"}}', "a b.c": [{"page_info": {"end_cursor": "odd name"}}]}},
        json.dumps({"data": {"next_max_id": "one"}}) + "\n" + json.dumps({"data": {"q": [{"next_max_id": "two"}, {"r": {"next_max_id": "three"}}]}}),
        {"data": {"next_max_id": None, "more_available": 1}},
    ]
    parsed = ff.parse_responses(logged(*bodies))
    info = {r.page_seq: (r.end_cursor, r.has_next_page) for r in ff.page_info(parsed).collect()}
    assert info == {0: (None, False), 1: ("E", True), 2: ("first", True), 3: ("odd name", False), 4: (None, False), 5: (None, False)}
    v1 = {r.page_seq: (r.end_cursor, r.has_next_page) for r in ff.v1_page_info(parsed).collect()}
    assert v1 == {0: (None, False), 1: ("deep", True), 2: (None, False), 3: (None, False), 4: ("three", True), 5: (None, True)}


def test_each_stop_rule(spark):
    rules = cases()
    rows = [tuple({**BASE, **change}.values()) for _, change, _ in rules]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + STATE)
    code = F.coalesce(*[F.when(F.col("n") == n, rule) for n, (rule, _, _) in enumerate(rules)])
    got = [r.code for r in frame.select("n", code.alias("code")).orderBy("n").collect()]
    assert got == [expected for _, _, expected in rules]


def test_default_rules(spark):
    timeline = [n for n, _ in ff.default_stop_rules("UserTimeline")]
    search = [n for n, _ in ff.default_stop_rules("Search")]
    assert timeline == ["unusable_error", "end_of_feed", "older_than_start", "no_progress", "post_cap", "shape_error", "page_cap"]
    assert search == ["unusable_error", "end_of_feed", "no_progress", "post_cap", "page_cap"]


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("step", [1, 10**12])
def test_running_values_do_not_depend_on_the_chunks(spark, parts, step):
    import random

    rng = random.Random(parts)
    rows = [("hot", s * step, rng.choice([0, 0, 2]), rng.choice([None, f"c{s}"]), rng.random() < 0.7) for s in rng.sample(range(200), 60)]
    rows += [("b", 5, 0, None, True), ("b", 900, 1, "x", True), ("only visits", 1, 3, "v", False), (None, 1, 1, "n", True), (None, 2, 0, "m", True)]
    frame = spark.createDataFrame(rows, "run_id string, page_seq bigint, n bigint, c string, p boolean").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for mark in (None, F.col("p")):
            got = running(frame, sums={"total": F.col("n")}, previous={"before": F.col("c")}, since={"streak": F.col("n") > 0}, counted=mark)
            expected = set()
            for run in ("hot", "b", "only visits", None):
                total, last, streak, i = 0, None, 0, -1
                for _, seq, n, c, p in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
                    total, seen = total + n, last
                    if mark is None or p:
                        streak, i, last = 0 if n else streak + 1, i + 1, c
                    expected.add((run, seq, i, total, seen, streak))
            assert {(r.run_id, r.page_seq, r.iter_index, r.total, r.before, r.streak) for r in got.collect()} == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rebuild_runs_end_to_end(spark, logged):
    start = {"handle": "H", "start_date": "2023-11-01", "end_date": "2023-11-30"}
    bodies = [
        {"data": {"user": {"username": "h", "id": "77", "pk": "77"}}},
        feed(media("1", taken_at=1700000000, owner_id="77"), media("x", taken_at=1700000000, owner_id="8"), cursor="A"),
        feed(media("1", taken_at=1700000000, owner_id="77"), media("2", taken_at=1699990000, owner_id="77"), cursor="B"),
        feed(media("3", taken_at=1600000000, owner_id="77"), cursor="C"),
        feed(media("4", taken_at=1599990000, owner_id="77"), cursor="D"),
    ]
    # The profile comes in the same body as the first page, as a line of its own.
    pages = logged(*bodies[1:]).withColumn("url", F.lit("https://www.instagram.com/api/graphql")).withColumn("resource_type", F.lit("xhr"))
    first = pages.where("page_seq = 0").withColumn("body", F.concat(F.lit(json.dumps(bodies[0]) + "\n"), "body"))
    requests = spark.createDataFrame([("r", "UserTimeline", start)], "run_id string, endpoint string, query map<string,string>")
    found = ff.rebuild_runs(first.unionByName(pages.where("page_seq > 0")), requests)
    assert [r.result for r in found.runs.collect()] == ["scraped until user-specified starting date was reached"]
    assert sorted(r.page_seq for r in found.pages.collect()) == [0, 1, 2]
    assert sorted(r.post_id for r in found.posts.collect()) == ["1", "2"]


REQUEST = "run_id string, endpoint string, query map<string,string>"


def xhr(pages):
    return pages.withColumn("url", F.lit("https://www.instagram.com/api/graphql")).withColumn("resource_type", F.lit("xhr"))


def rebuilt(spark, logged, endpoint, query, *bodies, visit=None, **options):
    """``(result, post ids, usernames, pages)`` of one run."""
    visits = None if visit is None else spark.createDataFrame([("r", *visit)], "run_id string, text string, on_target boolean")
    found = ff.rebuild_runs(xhr(logged(*bodies)), spark.createDataFrame([("r", endpoint, query)], REQUEST), visits=visits, **options)
    users = ff.typed_users(found.users)
    return (
        found.runs.first().result,
        sorted(r.post_id for r in found.posts.collect()),
        sorted(r.username for r in users.collect()),
        sorted(r.page_seq for r in found.pages.collect()),
    )


PROFILE = {"data": {"user": {"username": "h", "id": "77", "pk": "77"}}}
SIDE = {"data": {"highlights": {"edges": []}}}


def test_rebuild_of_single_shot_runs(spark, logged):
    handle = {"handle": "h"}
    suggested = {"data": {"xdt_api__v1__discover__chaining": {"users": [{"username": "friend"}]}}}
    # The profile response first: what it holds does not end the run, and the recommended user stays.
    assert rebuilt(spark, logged, "Chaining", handle, SIDE, PROFILE, suggested) == ("success", [], ["friend", "h"], [])
    assert rebuilt(spark, logged, "Chaining", handle, SIDE)[0] == "timeout error"
    assert rebuilt(spark, logged, "UserProfile", handle, SIDE, PROFILE) == ("success", [], ["h"], [])
    assert rebuilt(spark, logged, "UserProfile", handle, PROFILE, visit=("x", False))[0] == "logged out while scraping"
    assert rebuilt(spark, logged, "UserProfile", handle, visit=("Profile isn't available", True))[0] == "profile is not available"
    shown = {"data": {"xdt_api__v1__media__shortcode__web_info": {"items": [{"pk": "5"}]}}}
    assert rebuilt(spark, logged, "PostByShortcode", {"shortcode": "s"}, SIDE, shown) == ("success", ["5"], [], [])
    assert rebuilt(spark, logged, "PostByShortcode", {"shortcode": "s"}, SIDE)[0] == "timeout error"
    assert rebuilt(spark, logged, "Elsewhere", {}, shown) == (None, ["5"], [], [])
    # A visit's response counts as one JSON value only.
    assert rebuilt(spark, logged, "UserProfile", handle, json.dumps(SIDE) + "\n" + json.dumps(PROFILE))[0] == "timeout error"


def test_rebuild_of_a_timeline_with_visit_responses(spark, logged):
    query = {"handle": "h", "start_date": "2023-11-01", "end_date": "2023-11-30"}
    own = {"taken_at": 1700000000, "owner_id": "77"}
    pages = [PROFILE, feed(media("1", **own), cursor="A"), SIDE, feed(media("1", **own), cursor="B"), PROFILE, feed(media("2", **own), cursor=None, more=False), feed(media("3", **own), cursor="C")]
    done = "scraped until first ever post was reached"
    assert rebuilt(spark, logged, "UserTimeline", query, *pages) == (done, ["1", "2"], ["h", "h"], [1, 3, 5])
    # Gates come before paging.
    assert rebuilt(spark, logged, "UserTimeline", query, *pages, visit=("This account is private", True)) == ("account is private", [], ["h", "h"], [])
    assert rebuilt(spark, logged, "UserTimeline", query, SIDE)[0] == "timeout error"
    assert rebuilt(spark, logged, "UserTimeline", query, {"data": {"user": {"username": "H", "is_private": True}}})[0] == "account is private"
    assert rebuilt(spark, logged, "UserTimeline", query, SIDE, visit=("No Posts Yet", True))[0] == "no posts"
    # A log that tells pages from visits itself: the first feed was the visit's.
    told = xhr(logged(*pages)).withColumn("paging", F.col("page_seq").isin(3, 5))
    found = ff.rebuild_runs(told, spark.createDataFrame([("r", "UserTimeline", query)], REQUEST))
    assert [(r.page_seq, r.new_count, r.all_count, r.no_progress_streak) for r in found.pages.orderBy("page_seq").collect()] == [(3, 0, 1, 1), (5, 1, 2, 0)]
    # The caller's rules and cursors.
    by_place = lambda parsed: parsed.withColumn("end_cursor", F.col("page_seq").cast("string")).withColumn("has_next_page", F.lit(True))
    own_rules = {"UserTimeline": [("third", F.when(F.col("iter_index") == 2, "third page"))]}
    assert rebuilt(spark, logged, "UserTimeline", query, *pages, cursors=by_place, rules=own_rules)[0] == "third page"


def test_rebuild_of_a_search(spark, logged):
    def serp(*ids, cursor):
        grid = {"__typename": "XDTTopSerpMediaGridUnit", "items": [{"__typename": "XDTMediaDict", "pk": i} for i in ids]}
        return {"data": {"xdt_fbsearch__top_serp_graphql": {"edges": [{"node": grid}], "page_info": {"end_cursor": cursor, "has_next_page": True}}}}

    pages = [SIDE, serp("1", "2", cursor="A"), PROFILE, serp("3", cursor="B"), serp("4", cursor="C")]
    assert rebuilt(spark, logged, "Search", {"keyword": "k", "max_posts": "3"}, *pages) == ("success", ["1", "2", "3"], ["h"], [1, 3])
    assert rebuilt(spark, logged, "Search", {"keyword": "k", "max_posts": "-1"}, *pages) == (None, ["1", "2", "3", "4"], ["h"], [1, 3, 4])
    assert rebuilt(spark, logged, "Search", {"keyword": "k"}, SIDE)[0] == "no posts"


def test_rebuild_by_v1_cursors(spark, logged):
    def page(post, cursor):
        return {"data": {"xdt_api__v1__feed__user_timeline_graphql_connection": {"edges": [{"node": {"__typename": "XDTMediaDict", "pk": post, "taken_at": 1}}]}, "x": [{"next_max_id": cursor}]}}

    pages = xhr(logged(page("1", "m1"), page("2", "m2"), page("3", None), page("4", "m4")))
    asked = [("r", "UserTimeline", {"handle": "h"}, {}, {"max_id": "0"})]
    requests = spark.createDataFrame(asked, REQUEST + ", variables map<string,string>, form map<string,string>")
    found = ff.rebuild_runs(pages, requests)
    assert [(r.page_seq, r.cursor_sent, r.end_cursor) for r in found.pages.orderBy("page_seq").collect()] == [(0, None, "m1"), (1, "m1", "m2"), (2, "m2", None)]
    assert found.runs.first().result == "scraped until first ever post was reached"


def test_validate_requests(spark):
    rows = [("UserTimeline", {"handle": "a", "start_date": "x", "end_date": "y"}), ("Search", {}), ("Nope", {}), ("Chaining", None)]
    frame = spark.createDataFrame(rows, "endpoint string, query map<string,string>")
    got = {r.endpoint: (r.is_valid, r.reason) for r in ff.validate_requests(frame).collect()}
    assert got == {
        "UserTimeline": (True, None),
        "Search": (False, "missing required fields: keyword"),
        "Nope": (False, "unsupported endpoint: Nope"),
        "Chaining": (False, "missing required fields: handle"),
    }


def test_routes_nodes_and_page_info_work_a_payload_out_once(logged):
    """What a parse asks of each payload is bound once; no part of it is copied to look at its keys."""
    from feedframe.functions.json import is_object
    from feedframe.operators.routing import has_post_connection, route_of

    feed = "xdt_api__v1__feed__user_timeline_graphql_connection"
    parsed = ff.parse_responses(logged({"data": {feed: {"edges": []}}}))
    plan = parsed.select(route_of(F.get("payloads", F.lit(0))), F.exists("payloads", has_post_connection), F.exists("payloads", is_object))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.count("map<string,variant>") == 0 and "MapType(StringType,VariantType" not in text
    assert text.count("MapType(StringType,BooleanType") == 1


def test_odd_edges_keep_their_nodes(logged):
    """Edges that are no objects, nodes that are none, keys in another case, and page infos spelt by an escape."""
    feed = "xdt_api__v1__feed__user_timeline_graphql_connection"
    serp = "xdt_fbsearch__top_serp_graphql"
    post = {"__typename": "XDTMediaDict", "pk": "1"}
    edges = [{"node": post}, None, 3, "s", [], {"Node": post}, {"node": "x"}, {"node": {"__typename": "XDTFeedItem", "media": None}}, {"node": {"__typename": "XDTFeedItem", "media": {"pk": "2"}}}]
    grid = {"node": {"__typename": "XDTTopSerpMediaGridUnit", "items": [{"pk": "3"}, "no", None]}}
    bodies = [
        {"data": {feed: {"edges": edges}}},
        {"data": {serp: {"edges": [grid, None, {"node": 5}, {"node": {"__typename": "XDTTopSerpMediaGridUnit", "items": "none"}}, {"Node": grid["node"]}]}}},
        {"data": {feed: None}},
        {"data": {feed: []}},
        '{"data":{"deep":{"er":{"page\\u005finfo":{"end_cursor":"E","has_next_page":true}}}}}',
        {"data": {"a": {"page_info": {"end_cursor": None}}, "b": "page_info"}},
    ]
    parsed = ff.parse_responses(logged(*bodies))
    posts = ff.route_posts(ff.payload_rows(parsed)).orderBy("page_seq", "pos").collect()
    assert [(r.page_seq, r.pos, r.route) for r in posts] == [(0, 0, "user_feed"), (0, 1, "user_feed"), (1, 0, "search")]
    facts = {r.page_seq: (r.connection_present, r.end_cursor, r.has_next_page) for r in ff.page_facts(parsed).collect()}
    assert facts == {0: (True, None, False), 1: (True, None, False), 2: (False, None, False), 3: (False, None, False), 4: (False, "E", True), 5: (False, None, False)}


def test_a_post_is_parsed_once_for_its_id_and_once_for_its_time(spark):
    posts = spark.createDataFrame([("r", 1, 0, 0, '{"pk":7,"taken_at":9}')], "run_id string, page_seq int, payload_idx int, pos int, raw string")
    for rows in (ff.dedup_posts(posts), paging.page_stats(posts)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        assert rows.count() == 1


def test_route_looks_each_key_up_once(logged):
    payloads = ff.payload_rows(ff.parse_responses(logged({"data": {"highlights": "text", "user": {"username": "u"}, FEED: None}}, {"data": {"other": "text"}})))
    routed = ff.route(payloads)
    assert [r.route for r in routed.orderBy("page_seq").collect()] == ["user_feed", "unknown"]
    assert "array_contains" not in routed._jdf.queryExecution().optimizedPlan().toString()


def test_run_tables_are_sized_by_rows(spark):
    """Spark would broadcast a table of runs by the bytes of its file, far below those of its rows."""
    from feedframe.session import materialize

    pages = spark.range(0, 60_000, 1, 4).select(F.concat(F.lit("run"), F.col("id")).alias("run_id"), F.lit(0).alias("page_seq"), F.lit(1).alias("new_count"))
    runs = materialize(pages.select("run_id", F.lit("Search").alias("endpoint")), "few-bytes")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        counted = running(pages, sums={"all_count": F.col("new_count")}).join(runs, "run_id", "left")
        assert "BroadcastExchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert counted.count() == 60_000
