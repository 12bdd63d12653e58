import json

import pytest
from pyspark.sql import functions as F

import feedframe as ff

FEED = "xdt_api__v1__feed__user_timeline_graphql_connection"


def page(seq, *pks, run="r", cursor="C", more=True):
    edges = [{"node": {"__typename": "XDTMediaDict", "pk": p, "taken_at": 1700000000}} for p in pks]
    body = {"data": {FEED: {"edges": edges, "page_info": {"end_cursor": cursor, "has_next_page": more}}}}
    return {"run_id": run, "page_seq": seq, "url": "u", "resource_type": "xhr", "cursor_sent": None, "body": json.dumps(body)}


def put(folder, name, *pages):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(p) for p in pages))


def drain(spark, frame, out):
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(str(out))


def test_dedup_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "1", page(0, "1", "1", None))
    posts = ff.stream_dedup(ff.stream_posts(ff.stream_pages(spark, str(source), max_files=1)))
    assert drain(spark, posts, tmp_path / "out").count() == 2
    put(source, "2", page(1, "1", "2", None), page(0, "1", run="other"))
    got = drain(spark, posts, tmp_path / "out")
    assert sorted((r.run_id, r.post_id or "-") for r in got.collect()) == [("other", "1"), ("r", "-"), ("r", "-"), ("r", "1"), ("r", "2")]


def test_stop_over_batches_matches_the_batch_form(spark, tmp_path):
    source = tmp_path / "in"
    pages = [page(0, "1", "2", cursor="A"), page(1, "2", cursor="B"), page(2, "3", cursor="D"), page(3, "4", cursor="E", more=False), page(4, "5", cursor="F")]
    put(source, "1", pages[1], pages[0])
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = ff.stream_pages(spark, str(source)).withColumn("endpoint", F.lit("UserTimeline")).withColumn("start_unix", F.lit(0).cast("bigint"))
    stops = ff.stream_stop(ff.stream_page_rows(stream))
    drain(spark, stops, tmp_path / "out")
    put(source, "2", pages[2], pages[0])
    drain(spark, stops, tmp_path / "out")
    put(source, "3", *pages[3:])
    got = drain(spark, stops, tmp_path / "out").where("NOT late").orderBy("page_seq")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = [(r.page_seq, r.iter_index, r.all_count, r.cursor_sent, r.no_progress_streak, r.stop_code) for r in got.collect()]
    end = "scraped until first ever post was reached"
    assert rows == [(0, 0, 2, None, 0, None), (1, 1, 2, "A", 1, None), (2, 2, 3, "B", 0, None), (3, 3, 4, "D", 0, end)]

    frame = spark.createDataFrame(pages, ff.PAGE_SCHEMA).withColumn("endpoint", F.lit("UserTimeline")).withColumn("start_unix", F.lit(0).cast("bigint"))
    parsed = ff.parse_responses(frame)
    new = ff.dedup_posts(ff.route_posts(ff.payload_rows(parsed)))
    states = ff.with_stop_code(ff.page_state(ff.with_page_stats(ff.page_facts(parsed), ff.page_stats(new))))
    batch = [(r.page_seq, r.iter_index, r.all_count, r.cursor_sent, r.no_progress_streak, r.stop_code) for r in ff.truncate_at_stop(states).orderBy("page_seq").collect()]
    assert batch == rows


def test_sinks_run_in_order_and_a_failing_callback_is_logged(spark, tmp_path, caplog):
    source = tmp_path / "in"
    put(source, "1", page(0, "1", "2"))
    seen = []
    sinks = [
        ff.jsonl_sink(str(tmp_path / "raw")),
        ff.video_plan_sink(str(tmp_path / "videos")),
        None,
        ff.on_new_posts(lambda batch, n: 1 / 0),
        ff.on_new_posts(lambda batch, n: seen.append(batch.count())),
    ]
    posts = ff.stream_posts(ff.stream_pages(spark, str(source)))
    ff.write_stream(posts, sinks, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert seen == [2] and "callback failed" in caplog.text
    assert ff.read_posts(spark, str(tmp_path / "raw"), lines=True).count() == 2


def test_no_sinks_no_query(spark, tmp_path):
    assert ff.fan_out([None, None]) is None
    assert ff.write_stream(None, [None], "unused") is None
    with pytest.raises(ValueError):
        ff.on_new_posts(print, on_error="ignore")


def test_empty_batch_reaches_no_sink(spark):
    called = []
    ff.fan_out([lambda batch, n: called.append(n)])(spark.createDataFrame([], "raw string"), 0)
    assert called == []


def test_pages_that_overtake_one_another_wait_for_their_order(spark, tmp_path):
    """Files in any order, a page each, over several batches: the states of the batch form."""
    import time

    source = tmp_path / "in"
    source.mkdir()
    ids = [("1", "2"), ("2",), ("3", "1"), ("4",), ("4",), ("5", "6"), ("7",)]
    pages = [page(n, *these, cursor=f"c{n}") for n, these in enumerate(ids)]
    stream = ff.stream_pages(spark, str(source), max_files=2).withColumn("endpoint", F.lit("UserTimeline")).withColumn("start_unix", F.lit(0).cast("bigint"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    states = ff.stream_page_states(ff.stream_page_rows(stream), delay_ms=12_000)
    query = states.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))

    def rows_so_far():
        return spark.read.schema(states.schema).parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() else 0

    def wait_for(n):
        end = time.time() + 120
        while rows_so_far() < n and time.time() < end:
            assert query.isActive, query.exception()
            time.sleep(1)

    try:
        # A stream with timers always has another batch, so there is no waiting for its end.
        for n, at in enumerate((2, 0, 1, 6, 4, 3, 5)):
            put(source, str(n), pages[at])
        wait_for(len(pages))
        put(source, "late", pages[3])
        wait_for(len(pages) + 1)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.schema(states.schema).parquet(str(tmp_path / "out"))
    assert [r.page_seq for r in got.where("late").collect()] == [3]
    rows = [(r.page_seq, r.iter_index, r.all_count, r.cursor_sent, r.no_progress_streak) for r in got.where("not late").orderBy("page_seq").collect()]
    frame = spark.createDataFrame(pages, ff.PAGE_SCHEMA)
    parsed = ff.parse_responses(frame)
    counted = ff.with_page_stats(ff.page_facts(parsed), ff.page_stats(ff.dedup_posts(ff.route_posts(ff.payload_rows(parsed)))))
    assert rows == [(r.page_seq, r.iter_index, r.all_count, r.cursor_sent, r.no_progress_streak) for r in ff.page_state(counted).orderBy("page_seq").collect()]


def test_runs_that_share_a_state_key_are_kept_apart(spark, tmp_path, monkeypatch):
    """All places in one state key, over several batches: the runs' states and stops are those of the batch form."""
    from feedframe.streaming import stops as module

    monkeypatch.setattr(module, "BUCKETS", 1)
    source = tmp_path / "in"
    source.mkdir()
    runs = {"a": [("1", "2"), ("2",), ("3",)], "b": [("1",), ("1", None), ("1",)], "c": [("5",), ("6",), ("7",)]}
    pages = [page(n, *ids, run=run, cursor=f"{run}{n}", more=(run, n) != ("c", 1)) for run, every in runs.items() for n, ids in enumerate(every)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = ff.stream_pages(spark, str(source), schema=ff.PAGE_SCHEMA).withColumn("endpoint", F.lit("UserTimeline"))
    stream = stream.withColumn("start_unix", F.when(F.col("run_id") != "b", F.lit(0).cast("bigint")))
    stops = ff.stream_stop(ff.stream_page_rows(stream))
    try:
        for n in range(2):
            put(source, str(n), *[p for p in pages if min(p["page_seq"], 1) == n])
            got = drain(spark, stops, tmp_path / "out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert stops._jdf.queryExecution().analyzed().toString().count("bucket#") > 0
    columns = ("run_id", "page_seq", "iter_index", "new_count", "all_count", "cursor_sent", "no_progress_streak", "stop_code")
    frame = spark.createDataFrame(pages, ff.PAGE_SCHEMA).withColumn("endpoint", F.lit("UserTimeline"))
    frame = frame.withColumn("start_unix", F.when(F.col("run_id") != "b", F.lit(0).cast("bigint")))
    parsed = ff.parse_responses(frame)
    new = ff.dedup_posts(ff.route_posts(ff.payload_rows(parsed)))
    states = ff.with_stop_code(ff.page_state(ff.with_page_stats(ff.page_facts(parsed), ff.page_stats(new))))
    batch = sorted(tuple(r) for r in ff.truncate_at_stop(states).select(*columns).collect())
    assert len(batch) == 8 and sorted(tuple(r) for r in got.select(*columns).collect()) == batch
