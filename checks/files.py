"""Queries over files and streams: readers, writers, live pages.

They write what a driver table holds into the shared work folder first, then read it with
the engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

import feedframe as ff
from checks import adapters as a
from checks.posts import FLAT_DUCK, RESOLVED
from checks.registry import query
from checks.runs import _ALL_POSTS, _post_columns
from feedframe.sinks import runs as run_sinks
from feedframe.sinks import tables
from feedframe.schemas import FLAT_COLUMNS
from feedframe.session import work_folder
from feedframe.sources import files

# ---- documents of every shape -----------------------------------------------
_SHAPES = """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE 0 END AS n FROM documents
"""


def _documents(spark, sf):
    """An envelope, one post, a list, null posts, a number, text, one item, no posts."""
    d = F.col("doc_id") % 8
    one = a.jo(pk=a.jn(F.col("doc_id")), text=a.js(F.col("text")))
    value = (
        F.when(d == 0, a.jo(result='"ok"', posts=a.ja(one, one)))
        .when(d == 1, one)
        .when(d == 2, a.ja(one, '{"pk":"x"}'))
        .when(d == 3, '{"posts":null}')
        .when(d == 4, "17")
        .when(d == 5, a.js(F.col("text")))
        .when(d == 6, a.ja(one))
        .otherwise('{"posts":[],"users":[]}')
    )
    return a.table(spark, sf, "documents").select("doc_id", value.alias("value"))


def _count_posts(spark, sf, strict):
    posts = files.document_posts(F.col("value"), strict_envelope=strict)
    return _documents(spark, sf).select("doc_id", F.size(posts).alias("n"))


@query(_SHAPES)
def src_1_document_posts(spark, sf):
    return _count_posts(spark, sf, False)


@query("SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 0 END AS n FROM documents")
def src_6_strict_envelope(spark, sf):
    return _count_posts(spark, sf, True)


# ---- JSON lines -------------------------------------------------------------
_RAW_DUCK = f"WITH p AS ({a.POSTS_SQL}) SELECT CASE WHEN typename = 'XDTFeedItem' THEN NULL ELSE id END AS id, length(CASE WHEN caption_form <> 0 AND typename <> 'XDTFeedItem' THEN text END) AS text_chars FROM p"


def _raw_columns(posts):
    fields = F.from_json("raw", "id STRING, caption STRUCT<text: STRING>")
    return posts.select(fields["id"].alias("id"), F.length(fields["caption"]["text"]).cast("bigint").alias("text_chars"))


def _written_lines(spark, sf, name, **options):
    path = work_folder(spark, name)
    a.posts(spark, sf).select("raw").write.options(**options).text(path)
    return path


@query(_RAW_DUCK)
def src_2_read_lines(spark, sf):
    return _raw_columns(ff.read_posts(spark, _written_lines(spark, sf, "lines"), lines=True))


@query(_RAW_DUCK)
def src_3_read_gzip_lines(spark, sf):
    return _raw_columns(ff.read_posts(spark, _written_lines(spark, sf, "gzip", compression="gzip"), lines=True))


@query(
    f"""WITH p AS ({a.POSTS_SQL}) SELECT 'a' AS part, CASE WHEN typename = 'XDTFeedItem' THEN NULL ELSE id END AS id FROM p
    UNION ALL SELECT 'b', CASE WHEN typename = 'XDTFeedItem' THEN NULL ELSE id END FROM p WHERE lang = 'en'"""
)
def set_1_concat_inputs(spark, sf):
    first = a.posts(spark, sf).select("raw", F.lit("a").alias("part"))
    second = a.posts(spark, sf).where("lang = 'en'").select(F.lit("b").alias("part"), "raw")
    both = ff.concat_inputs(first, second)
    return both.select("part", F.from_json("raw", "id STRING")["id"].alias("id"))


@query(f"WITH p AS ({a.POSTS_SQL}) SELECT row_number() OVER (ORDER BY d) - 1 AS place, CASE WHEN typename = 'XDTFeedItem' THEN NULL ELSE id END AS id FROM p")
def top_5_sort_inputs(spark, sf):
    """Posts in input order, out of a scattered table. The number of a row then grows along
    the sorted table; its place is found by what stands before it, range by range."""
    posts = a.posts(spark, sf).select(F.lit("f").alias("src_file"), F.lit(0).alias("src_block"), F.col("d").alias("pos"), "raw")
    ordered = ff.sort_inputs(posts.repartition(13, "pos")).select("src_file", "raw", F.monotonically_increasing_id().alias("row"))
    from feedframe.operators.running import running

    places = running(ordered, run="src_file", seq="row", index="place")
    return places.select("place", F.from_json("raw", "id STRING")["id"].alias("id"))


# ---- writers ----------------------------------------------------------------
def _flat(spark, sf):
    return ff.flatten_posts(a.posts(spark, sf), resolve=True)


# All columns as they are, and as CSV gives them back, where an empty text is none.
_EVERY = ", ".join(FLAT_COLUMNS)
_EVERY_DUCK = RESOLVED + f"SELECT {_EVERY} FROM (SELECT {FLAT_DUCK} FROM m) f"
_AS_CSV = ", ".join(f"nullif({c}, '') AS {c}" if t == "string" else c for c, t in FLAT_COLUMNS.items())


@query(RESOLVED + f"SELECT {_AS_CSV} FROM (SELECT {FLAT_DUCK} FROM m) f")
def snk_1_write_csv(spark, sf):
    path = work_folder(spark, "csv")
    ff.write_csv(_flat(spark, sf), path)
    back = spark.read.options(header=True, multiLine=True, escape='"').schema(ff.FLAT_SCHEMA).csv(path)
    return back.select(*FLAT_COLUMNS)


@query(_EVERY_DUCK)
def snk_2_write_parquet(spark, sf):
    path = work_folder(spark, "parquet")
    ff.write_parquet(_flat(spark, sf), path)
    return spark.read.parquet(path).select(*FLAT_COLUMNS)


@query(_EVERY_DUCK)
def snk_3_write_jsonl(spark, sf):
    path = work_folder(spark, "jsonl")
    ff.write_jsonl(_flat(spark, sf), path)
    return spark.read.schema(ff.FLAT_SCHEMA).json(path).select(*FLAT_COLUMNS)


@query(_RAW_DUCK + " UNION ALL SELECT * FROM (SELECT CASE WHEN typename = 'XDTFeedItem' THEN NULL ELSE id END, length(CASE WHEN caption_form <> 0 AND typename <> 'XDTFeedItem' THEN text END) FROM p WHERE lang = 'fr') t")
def snk_4_append_jsonl(spark, sf):
    path = work_folder(spark, "append")
    posts = a.posts(spark, sf)
    ff.append_jsonl(posts.select("raw"), path)
    ff.append_jsonl(posts.where("lang = 'fr'").select("raw"), path)
    ff.append_jsonl(posts.where("lang = 'none'").select("raw"), path)
    return _raw_columns(ff.read_posts(spark, path, lines=True))


@query(RESOLVED + "SELECT fmt, count(*) AS rows, (SELECT count(*) FROM m) * 3 AS written FROM m CROSS JOIN (VALUES ('csv'), ('jsonl'), ('parquet')) f(fmt) GROUP BY fmt")
def snk_5_write_flat(spark, sf):
    base = work_folder(spark, "all")
    written = tables.write_flat(_flat(spark, sf), {f: f"{base}.{f}" for f in ("csv", "jsonl", "parquet")})
    back = {
        "csv": spark.read.options(header=True, multiLine=True, escape='"').schema(ff.FLAT_SCHEMA).csv(f"{base}.csv"),
        "jsonl": spark.read.schema(ff.FLAT_SCHEMA).json(f"{base}.jsonl"),
        "parquet": spark.read.parquet(f"{base}.parquet"),
    }
    rows = [d.select(F.lit(f).alias("fmt")) for f, d in back.items()]
    counted = ff.concat_inputs(*rows).groupBy("fmt").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("written", F.lit(written).cast("bigint"))


@query(f"WITH p AS ({a.POSTS_SQL}) SELECT source AS src_stem, count(*) AS rows, count(CASE WHEN typename <> 'XDTFeedItem' THEN code END) AS with_code FROM p GROUP BY source")
def snk_6_per_input(spark, sf):
    path = work_folder(spark, "per-input")
    posts = a.posts(spark, sf).withColumn("src_stem", F.col("source"))
    tables.write_flat(ff.flatten_posts(posts, keep=("src_stem",)), {"parquet": path}, partition_by=("src_stem",))
    return spark.read.parquet(path).groupBy("src_stem").agg(
        F.count(F.lit(1)).alias("rows"), F.count("code").alias("with_code")
    )


@query(_EVERY_DUCK)
def snk_7_flatten_to_one_target(spark, sf):
    """A folder of result documents into one target."""
    source, target = work_folder(spark, "inputs"), work_folder(spark, "merged") + ".parquet"
    ff.save_runs(_saved(spark, sf), source, file_per_run=True)
    ff.flatten_paths(spark, source, output=target, fmt="parquet", concat=True, resolve=True)
    return spark.read.parquet(target).select(*FLAT_COLUMNS)


@query("SELECT count(*) AS written, count(*) AS rows FROM documents")
def snk_8_flatten_folder(spark, sf):
    """A folder of result documents, one output per input, into the folder given."""
    source, target = work_folder(spark, "folder-in"), work_folder(spark, "folder-out")
    ff.save_runs(_saved(spark, sf), source, file_per_run=True)
    written = ff.flatten_paths(spark, source, output=target, fmt="jsonl")
    back = spark.read.schema(ff.FLAT_SCHEMA).json(f"{target}/jsonl")
    return back.groupBy(F.lit(written).cast("bigint").alias("written")).agg(F.count(F.lit(1)).alias("rows"))


# ---- saved runs -------------------------------------------------------------
def _saved(spark, sf, **kwargs):
    runs = a.post_runs(spark, sf).drop("g")
    posts = a.run_posts(spark, sf).select("run_id", F.col("d").alias("pos"), "raw")
    users = a.run_users(spark, sf)
    return run_sinks.run_documents(runs, posts, users, **kwargs)


_SAVED_DUCK = f"""
WITH r AS ({a.POST_RUNS_SQL}), n AS (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS g, count(*) AS posts, sum(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE doc_id END) AS ids FROM documents GROUP BY 1)
SELECT run_id, endpoint, handle, result, '0:00:' || lpad(CAST(r.g % 60 AS VARCHAR), 2, '0') AS time_taken, posts, CASE WHEN r.g % 3 = 0 THEN 1 ELSE 2 END AS users,
  CAST(ids AS BIGINT) AS ids FROM r JOIN n ON r.g = n.g
"""


def _run_rows(read):
    ids = F.split(F.from_json("raw", "id STRING")["id"], "_")[0].cast("bigint")
    posts = read.posts.groupBy("run_id").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.coalesce(ids, F.lit(0))).alias("ids"))
    users = read.users.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("users"))
    runs = read.runs.select("run_id", "endpoint", F.col("query")["handle"].alias("handle"), "result", "time_taken")
    return runs.join(posts, "run_id").join(users, "run_id")


@query(_SAVED_DUCK)
def snk_9_save_runs(spark, sf):
    path = work_folder(spark, "runs")
    # Documents of at most three posts, so that most runs take two.
    ff.save_runs(_saved(spark, sf, posts_per_document=3), path)
    return _run_rows(ff.read_runs(spark, path, lines=True))


@query(_SAVED_DUCK)
def src_5_read_runs(spark, sf):
    path = work_folder(spark, "run-files")
    ff.save_runs(_saved(spark, sf), path, file_per_run=True)
    return _run_rows(ff.read_runs(spark, path))


@query("SELECT doc_id AS d FROM documents WHERE doc_id % 10 <> 0")
def src_4_read_folder(spark, sf):
    path = work_folder(spark, "folder")
    ff.save_runs(_saved(spark, sf), path, file_per_run=True)
    ids = F.split(F.from_json("raw", "id STRING")["id"], "_")[0].cast("bigint")
    return ff.read_posts(spark, path).select(ids.alias("d")).where(F.col("d").isNotNull())


# ---- streams ----------------------------------------------------------------
def _stream(spark, sf, table, sql):
    """A driver table, one file or a folder of them, as a stream of files, through a derivation."""
    schema, path = a.table(spark, sf, table).schema, f"{sf}/{table}.parquet"
    # A stream reads folders: that of the table, or for one file the folder it lies in.
    folder, glob = (path, None) if files.is_directory(spark, path) else (sf, f"{table}.parquet")
    source = ff.stream_pages(spark, folder, fmt="parquet", schema=schema, glob=glob)
    # The text made of a row is much larger than the row: all tasks share in it.
    source = source.repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=source)


def _page_stream(spark, sf):
    return a.bodies(_stream(spark, sf, "conversations", a.BODIES_SQL))


def _drained(stream, spark, name):
    """Run a stream over all there is, into Parquet, and read that back."""
    path = work_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", path + "-state")
    # A state store has as many parts as a shuffle, and none are merged later: one a core.
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        writer.trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema(stream.schema).parquet(path)


@query(a.BODIES_DUCK + "SELECT run_id, page_seq, length(text) AS text_chars FROM b WHERE form = 3")
def str_1_stream_pages(spark, sf):
    pages = _page_stream(spark, sf).where("form = 3")
    back = _drained(pages.select("run_id", "page_seq", "body"), spark, "stream-pages")
    text = F.from_json(F.concat("body", F.lit("}}")), "data STRUCT<user: STRING>")["data"]["user"]
    return back.select("run_id", "page_seq", F.length(text).cast("bigint").alias("text_chars"))


@query(a.BODIES_DUCK + _ALL_POSTS)
def str_2_stream_posts(spark, sf):
    return _post_columns(_drained(ff.stream_posts(_page_stream(spark, sf)), spark, "stream-posts"))


@query(a.BODIES_DUCK + f"SELECT DISTINCT run_id, post_id FROM ({_ALL_POSTS}) p")
def str_3_stream_dedup(spark, sf):
    posts = ff.stream_dedup(ff.stream_posts(_page_stream(spark, sf)))
    return _drained(posts, spark, "stream-dedup").select("run_id", "post_id")


@query(
    a.BODIES_DUCK
    + f"""SELECT sink, run_id, post_id FROM ({_ALL_POSTS}) p CROSS JOIN (VALUES ('jsonl'), ('callback')) s(sink)"""
)
def str_4_fan_out(spark, sf):
    """Two sinks on one stream: raw posts as JSON lines, and the caller's function."""
    raw, own = work_folder(spark, "sink-raw"), work_folder(spark, "sink-own")

    def keep(batch, batch_id):
        batch.select("run_id", "raw").write.mode("overwrite").parquet(f"{own}/batch_id={batch_id}")

    running = ff.write_stream(
        ff.stream_posts(_page_stream(spark, sf)).withColumn("raw", F.concat(F.lit('{"run":"'), "run_id", F.lit('",'), F.expr("substr(raw, 2)"))),
        [ff.jsonl_sink(raw), None, ff.on_new_posts(keep)],
        checkpoint=work_folder(spark, "sink-state"),
        available_now=True,
    )
    running.awaitTermination()
    from feedframe.functions.posts import post_id

    lines = ff.read_posts(spark, raw, lines=True).select(F.lit("jsonl").alias("sink"), F.from_json("raw", "run STRING")["run"].alias("run_id"), "raw")
    called = spark.read.parquet(own).select(F.lit("callback").alias("sink"), "run_id", "raw")
    return lines.unionByName(called).select("sink", "run_id", post_id(F.col("raw")).alias("post_id"))


@query(a.BODIES_DUCK + f"SELECT run_id, count(*) AS posts FROM ({_ALL_POSTS}) p GROUP BY run_id")
def str_5_on_new_posts(spark, sf):
    """A callback that fails does not stop the stream; a second one still gets each batch."""
    own = work_folder(spark, "callback")

    def fails(batch, batch_id):
        raise RuntimeError("callback")

    def keep(batch, batch_id):
        batch.select("run_id").write.mode("overwrite").parquet(f"{own}/batch_id={batch_id}")

    sinks = [ff.on_new_posts(fails), ff.on_new_posts(keep, on_error="raise")]
    running = ff.write_stream(ff.stream_posts(_page_stream(spark, sf)), sinks, work_folder(spark, "callback-state"), available_now=True)
    running.awaitTermination()
    return spark.read.parquet(own).groupBy("run_id").agg(F.count(F.lit(1)).alias("posts"))


@query(a.BODIES_DUCK + f"SELECT page_seq, count(DISTINCT run_id) AS runs, count(*) AS posts FROM ({_ALL_POSTS}) p GROUP BY page_seq")
def udf_3_batch_callback(spark, sf):
    """The caller's function gets a DataFrame and may do with it what Spark can."""
    own = work_folder(spark, "own")

    def per_page(batch, batch_id):
        batch.groupBy("page_seq", "run_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{own}/batch_id={batch_id}")

    posts = ff.stream_posts(_page_stream(spark, sf))
    ff.write_stream(posts, [ff.on_new_posts(per_page)], work_folder(spark, "own-state"), available_now=True).awaitTermination()
    return spark.read.parquet(own).groupBy("page_seq").agg(F.count_distinct("run_id").alias("runs"), F.sum("n").alias("posts"))


@query(a.STOPS_DUCK + "SELECT run_id, page_seq, iter_index, all_count, streak AS no_progress_streak, sent AS cursor_sent, stop_code FROM kept")
def str_6_stream_stop(spark, sf):
    pages = a.page_bodies(_stream(spark, sf, "events", a.PAGES_SQL.format(k=a.K_SPARK)))
    stops = ff.stream_stop(ff.stream_page_rows(pages), **a.CAPS)
    return _drained(stops, spark, "stream-stop").select(
        "run_id", "page_seq", "iter_index", "all_count", "no_progress_streak", "cursor_sent", "stop_code"
    )


@query(a.BODIES_DUCK + f"SELECT run_id, post_id FROM ({_ALL_POSTS}) p")
def str_7_append_again(spark, sf):
    """The same batch written twice, as after a crash, is there once."""
    raw = work_folder(spark, "twice")
    sink = ff.jsonl_sink(raw)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    posts = ff.stream_posts(_page_stream(spark, sf)).withColumn("raw", F.concat(F.lit('{"run":"'), "run_id", F.lit('",'), F.expr("substr(raw, 2)")))
    ff.write_stream(posts, [twice], work_folder(spark, "twice-state"), available_now=True).awaitTermination()
    from feedframe.functions.posts import post_id

    return ff.read_posts(spark, raw, lines=True).select(
        F.from_json("raw", "run STRING")["run"].alias("run_id"), post_id(F.col("raw")).alias("post_id")
    )
