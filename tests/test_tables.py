"""Driver tables in every layout: one file, folders of files, row groups that one task reads."""

import pytest
from pyspark.sql import functions as F

import feedframe as ff
from checks import QUERIES
from checks import adapters as a
from feedframe.session import materialize

TURNS = [(c, t, "user", f"text {c} {t}") for c in (0, 1, 4, 5, 8, 9) for t in range(4)]


@pytest.mark.parametrize("name", ["str_4_fan_out", "str_5_on_new_posts", "str_7_append_again", "udf_3_batch_callback"])
def test_streams_read_a_table_that_is_a_folder(spark, tmp_path, name):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    turns.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    posts = ff.route_posts(ff.payload_rows(ff.parse_responses(a.response_pages(spark, f"{tmp_path}/folder")))).count()
    found = QUERIES[name](spark, f"{tmp_path}/folder")
    counted = found.agg(F.sum("posts")).first()[0] if "posts" in found.columns else found.count()
    assert counted == posts * (2 if name == "str_4_fan_out" else 1) > 0


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    """A file of many splits whose rows all lie in one row group."""
    monkeypatch.setattr(a, "TASK_ROWS", 200)
    spark.range(2000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "1k")
    try:
        assert a.table(spark, str(tmp_path), "events").rdd.getNumPartitions() > 4
        rows = a.derive(spark, str(tmp_path), "SELECT event_id FROM events", "events")
        tasks = rows.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(size)
    assert sum(t["count"] for t in tasks) == 2000
    assert len(tasks) == 10 and max(t["count"] for t in tasks) < 300


def test_rows_are_dealt_out_without_a_sort(spark, tmp_path, monkeypatch, capsys):
    """Equal rows and null keys too: their values do not decide where they go."""
    monkeypatch.setattr(a, "TASK_ROWS", 200)
    spark.range(2000).select(F.lit(None).cast("long").alias("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = a.derive(spark, str(tmp_path), "SELECT event_id FROM events", "events")
    rows.explain()
    assert "RoundRobinPartitioning" not in capsys.readouterr().out
    assert rows.columns == ["event_id"]
    tasks = [t["count"] for t in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2000 and len(tasks) == 10 and max(tasks) < 300


def test_long_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        materialize(spark.range(1), "one")
        texts = spark.range(2000).coalesce(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 20_000_000 and max(found) < 6_000_000
        spark.conf.set(name, "1m")
        materialize(spark.range(1), "one")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
