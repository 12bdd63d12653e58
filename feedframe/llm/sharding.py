"""Shuffling documents into shards: a two-pass external shuffle.

Pass one scatters whole rows into buckets that fit in memory, by a seeded hash. Pass two
shuffles each bucket with Fisher-Yates, its random numbers seeded by the bucket, and writes
it. Buckets stand one after another, so a row's place in its bucket plus the rows of the
buckets before is its place in one random order of all rows; shards are equal stretches of
that order, which differ by one row at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedframe.session import materialize, work_folder

#: Bytes of text of a bucket, about: what one task shuffles.
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: tuple[int, int]) -> np.ndarray:
    """A random order of ``n`` rows: from the last place down, swap with a random place not above."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64(np.abs(np.array(seed, dtype=np.int64)).tolist()))
    partners = draws.integers(0, np.arange(n, 0, -1))
    for i, j in zip(range(n - 1, 0, -1), partners.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def _shuffler(seed: int):
    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket; each bucket's order needs its size only, never its texts.
        current, order, done = None, None, 0
        for batch in batches:
            at, sizes, offsets = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            places = np.empty(len(at), dtype=np.int64)
            begin = 0
            while begin < len(at):
                end = begin + int(np.searchsorted(at[begin:], at[begin], side="right"))
                if at[begin] != current:
                    current, done = at[begin], 0
                    order = fisher_yates(int(sizes[begin]), (seed, int(current)))
                places[begin:end] = offsets[begin] + order[done : done + end - begin]
                done += end - begin
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(places), batch.column(3)], names=["_pos", "_row"])

    return shuffle


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless).

    Shards hold numbers of rows at most one apart. Rows come out ordered by place inside
    each task. Null texts and ids are values like others; equal rows get places of their
    own; an empty table gives no rows. Columns of ``docs`` pass unchanged, except that
    their own ``shard`` and ``slot``, if any, are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    keyed = docs.select(
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
    )
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 64
    total = docs.select(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // bucket_bytes))
    keyed = keyed.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))), "bucket-counts")
    n_rows = max(1, int(counts.select(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]))
    # The scatter: one shuffle, whose partitioning the join with the counts keeps.
    scattered = keyed.repartition(buckets, "_bucket").join(counts, "_bucket")
    scattered = scattered.sortWithinPartitions("_bucket", F.xxhash64(F.lit(seed + 1), "_h"), F.col(f"_row.`{id_col}`"))
    out = T.StructType([T.StructField("_pos", T.LongType()), T.StructField("_row", keyed.schema["_row"].dataType)])
    placed = scattered.select("_bucket", "_n", "_offset", "_row").mapInArrow(_shuffler(seed), out)
    shard = F.expr(f"((_pos + 1) * {shards} - 1) div {n_rows}")
    start = F.expr(f"(shard * {n_rows}L) div {shards}")
    return (
        placed.sortWithinPartitions("_pos")
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_pos") - start).cast("long"))
        .select("_row.*", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shuffled rows as Parquet, a folder for each shard, and read them back.

    Files of a shard hold consecutive slots in order. ``path`` is a folder in the shared
    store; by default a fresh one below ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    out = path or work_folder(spark, "shards")
    rows = shuffled(docs, **options)
    rows.write.partitionBy("shard").parquet(out)
    schema = T.StructType([f for f in rows.schema if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)
