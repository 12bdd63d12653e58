"""Running values along the pages of a run.

A window over a whole run would put a run of any length into one task. Here pages are
range-partitioned by (run, sequence): each partition is a chunk of some run or of several,
whatever numbers the pages carry. The chunks are stored once, so that every later step sees
the same cuts, also after a lost executor. Then come a window inside each chunk, a second
one over a carry row per run and chunk, and a join that adds what came before the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedframe.session import materialize, size_by_rows

CHUNK = "_chunk"


def in_chunks(df: DataFrame, run: str, seq: tuple[str, ...]) -> DataFrame:
    """Rows with the number of their range partition, stored."""
    size_by_rows(df.sparkSession)
    dealt = df.repartitionByRange(F.col(run), *[F.col(c) for c in seq])
    return materialize(dealt.withColumn(CHUNK, F.spark_partition_id()), "running-chunks")


def running(
    df: DataFrame,
    run: str = "run_id",
    seq: str | tuple[str, ...] = "page_seq",
    index: str = "iter_index",
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    since: dict[str, Column] | None = None,
    counted: Column | None = None,
) -> DataFrame:
    """Add running columns along ``seq`` within each ``run``.

    * ``index`` -- position of the row, from 0;
    * ``sums`` -- totals up to and including the row;
    * ``previous`` -- value at the row before (null on the first);
    * ``since`` -- rows after the last one where the condition held (the whole count so
      far when it never did).

    With ``counted`` only rows that meet it have a position, are a row before, or count in
    ``since``; ``sums`` take all rows. On other rows the three are those of the counted row
    in front. ``seq`` is one or more columns of any type, unique within the run.
    """
    seq = (seq,) if isinstance(seq, str) else tuple(seq)
    sums, previous, since = sums or {}, previous or {}, since or {}
    rows = in_chunks(df.withColumn("_counted", F.coalesce(counted, F.lit(False)) if counted is not None else F.lit(True)), run, seq)
    inside = Window.partitionBy(run, CHUNK).orderBy(*seq)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("_counted")

    local = rows.select(
        "*",
        F.row_number().over(inside).alias("_row"),
        F.sum(here.cast("bigint")).over(so_far).alias("_n"),
        *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_sum_{k}") for k, c in sums.items()],
        # In a struct, so that a null value is told from no row.
        *[F.last(F.when(here, F.struct(c.alias("value"))), True).over(ahead).alias(f"_prev_{k}") for k, c in previous.items()],
        *[F.when(here, F.struct(c.alias("value"))).alias(f"_at_{k}") for k, c in previous.items()],
        *[F.coalesce(c, F.lit(False)).alias(f"_mark_{k}") for k, c in since.items()],
    ).select(
        "*",
        *[F.max(F.when(here & F.col(f"_mark_{k}"), F.col("_n"))).over(so_far).alias(f"_last_{k}") for k in since],
    )

    chunks = local.groupBy(run, CHUNK).agg(
        F.max("_n").alias("_n"),
        *[F.max_by(f"_sum_{k}", "_row").alias(f"_sum_{k}") for k in sums],
        *[F.max_by(f"_at_{k}", F.when(here, F.col("_row"))).alias(f"_at_{k}") for k in previous],
        *[F.max(f"_last_{k}").alias(f"_last_{k}") for k in since],
    )
    across = Window.partitionBy(run).orderBy(CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        "*",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_sum0_{k}") for k in sums],
        *[F.last(f"_at_{k}", True).over(before).alias(f"_prev0_{k}") for k in previous],
    ).select(
        F.col(run),
        F.col(CHUNK),
        "_before",
        *[f"_sum0_{k}" for k in sums],
        *[f"_prev0_{k}" for k in previous],
        *[F.max(F.col("_before") + F.col(f"_last_{k}")).over(before).alias(f"_last0_{k}") for k in since],
    )

    # A run may have no name; its rows still find their carry.
    joined = local.alias("l").join(carried.alias("c"), F.col(f"l.{run}").eqNullSafe(F.col(f"c.{run}")) & (F.col(f"l.{CHUNK}") == F.col(f"c.{CHUNK}")))
    position = F.col("_before") + F.col("_n")
    return joined.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        (position - 1).alias(index),
        *[(F.col(f"_sum0_{k}") + F.col(f"_sum_{k}")).alias(k) for k in sums],
        *[F.coalesce(F.col(f"_prev_{k}"), F.col(f"_prev0_{k}"))["value"].alias(k) for k in previous],
        *[
            (
                position
                - F.coalesce(F.col("_before") + F.col(f"_last_{k}"), F.col(f"_last0_{k}"), F.lit(0))
            ).alias(k)
            for k in since
        ],
    )
