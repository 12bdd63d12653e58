"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within its source the documents stand in the order of
that key, prefix sums of their word counts run along this order, and the source's budget
cuts it at an exact word. A budget above the source's size takes the whole source once per
full epoch and cuts the last epoch.

The prefix sums have two levels. The key's leading bits name a bin; bins of a source are
ordered as the keys are, so sums per bin (aggregated before the shuffle), running sums over
bins, and running sums inside one bin add up to the running sum of the source. A source that
holds a third of all rows has as many bins as that takes: no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedframe.session import materialize

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bin, about.
BIN_ROWS = 20_000


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The target of each source, from one row per source with its ``source_size``.

    Sources in order of code points, null last, weigh ``weights`` in turn. Together they
    get ``share`` times all sizes; no target exceeds ``most`` times its source's size, and
    what it would exceed it by goes to the others by weight, again and again. The fixed
    point is found directly: by rising ``cap / weight``, sources are full as long as the
    level that the rest would get is not below their own; the rest get the first level
    that is.

    Takes and gives one row per source (``source, source_size`` and ``weight, target``),
    so its windows see sources, not documents.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("_place", F.row_number().over(named) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    level = (F.col("_all") * share - F.col("_full")) / F.col("_free")
    found = (
        ranked.withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_level") < F.col("_ratio"))
    )
    first_open = F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_ratio"))).over(everything)
    return found.withColumn("_first", first_open).select(
        "source", "source_size", "weight", F.when(F.col("_open"), F.col("weight") * F.col("_first")).otherwise(F.col("_cap")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes.

    Gives one row per row of ``docs``: ``doc_id, source, doc_key, size, source_size,
    target, taken``. ``taken`` counts repeats; over a source it sums to the whole number
    below its target. ``doc_key`` hashes id and text, to find the row again.

    A null text has size 0, a null source is a source of its own (the last), a null id is
    a value like others. Sources without words have target 0. Equal rows stand next to each
    other and are told apart by nothing, so which of them is cut does not show. Columns of
    ``docs`` other than the three are not read, whatever their names. An empty table gives
    no rows. The result depends on the rows only, not on their order or partitions.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc_key"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_key"),
        n_words(F.col(text_col)).alias("size"),
    )
    rows = materialize(rows, "mix-sizes")  # sums and cut read a few numbers per document, not the texts again
    bins = max(1, rows.count() // BIN_ROWS)
    rows = rows.withColumn("_bin", F.floor((F.shiftrightunsigned("_key", 16) / F.lit(float(1 << 48))) * bins))
    sums = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_bin_size"))
    by_bin = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_bin_size").over(by_bin), F.lit(0)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = sums.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b._bin", "b._base", "t.source_size", "t.target")
    inside = Window.partitionBy("r.source", "r._bin").orderBy(F.shiftrightunsigned("_key", 16), "_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._bin") == F.col("p._bin")))
    before = F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - F.col("_epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    return (
        placed.withColumn("_before", before)
        .withColumn("_epochs", epochs)
        .withColumn("_rest", rest)
        .select("doc_id", F.col("r.source").alias("source"), "doc_key", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + cut).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its budget says, with its own columns.

    Documents are not cut here: the one at the end of a source's budget comes once more if
    at least half of it is inside. All columns pass, also when they are named as those of
    this module.
    """
    names = docs.columns
    given = {k: options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"))}
    key = F.xxhash64(F.col(given["id_col"]), F.col(given["text_col"]))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_at"))
    taken = mix_sources(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    # Equal rows share a key: each stands for the same number of rows, so their copies are dealt out together.
    per_key = taken.withColumn("_times", times).groupBy("doc_key").agg(F.sum("_times").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    numbered = Window.partitionBy("_at").orderBy(F.lit(0))
    rows = keyed.join(per_key, keyed["_at"] == per_key["doc_key"]).withColumn("_nth", F.row_number().over(numbered) - 1)
    own = F.floor(F.col("_sum") / F.col("_rows")) + F.when(F.col("_nth") < F.col("_sum") % F.col("_rows"), 1).otherwise(0)
    copies = F.explode(F.when(own > 0, F.sequence(F.lit(1), own.cast("int"))).otherwise(F.array().cast("array<int>")))
    return rows.select("_row", copies.alias("_copy")).select("_row.*")
