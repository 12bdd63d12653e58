"""Benchmark decontamination: a prefix-filtered set join.

A window (ten words of an item, or a whole shorter item) occurs in a text only if all its
shingles do, so one shingle of each window is enough to join on: its necessary prefix. The
shingles of a window are ordered by how often they occur in all documents, and the rarest
one is the prefix. Where it occurs in a text, its place in the window says where the window
would have to begin and end (positional and length bounds); windows that fit are verified
by their words.

The scan over the documents keeps a position only if its shingle may be a prefix and a
window that fits there may be one of the benchmark's, by bitmaps of one size for any
benchmark; beyond what they can hold apart more positions pass, and the join decides. Joins carry no hint: Spark broadcasts
the windows if their measured size allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedframe.llm.words import ALNUM, KeyFilter, chunks, sequences, signed
from feedframe.session import materialize

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each item, a row for each shingle in it."""
    names = ["item", "window", "shingle", "place", "size", "words"]
    for batch in batches:
        for chunk in chunks(batch.column(1), ALNUM, lower=True):
            hashes = chunk.hashes()
            rows: list[tuple] = []
            for t in range(chunk.n_texts):
                a, b = chunk.bounds[t], chunk.bounds[t + 1]
                size = min(WINDOW, b - a)
                for s in range(a, b - size + 1) if size else ():
                    key = int(sequences(hashes[s : s + size], size)[0])
                    wide = min(SHINGLE, size)
                    for place, shingle in enumerate(sequences(hashes[s : s + size], wide)):
                        rows.append((batch.column(0)[chunk.first + t].as_py(), key, int(shingle), place, size, chunk.joined(s, s + size).decode()))
            item, window, shingle, place, size, words = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), signed(np.array(window, np.uint64)), signed(np.array(shingle, np.uint64)), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(words, pa.string())],
                names=names,
            )


def _counter(possible, widths: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of possible shingles, summed over each chunk."""
        for batch in batches:
            for chunk in chunks(batch.column(0), ALNUM, lower=True):
                hashes = chunk.hashes()
                found = [np.zeros(0, dtype=np.uint64)]
                for wide in widths:
                    values = sequences(hashes, wide)[chunk.windows(wide)]
                    found.append(values[possible(values)])
                values, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(values), pa.array(times.astype(np.int64))], names=["shingle", "times"])

    return count


_HITS = "row long, doc_id long, key long, n_words long, hits array<struct<shingle:bigint,place:int,size:int,words:string,starts:array<int>>>"
_HIT = pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("words", pa.string()), ("starts", pa.list_(pa.int32()))]))


def _searcher(by_prefix, by_window, shapes: list[tuple[int, int, int]]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text with the windows that may occur in it: where its prefix and its hash are possible."""
        for batch in batches:
            counts, hits = [], []
            for chunk in chunks(batch.column(3), ALNUM, lower=True):
                hashes, found = chunk.hashes(), [{} for _ in range(chunk.n_texts)]
                of_width: dict[int, tuple] = {}
                for wide, place, size in shapes:
                    if wide not in of_width:
                        at = chunk.windows(wide)
                        values = sequences(hashes, wide)[at] if len(at) else np.zeros(0, dtype=np.uint64)
                        possible = by_prefix(values)
                        at = at[possible]
                        of_width[wide] = at, values[possible], np.searchsorted(chunk.bounds, at, side="right") - 1
                    at, values, owner = of_width[wide]
                    start = at - place
                    fits = np.flatnonzero((start >= chunk.bounds[owner]) & (start + size <= chunk.bounds[owner + 1]))
                    if not len(fits):
                        continue
                    total = sequences(hashes, size)[start[fits]]
                    for k in fits[by_window(total)].tolist():
                        t = int(owner[k])
                        words = chunk.joined(start[k], start[k] + size)
                        key = (int(values[k]), place, size, words)
                        found[t].setdefault(key, []).append(int(start[k] - chunk.bounds[t]))
                counts.append(chunk.counts)
                hits += found
            lists = [[{"shingle": s - (1 << 64) if s >> 63 else s, "place": p, "size": n, "words": w.decode(), "starts": starts} for (s, p, n, w), starts in f.items()] for f in hits]
            sizes = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes.astype(np.int64)), pa.array(lists, _HIT)], names=["row", "doc_id", "key", "n_words", "hits"])

    return search


def benchmark_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Windows of the items with their prefix: ``item, window, size, words, shingle, place``.

    The prefix is the shingle of the window that all ``docs`` together hold least often (of
    equally rare ones the first).
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    shingles = materialize(items.mapInArrow(_item_windows, "item string, window long, shingle long, place int, size int, words string"), "benchmark-shingles")
    widths = [r[0] for r in shingles.select(F.least(F.lit(SHINGLE), F.col("size"))).distinct().collect()]  # at most SHINGLE numbers
    possible = KeyFilter(shingles, "shingle")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    times = texts.mapInArrow(_counter(possible.tester(), widths), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    ranked = shingles.join(times, "shingle", "left").select("*", F.coalesce("times", F.lit(0)).alias("rarity"))
    best = ranked.groupBy("item", "window", "size", "words").agg(F.min(F.struct("rarity", "place", "shingle")).alias("best"))
    return materialize(best.select("item", "window", "size", "words", "best.shingle", "best.place"), "benchmark-windows")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, key, n_words, n_hit, items``.

    ``n_hit`` counts words inside any occurrence of a window; ``items`` holds the ids of
    items with occurring windows as sorted strings. ``row`` numbers the rows
    of ``docs`` and ``key`` hashes the text.
    A null text has no words and a null item text no window; a null item id is passed over;
    items of equal text count each; equal rows of either table are kept. Other columns are
    not read. Empty tables give no rows, or rows without hits.
    """
    windows = benchmark_windows(docs, benchmark, text_col, item_col, item_text_col)
    shapes = [tuple(r) for r in windows.select(F.least(F.lit(SHINGLE), F.col("size")), "place", "size").distinct().collect()]  # at most WINDOW**2 / 2
    prefixes = KeyFilter(windows, "shingle")
    whole = KeyFilter(windows, "window")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    scanned = materialize(texts.mapInArrow(_searcher(prefixes.tester(), whole.tester(), sorted(shapes)), _HITS), "benchmark-scan")
    candidates = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    exact = windows.select("shingle", "place", "size", "words").distinct()
    found = materialize(candidates.join(exact, ["shingle", "place", "size", "words"]), "benchmark-found")
    covered = found.select("row", "size", F.explode("starts").alias("start")).select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word"))
    n_hit = covered.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    of_item = windows.where("item is not null").select("item", "size", "words").distinct()
    items = found.select("row", "size", "words").join(of_item, ["size", "words"]).select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        scanned.select("row", "doc_id", "key", "n_words")
        .join(n_hit, "row", "left")
        .join(items, "row", "left")
        .select("row", "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no window of the benchmark occurs."""
    hit = benchmark_hits(docs, benchmark, text_col=text_col, **options).where("n_hit > 0").select(F.col("key").alias("_key")).distinct()
    hit = materialize(hit, "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_at"))
    rows = rows.withColumn("_maybe", KeyFilter(hit, "_key").may_hold("_at"))
    clean = rows.where("not _maybe").select("_row.*")
    return clean.unionByName(rows.where("_maybe").join(hit, F.col("_at") == F.col("_key"), "left_anti").select("_row.*"))
