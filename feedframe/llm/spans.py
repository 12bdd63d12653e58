"""Substring dedup by compaction of a de Bruijn graph.

The graph's edges are windows of 13 words, from the node of the first twelve to that of the
last twelve. Only edges that occur in several documents matter, and a path of them that
never branches is one repeated passage.

1. *Bins.* The least hashed run of ``BIN_WORDS`` words in a window, its minimizer, is the same in
   each occurrence of the window. Texts emit their distinct minimizers; those of one text
   only cannot belong to a repeated edge, and their windows go no further. Exact copies
   share a key, so a group of copies counts as its first document here.
2. *Edges.* Runs of windows with the same live minimizer are pieces of paths. Equal pieces
   meet first; a bin in which all pieces are equal does not branch, and the first document,
   by id, that holds the piece is the source of all its edges. Only in the other bins are
   pieces cut into edges, and each edge gets its own source.
3. *Compaction.* Edges that follow on from each other both in a text and in its source lie on
   a path that does not branch between them: they join into one span with one source.
4. *Check.* The words of each span are compared, by a 128-bit digest, with those at its
   source coordinates. What a span that agrees covers is removed.

Texts are shuffled by key, and only those that may have a partner; the rest of the work
moves hashes and places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedframe.llm.words import VISIBLE, Chunk, KeyFilter, chunks, salted, sequences, signed
from feedframe.session import materialize

#: Words of an edge, and of a minimizer.
WINDOW, BIN_WORDS = 13, 6


def minimizers(chunk: Chunk, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of all windows of a chunk, and the minimizer of each."""
    at = chunk.windows(window)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    small = salted(sequences(hashes, BIN_WORDS), 5)
    # The least of w consecutive values, by doubling: of 2, 4, ... and of two that overlap.
    width, have, low = window - BIN_WORDS + 1, 1, small
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = width - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return at, low[at]


def _bins(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct minimizers of each text that is new to this task: copies meet before the shuffle."""
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for key in batch.column(0).to_pylist():
                fresh.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1), VISIBLE):
                at, least = minimizers(chunk, chunk.hashes(), window)
                owner = chunk.owners()[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                owner, least = owner[new], least[new]
                order = np.lexsort((least, owner))
                owner, least = owner[order], least[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([signed(least[new]), pa.array(keys[chunk.first + owner[new]])], names=["bin", "key"])

    return emit


def _pieces(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows with one live minimizer: the edges of each as an array of hashes."""
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            for chunk in chunks(batch.column(2), VISIBLE):
                hashes = chunk.hashes()
                at, least = minimizers(chunk, hashes, window)
                if not len(at):
                    continue
                owner = chunk.owners()[at]
                live = np.zeros(len(at), dtype=bool)
                cuts = np.searchsorted(owner, np.arange(chunk.n_texts + 1))
                for t in range(chunk.n_texts):
                    bins = lists[chunk.first + t].values
                    if bins is not None and len(bins):
                        live[cuts[t] : cuts[t + 1]] = np.isin(least[cuts[t] : cuts[t + 1]].view(np.int64), bins.to_numpy(zero_copy_only=False))
                kept = np.flatnonzero(live)
                if not len(kept):
                    continue
                edges = sequences(hashes, window)[at[kept]]
                place, least, owner = at[kept], least[kept], owner[kept]
                new = np.ones(len(kept), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(kept)))
                # Two fingerprints of a piece's edges tell equal pieces.
                whole = np.add.reduceat(salted(edges, 1) * (np.arange(len(edges), dtype=np.uint64) - np.repeat(heads, sizes).astype(np.uint64) + np.uint64(1)), heads)
                offsets = pa.array(np.append(heads, len(edges)).astype(np.int32))
                texts = owner[heads]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(least[heads]),
                        signed(salted(whole, 2) + sizes.astype(np.uint64)),
                        pa.array(ids[chunk.first + texts]),
                        pa.array(keys[chunk.first + texts]),
                        pa.array((place[heads] - chunk.bounds[texts]).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, signed(edges)),
                    ],
                    names=["bin", "piece", "doc_id", "key", "begin", "edges"],
                )

    return emit


_PIECE = "bin long, piece long, doc_id long, key long, begin int, edges array<long>"
_SPAN = ("key", "begin", "words", "source_key", "source_begin")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bin, those whose bin has another row; looks one row back and one ahead."""
    held, before = None, None
    for batch in batches:
        bins, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(bins):
            continue
        if held is not None:
            bins, keys = np.append(held[0], bins), np.append(held[1], keys)
        same = bins[1:] == bins[:-1]
        live = np.append(same, False)
        live[1:] |= same
        live[0] |= before == bins[0]
        if len(bins) > 1:
            before = bins[-2]
        held = bins[-1:], keys[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(bins[:-1][live[:-1]]), pa.array(keys[:-1][live[:-1]])], names=["bin", "key"])
    if held is not None and before == held[0][0]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["bin", "key"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The first document, by id, of each text: ``key, sha, doc_id, n``. Rows without id are not among them."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "key", "sha")
    return rows.groupBy("key", "sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def repeated_spans(docs: DataFrame, firsts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of first documents that an earlier one holds: ``key, begin, words, source_key, source_begin``.

    ``docs`` has ``doc_id, key, sha, text``, ``firsts`` comes from ``distinct_texts``;
    ``begin`` and ``words`` count words. Spans of one source do not overlap.
    """
    usable = docs.where(F.col("doc_id").isNotNull())
    bins = usable.select("key", "text").mapInArrow(_bins(window), "bin long, key long")
    # Copies share a key and a bin: one row stands for all, as far as they meet before the shuffle.
    live = bins.repartition("bin").sortWithinPartitions("bin", "key").mapInArrow(_distinct, "bin long, key long").mapInArrow(_neighbours, "bin long, key long")
    of_text = live.groupBy("key").agg(F.collect_list("bin").alias("bins")).join(firsts.select("key", F.col("doc_id").alias("first_id"), F.col("sha").alias("first_sha")), "key")
    of_text = materialize(of_text, "span-bins")
    # Joined by id too: of a group of copies one row meets, wherever the others are.
    texts = usable.alias("d").join(of_text.alias("t"), F.expr("d.key = t.key and doc_id = first_id and sha = first_sha"))
    pieces = materialize(texts.select("doc_id", "d.key", "text", "bins").mapInArrow(_pieces(window), _PIECE), "span-pieces")
    place = F.struct("doc_id", "begin", "key")
    kinds = materialize(pieces.groupBy("bin", "piece").agg(F.min(place).alias("first")), "span-kinds")
    # Most bins have one kind of piece: its first place is the source of all its edges.
    branching = materialize(kinds.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bin"), "span-branching")
    occurrences = pieces.select("bin", "piece", "doc_id", "key", "begin", F.size("edges").alias("n_edges"))
    alone = occurrences.join(kinds, ["bin", "piece"]).where("first.doc_id < doc_id").select(
        "key", "begin", (F.col("n_edges") + window - 1).alias("words"), F.col("first.key").alias("source_key"), F.col("first.begin").alias("source_begin")
    )
    # Where kinds of pieces meet, each edge of the first document of each gets the first place of all as its source.
    some = KeyFilter(branching, "bin")
    meeting = pieces.where(some.may_hold("bin")).join(kinds, ["bin", "piece"]).where("doc_id = first.doc_id")
    edges = meeting.select("bin", "doc_id", "key", "begin", F.posexplode("edges").alias("k", "edge"))
    edges = materialize(edges.select("bin", "edge", "key", "doc_id", (F.col("begin") + F.col("k")).alias("at")), "span-edges")
    sources = edges.groupBy("bin", "edge").agg(F.min(F.struct("doc_id", "at", "key")).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = edges.join(sources, ["bin", "edge"]).where("source.doc_id < doc_id").select(
        "key", F.col("at").alias("begin"), F.lit(window).alias("words"), F.col("source.key").alias("source_key"), F.col("source.at").alias("source_begin")
    )
    return compacted(alone.unionByName(met))


def compacted(spans: DataFrame) -> DataFrame:
    """Join spans that follow on from each other both in a text and in its source: a path that does not branch."""
    diagonal = Window.partitionBy("key", "source_key", "shift").orderBy("begin", "words")
    rows = spans.withColumn("shift", F.col("source_begin") - F.col("begin")).withColumn("end", F.col("begin") + F.col("words"))
    reach = F.max("end").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach >= F.col("begin"), 0).otherwise(1)).withColumn("path", F.sum("new").over(diagonal))
    joined = rows.groupBy("key", "source_key", "shift", "path").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return joined.select("key", "begin", (F.col("end") - F.col("begin")).cast("int").alias("words"), "source_key", (F.col("begin") + F.col("shift")).cast("int").alias("source_begin"))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bin and key, each once."""
    last = None
    for batch in batches:
        bins, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(bins):
            continue
        new = np.ones(len(bins), dtype=bool)
        new[1:] = (bins[1:] != bins[:-1]) | (keys[1:] != keys[:-1])
        new[0] = last != (bins[0], keys[0])
        last = bins[-1], keys[-1]
        yield pa.RecordBatch.from_arrays([pa.array(bins[new]), pa.array(keys[new])], names=["bin", "key"])


def _digest(stream: memoryview) -> bytes:
    return hashlib.blake2b(stream, digest_size=16).digest()


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words at each place asked for in a text."""
    for batch in batches:
        keys, wanted = batch.column(0).to_pylist(), batch.column(2)
        for chunk in chunks(batch.column(1), VISIBLE):
            out, _, starts = chunk.stream()
            raw = memoryview(np.ascontiguousarray(out))
            rows = []
            for t in range(chunk.n_texts):
                for place in wanted[chunk.first + t].as_py():
                    a = chunk.bounds[t] + place["source_begin"]
                    z = a + place["words"] - 1
                    if z < chunk.bounds[t + 1]:
                        rows.append((keys[chunk.first + t], place["source_begin"], place["words"], _digest(raw[starts[a] : starts[z] + chunk.ends[z] - chunk.starts[z]])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source_key", "source_begin", "words", "digest"])


def _remover(window: int, keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, spans = batch.column(2), batch.column(3)
            parts: list[tuple] = []
            for chunk in chunks(batch.column(1), VISIBLE):
                gone = np.zeros(len(chunk.starts), dtype=bool)
                raw = starts = None
                for t in range(chunk.n_texts):
                    first, last = chunk.bounds[t], chunk.bounds[t + 1]
                    if copies[chunk.first + t].as_py():
                        gone[first:last] = last - first >= window
                        continue
                    for span in spans[chunk.first + t].as_py() or ():
                        if raw is None:
                            out, _, starts = chunk.stream()
                            raw = memoryview(np.ascontiguousarray(out))
                        a = first + span["begin"]
                        z = a + span["words"] - 1
                        if z < last and _digest(raw[starts[a] : starts[z] + chunk.ends[z] - chunk.starts[z]]) == span["digest"]:
                            gone[a : z + 1] = True
                out, offsets, _ = chunk.stream(~gone)
                raw, offsets = memoryview(np.ascontiguousarray(out)), offsets.tolist()
                removed = np.add.reduceat(np.append(gone, False), chunk.bounds[:-1], dtype=np.int64) if len(gone) else np.zeros(chunk.n_texts, dtype=np.int64)
                removed[chunk.counts == 0] = 0
                for t in range(chunk.n_texts):
                    kept = raw[offsets[t] : offsets[t + 1]]
                    parts.append((int(chunk.counts[t]), int(removed[t]), hashlib.sha256(kept).hexdigest(), str(kept, "utf-8", "replace") if keep_text else None))
            columns = list(zip(*parts, strict=True)) if parts else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return remove


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Each row of ``docs`` without the words that an earlier document holds.

    A word goes if a window of ``window`` consecutive words over it also starts in a
    document with a smaller id. Gives ``doc_id, n_words, n_removed, kept_sha256`` and
    ``kept_text`` (null unless asked for), a row for each row of ``docs``.

    A null text has no words. A row without id is kept whole and is no source, as no id is
    smaller than none. Rows with one id are one document each and do not remove from one
    another. Texts shorter than a window stay. Other columns are not read; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"))
    firsts = materialize(distinct_texts(rows), "span-firsts")
    spans = materialize(repeated_spans(rows, firsts, window), "spans")
    places = spans.select("source_key", "source_begin", "words").distinct().groupBy("source_key").agg(F.collect_list(F.struct("source_begin", "words")).alias("places"))
    places = places.join(firsts.select(F.col("key").alias("source_key"), F.col("doc_id").alias("first_id"), F.col("sha").alias("first_sha")), "source_key")
    holders = KeyFilter(spans, "source_key")
    asked = rows.where(holders.may_hold("key")).join(places, F.expr("key = source_key and doc_id = first_id and sha = first_sha"))
    digests = asked.select("key", "text", "places").mapInArrow(_source_digests, "source_key long, source_begin int, words int, digest binary").distinct()
    checked = spans.join(digests, ["source_key", "source_begin", "words"]).groupBy("key").agg(F.collect_list(F.struct("begin", "words", "digest")).alias("spans"))
    plan = firsts.join(checked, "key", "left").where("n > 1 or spans is not null").select(F.col("key").alias("k"), F.col("sha").alias("s"), F.col("doc_id").alias("first_id"), "spans")
    plan = materialize(plan, "span-plan")
    touched = KeyFilter(plan, "k").may_hold("key")
    marked = rows.withColumn("touched", touched)
    joined = marked.where("touched").join(plan, (F.col("key") == F.col("k")) & (F.col("sha") == F.col("s")), "left")
    changed = joined.select("doc_id", "text", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy"), F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans"))
    plain = marked.where("not touched").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(changed.schema["spans"].dataType).alias("spans"))
    kept = _remover(window, keep_text)
    return changed.mapInArrow(kept, _KEPT).unionByName(plain.mapInArrow(kept, _KEPT))
