"""Substring dedup by a depth-limited radix sort of suffixes.

Suffixes count only through their first 100 bytes (the window), so equal groups of the
sort are exactly the repeated windows. Digits are read from the most significant on, and a
group of one drops out of all later passes:

1. *Anchor digit.* A window's first digit is the least of its grams of ``GRAM`` bytes by
   hash, its anchor. Consecutive windows share it: a run. So the first pass counts runs, not
   suffixes; a run whose anchor occurs once holds no repeated window.
2. *Run digit.* Runs with the same anchor are told apart by all bytes that their windows
   cover. Equal runs are equal in each window: all but the first are settled as repeats, and the
   first stands for them from here on.
3. *Byte digits.* Where runs of different bytes share an anchor, their windows are sorted
   through the window's end, ``DIGIT`` bytes a pass, by bins that tasks own. A bin of more runs
   than a task should hold is grouped window by window instead, combined before the shuffle.

Exact copies are found first, by digest; one document of each text is sorted. Grams and
runs are told apart by 64-bit hashes of each (so by 128 bits), windows of pass 3 byte by
byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedframe.llm.words import KeyFilter, _power_tables, buffers, mixed, salted, signed
from feedframe.session import materialize, release

#: Bytes of text looked at together; a longer single text is looked at alone.
PART_BYTES = 1 << 18
#: Bytes of a window, of a gram of the first digit, and of a digit of the last passes.
WINDOW, GRAM, DIGIT = 100, 40, 25
#: Runs of a bin that one task sorts, at most; bytes of runs that it sorts at once, about.
BIN_RUNS, SORT_BYTES = 1 << 15, 1 << 20

_RUN = "bin long, piece long, doc_id long, key long, begin int, size int"
_BYTES = "bin long, doc_id long, key long, begin int, bytes binary"
_SPAN = "doc_id long, key long, begin int, size int"
_LOW = np.uint64(0xFFFFFFFF)


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes and offsets of about ``PART_BYTES`` of whole texts at a time."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PART_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Runs:
    """The runs of windows of some texts: ``starts`` and ``sizes`` in windows, and the anchor of each."""

    def __init__(self, data: np.ndarray, texts: np.ndarray, window: int, gram: int):
        n = len(data) - window + 1
        self.window = window
        none = np.zeros(0, dtype=np.int64)
        self.starts, self.sizes, self.owner, self.bins = none, none, none, none.view(np.uint64)
        if n < 1:
            return
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])
        grams = mixed((self.sums[gram:] - self.sums[:-gram]) * self.down[: len(data) - gram + 1])
        # The least gram of each window, and of equal ones the leftmost: its place rides in the low bits.
        low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, have = window - gram + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[: len(low) - have], low[have:])
            have *= 2
        if width > have:
            low = np.minimum(low[: have - width], low[width - have :])
        anchor = (low & _LOW).astype(np.int64)
        inside = np.ones(n, dtype=bool)
        for end in texts[1:-1].tolist():
            inside[max(0, end - window + 1) : end] = False
        at = np.flatnonzero(inside)
        if not len(at):
            return
        anchor = anchor[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        self.starts, self.sizes = at[heads], np.diff(np.append(heads, len(at)))
        self.owner = np.searchsorted(texts, self.starts, side="right") - 1
        self.bins = grams[anchor[heads]]

    def pieces(self, rows: np.ndarray) -> np.ndarray:
        """A hash of all bytes that the windows of a run cover."""
        a = self.starts[rows]
        z = a + self.sizes[rows] + self.window - 1
        return salted((self.sums[z] - self.sums[a]) * self.down[a], 3) + (z - a).astype(np.uint64)


def _usable(batch: pa.RecordBatch, first_copy) -> pa.RecordBatch:
    """Without rows that are surely copies of an earlier one: ``doc_id, key, code, text``."""
    return batch.filter(pa.array(first_copy(batch.column(2).to_numpy(zero_copy_only=False)), pa.bool_()))


def _anchors(window: int, gram: int, first_copy):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, texts in parts(_usable(batch, first_copy).column(3)):
                yield pa.RecordBatch.from_arrays([signed(Runs(data, texts, window, gram).bins)], names=["bin"])

    return emit


def _merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by owner and begin, those that touch or overlap as one."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * far)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] + owner[1:] * far > reach[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], begin[heads], reach[np.append(heads[1:], len(owner)) - 1] - owner[heads] * far


def _live_runs(window: int, gram: int, first_copy, live):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs whose anchor may occur again; rows without bin are spans that repeat in their own text."""
        for batch in batches:
            batch = _usable(batch, first_copy)
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, texts in parts(batch.column(3)):
                runs = Runs(data, texts, window, gram)
                rows = np.flatnonzero(live(runs.bins)) if len(runs.bins) else runs.starts
                if not len(rows):
                    continue
                bins, pieces, owner, starts, sizes = runs.bins[rows], runs.pieces(rows), runs.owner[rows], runs.starts[rows], runs.sizes[rows]
                order = np.lexsort((starts, pieces, bins, owner))
                again = np.zeros(len(rows), dtype=bool)
                a, b = order[1:], order[:-1]
                again[a] = (owner[a] == owner[b]) & (bins[a] == bins[b]) & (pieces[a] == pieces[b])
                once = ~again
                text = first + owner[once]
                yield pa.RecordBatch.from_arrays(
                    [signed(bins[once]), signed(pieces[once]), pa.array(ids[text]), pa.array(keys[text]), pa.array((starts[once] - texts[owner[once]]).astype(np.int32)), pa.array(sizes[once].astype(np.int32))],
                    names=["bin", "piece", "doc_id", "key", "begin", "size"],
                )
                if again.any():
                    spans, begin, end = _merged(owner[again], starts[again], starts[again] + sizes[again] + window - 1)
                    none, text = pa.nulls(len(spans), pa.int64()), first + spans
                    yield pa.RecordBatch.from_arrays(
                        [none, none, pa.array(ids[text]), pa.array(keys[text]), pa.array((begin - texts[spans]).astype(np.int32)), pa.array((end - begin).astype(np.int32))],
                        names=["bin", "piece", "doc_id", "key", "begin", "size"],
                    )

    return emit


def _place_code(ids: np.ndarray, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.view(np.uint64) * np.uint64(0xD1342543DE82EF95) + keys.view(np.uint64)) + begins.astype(np.uint64))


@F.arrow_udf(T.LongType())
def _code(ids: pa.Array, keys: pa.Array, begins: pa.Array) -> pa.Array:
    return signed(_place_code(*(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in (ids, keys, begins))))


def _run_bytes(window: int, gram: int, first_copy, wanted):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the runs that stand for their kind."""
        for batch in batches:
            batch = _usable(batch, first_copy)
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, texts in parts(batch.column(3)):
                runs = Runs(data, texts, window, gram)
                text, begins = first + runs.owner, runs.starts - texts[runs.owner]
                rows = np.flatnonzero(wanted(_place_code(ids[text], keys[text], begins))) if len(text) else text
                if not len(rows):
                    continue
                sizes = runs.sizes[rows] + window - 1
                heads = np.cumsum(sizes) - sizes
                raw = data[np.repeat(runs.starts[rows] - heads, sizes) + np.arange(sizes.sum())]
                binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(heads, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [signed(runs.bins[rows]), pa.array(ids[text[rows]]), pa.array(keys[text[rows]]), pa.array(begins[rows].astype(np.int32)), binary], names=["bin", "doc_id", "key", "begin", "bytes"]
                )

    return emit


def sort_windows(table: pa.Table, window: int, digit: int = DIGIT) -> pa.Table:
    """Spans of runs whose windows also start in an earlier run of their bin, by radix passes over whole bins."""
    table = table.combine_chunks()
    column = table.column("bytes")
    data, offsets = buffers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    ids, keys, begins = (table.column(n).to_numpy() for n in ("doc_id", "key", "begin"))
    counts = np.diff(offsets) - window + 1
    order = np.lexsort((begins, keys, ids))
    later = np.zeros(len(ids), dtype=np.int64)  # rows of one place, from rows that are equal, have one rank
    later[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1]) | (begins[order][1:] != begins[order][:-1])
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.cumsum(later)
    row = np.repeat(np.arange(len(ids)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[row]
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    group = np.unique(table.column("bin").to_numpy(), return_inverse=True)[1][row].astype(np.uint64)
    for begin in range(0, window, digit):
        if not len(at):
            break
        a = at + begin
        z = at + min(begin + digit, window)
        code = mixed(mixed((sums[z] - sums[a]) * down[a]) + group * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(code, kind="stable")
        code = code[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = code[1:] != code[:-1]
        alone = new & np.append(new[1:], True)
        order = order[~alone]
        group = np.cumsum(new, dtype=np.uint64)[~alone]
        at, row = at[order], row[order]
    # Groups lie together now. Bytes decide: each window against the first of its group.
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(heads, len(at)))
    equal = np.ones(len(at), dtype=bool)
    against = np.repeat(at[heads], sizes)
    for k in range(window):
        equal &= data[at + k] == data[against + k]
    first = np.repeat(np.minimum.reduceat(rank[row], heads), sizes) if len(at) else rank[:0]
    settled = rank[row] != first
    for odd in np.unique(group[~equal]):  # two contents under one code: sorted apart
        members = np.flatnonzero(group == odd)
        least: dict[bytes, int] = {}
        for i in members:
            content = data[at[i] : at[i] + window].tobytes()
            least[content] = min(least.get(content, len(rank)), int(rank[row[i]]))
        settled[members] = [int(rank[row[i]]) != least[data[at[i] : at[i] + window].tobytes()] for i in members]
    at, row = at[settled], row[settled]
    owner, begin, end = _merged(row, at, at + window)
    return pa.table({"doc_id": ids[owner], "key": keys[owner], "begin": (begins[owner] + begin - offsets[owner]).astype(np.int32), "size": (end - begin).astype(np.int32)})


def _sorted_bins(window: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bin; a bin is sorted when all its rows are there."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.nbytes >= SORT_BYTES:
                bins = held.column("bin").to_numpy()
                whole = int(np.searchsorted(bins, bins[-1]))
                if whole:
                    yield from sort_windows(held.slice(0, whole), window).to_batches()
                    held = held.slice(whole)
        if held is not None:
            yield from sort_windows(held, window).to_batches()

    return sort


def _grouped(rows: DataFrame, window: int) -> DataFrame:
    """The same for bins of any size: window by window, combined before the shuffle."""
    place = F.struct("doc_id", "key", "at")
    cut = F.posexplode(F.expr(f"transform(sequence(1, octet_length(bytes) - {window - 1}), i -> substring(bytes, i, {window}))"))
    cuts = rows.select("doc_id", "key", "begin", cut.alias("k", "cut")).select("doc_id", "key", (F.col("begin") + F.col("k")).alias("at"), F.xxhash64("cut").alias("h1"), F.xxhash64(F.lit(1), "cut").alias("h2"))
    firsts = cuts.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cuts.join(firsts, ["h1", "h2"]).where(place > F.col("first"))
    return met.select("doc_id", "key", F.col("at").alias("begin"), F.lit(window).alias("size"))


def repeated_spans(rows: DataFrame, firsts: DataFrame, window: int = WINDOW, gram: int = GRAM, bin_runs: int = BIN_RUNS) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of first documents whose windows also start earlier: ``doc_id, key, begin, size`` in bytes.

    ``rows`` has ``doc_id, key, text``, ``firsts`` the ``doc_id, key`` of the first document
    of each text. Spans may overlap. Also gives the stored tables that they are read from.
    """
    code = F.xxhash64("key", "doc_id").alias("code")
    first_copy = KeyFilter(firsts.select(code), "code").tester()
    texts = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window)).select("doc_id", "key", code, "text")
    anchors = texts.mapInArrow(_anchors(window, gram, first_copy), "bin long")
    live = materialize(anchors.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bin"), "suffix-bins")
    found = materialize(texts.mapInArrow(_live_runs(window, gram, first_copy, KeyFilter(live, "bin").tester()), _RUN), "suffix-runs")
    release(live)
    inner, runs = found.where("bin is null").select("doc_id", "key", "begin", "size"), found.where("bin is not null")
    place = F.struct("doc_id", "key", "begin")
    kinds = materialize(runs.groupBy("bin", "piece").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "suffix-kinds")
    repeated = kinds.where("n > 1")
    again = runs.where(KeyFilter(repeated, "piece").may_hold("piece")).join(repeated, ["bin", "piece"]).where(place != F.col("first"))
    again = again.select("doc_id", "key", "begin", (F.col("size") + (window - 1)).alias("size"))
    branching = materialize(kinds.groupBy("bin").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-branching")
    standing = kinds.join(branching.select("bin"), "bin").select(_code("first.doc_id", "first.key", "first.begin").alias("code"))
    standing = materialize(standing, "suffix-standing")
    cut = materialize(texts.mapInArrow(_run_bytes(window, gram, first_copy, KeyFilter(standing, "code").tester()), _BYTES), "suffix-bytes")
    release(standing)
    # A bin goes one way with all its runs, whichever the bitmap names.
    hot = KeyFilter(branching.where(F.col("kinds") > bin_runs), "bin").may_hold("bin")
    owned = cut.where(~hot).repartition("bin").sortWithinPartitions("bin").mapInArrow(_sorted_bins(window), _SPAN)
    spans = inner.unionByName(again).unionByName(owned).unionByName(_grouped(cut.where(hot), window))
    return spans, [found, kinds, branching, cut]


def _remover(window: int, keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, spans = batch.column(2), batch.column(3)
            done: list[tuple] = []
            for first, data, texts in parts(batch.column(1)):
                raw = memoryview(np.ascontiguousarray(data))
                for t, (a, z) in enumerate(zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)):
                    if copies[first + t].as_py():
                        pieces = [(0, z - a)] if z - a >= window else []
                    else:
                        mine = spans[first + t].values
                        pieces = []
                        if mine is not None and len(mine):
                            begin, size = (mine.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                            _, begin, end = _merged(np.zeros(len(begin), dtype=np.int64), begin, begin + size)
                            pieces = list(zip(begin.tolist(), end.tolist(), strict=True))
                    digest, kept, at = hashlib.sha256(), [], a
                    for begin, end in [*pieces, (z - a, z - a)]:
                        digest.update(raw[at : a + begin])
                        kept.append(raw[at : a + begin])
                        at = a + end
                    done.append((z - a, sum(e - b for b, e in pieces), len(pieces), digest.hexdigest(), b"".join(kept) if keep_text else None))
            columns = list(zip(*done, strict=True)) if done else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return remove


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, bin_runs: int = BIN_RUNS) -> DataFrame:
    """Each row of ``docs`` without the bytes that occur earlier.

    A byte goes if a string of ``window`` bytes over it also starts earlier: in a document
    with a smaller id, or further ahead in the same one. Gives ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and ``kept`` (bytes, as a cut may fall inside a character; null unless asked
    for), a row for each row of ``docs``.

    A null text is empty. A row without id is kept whole and is no source. Rows equal in id
    and text are one document, and each has its result; rows of one id and different texts
    come in the order of a hash of the text. Texts shorter than a window stay. Other columns
    are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"))
    copies = rows.where("doc_id is not null").groupBy("key", "sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    firsts = materialize(copies, "suffix-firsts")
    spans, stored = repeated_spans(rows, firsts.select("key", F.col("first_id").alias("doc_id")), window, gram, bin_runs)
    spans = spans.groupBy("key", F.col("doc_id").alias("first_id")).agg(F.collect_list(F.struct("begin", "size")).alias("spans"))
    plan = firsts.join(spans, ["key", "first_id"], "left").where("last_id > first_id or spans is not null")
    plan = materialize(plan.select(F.col("key").alias("k"), F.col("sha").alias("s"), "first_id", "spans"), "suffix-plan")
    release(firsts, *stored)
    marked = rows.withColumn("touched", KeyFilter(plan, "k").may_hold("key"))
    joined = marked.where("touched").join(plan, (F.col("key") == F.col("k")) & (F.col("sha") == F.col("s")), "left")
    changed = joined.select("doc_id", "text", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy"), F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans"))
    plain = marked.where("not touched").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(changed.schema["spans"].dataType).alias("spans"))
    kept = _remover(window, keep_text)
    return changed.mapInArrow(kept, _KEPT).unionByName(plain.mapInArrow(kept, _KEPT))
