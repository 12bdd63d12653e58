"""Exact dedup over an extendible-hash index on shared files.

Texts are keyed by the leading bits of their SHA-256. Loading appends an entry for each
distinct text of a task's batch to a log in the shared folder: copies are collapsed, byte
for byte, before anything is shuffled. The directory doubles until no bucket that it can
still split is overfull, at most ``MAX_DEPTH`` times. Owner tasks then take ranges of
buckets, walk the entries of each key as a chain and compare bytes, and write one row for
each distinct text; entries find their group by its number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedframe.llm.words import buffers
from feedframe.session import materialize

#: Doublings of the directory, at most: it has no more than 2**16 entries at any size of the corpus.
MAX_DEPTH = 16
#: Entries of a bucket, about, beyond which it is split.
BUCKET_ENTRIES = 20_000

_ENTRY = "entry long, prefix int, key long, digest binary, text binary, ids array<long>, keep_id long, at int, n long"
_GROUP = "entry long, sha string, keep_id long, group_size long, keep_entry long, head boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct texts of each batch, with the ids of their rows."""
    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, off = buffers(batch.column(1))
        raw, off = memoryview(np.ascontiguousarray(data)), off.tolist()
        found: dict[bytes, int] = {}
        members: list[list] = []
        texts: list[memoryview] = []
        digests: list[bytes] = []
        for i, doc in enumerate(ids):
            text = raw[off[i] : off[i + 1]]
            digest = hashlib.sha256(text).digest()
            at = found.get(digest)
            if at is not None and texts[at] == text:
                members[at].append(doc)
                continue
            found.setdefault(digest, len(texts))
            members.append([doc])
            texts.append(text)
            digests.append(digest)
        if not ids:
            continue
        best = [max(range(len(m)), key=lambda i: (m[i] is not None, m[i] or 0, -i)) for m in members]
        keys = np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], dtype=np.int64)
        entry = number + np.arange(len(texts))
        number += len(texts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(entry, pa.int64()),
                pa.array((keys.view(np.uint64) >> np.uint64(64 - MAX_DEPTH)).astype(np.int32)),
                pa.array(keys),
                pa.array(digests, pa.binary()),
                pa.array([t.tobytes() for t in texts], pa.binary()),
                pa.array(members, pa.list_(pa.int64())),
                pa.array([m[b] for m, b in zip(members, best, strict=True)], pa.int64()),
                pa.array(best, pa.int32()),
                pa.array([len(m) for m in members], pa.int64()),
            ],
            names=[part.split()[0] for part in _ENTRY.split(", ")],
        )


def directory(counts: dict[int, int], capacity: int = BUCKET_ENTRIES, depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets as ``(first prefix, last prefix, local depth)``, from entries per ``depth``-bit prefix.

    The directory begins with one bucket. While some bucket holds more than ``capacity``
    and is not at full depth, the directory doubles if that bucket is as deep as the
    directory, and the bucket splits by its next bit. Bounded by ``2 ** depth``, whatever
    the corpus holds; a bucket that is overfull at full depth keeps a longer chain.
    """
    size = 1 << depth
    sums = np.zeros(size + 1, dtype=np.int64)
    for prefix, n in counts.items():
        sums[prefix + 1] = n
    sums = np.cumsum(sums)
    done, open_ = [], [(0, 0)]  # (bucket number, local depth)
    while open_:
        number, local = open_.pop()
        width = size >> local
        first = number * width
        if local < depth and sums[first + width] - sums[first] > capacity:
            open_ += [(2 * number, local + 1), (2 * number + 1, local + 1)]
        else:
            done.append((first, first + width - 1, local))
    return sorted(done)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal texts, from entries sorted by bucket, key and digest.

    Holds the distinct texts of one 64-bit key, never the entries of a group: each entry
    comes out at once with the number of the group's first one, and a group's totals when
    its key ends.
    """
    key, chain = None, []  # [text, digest, first entry, keep_id, size, keep_entry]

    def closed() -> list[tuple]:
        return [(g[2], g[1].hex(), g[3], g[4], g[5], True) for g in chain]

    for batch in batches:
        out: list[tuple] = []
        entries, keys, keeps, ns = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
        digests, texts = batch.column(2), batch.column(3)
        for i, k in enumerate(keys):
            if k != key:
                out += closed()
                key, chain = k, []
            digest, text = digests[i].as_py(), texts[i].as_buffer()
            group = next((g for g in chain if g[1] == digest and g[0].equals(text)), None)
            keep = keeps[i]
            if group is None:
                group = [pa.py_buffer(text.to_pybytes()), digest, entries[i], keep, 0, entries[i]]
                chain.append(group)
            elif keep is not None and (group[3] is None or keep > group[3]):
                group[3], group[5] = keep, entries[i]
            elif keep == group[3] and entries[i] < group[5]:
                group[5] = entries[i]
            group[4] += ns[i]
            out.append((entries[i], None, None, None, group[2], False))
        yield _rows(out)
    yield _rows(closed())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = [part.split()[0] for part in _GROUP.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty. Of a group the row
    with the largest id stays; a null id is below every other, and of rows with the same
    id and text exactly one stays. Columns other than the two are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    log = materialize(rows.mapInArrow(_entries, _ENTRY), "dedup-log")
    counts = {r[0]: r[1] for r in log.groupBy("prefix").count().collect()}  # at most 2**16 numbers
    buckets = directory(counts, capacity)
    last = [b[1] for b in buckets]
    marked = log.withColumn("bucket", _bucket_of("prefix", last))
    chained = (
        marked.select("bucket", "entry", "key", "digest", "text", "keep_id", "n")
        .repartition(len(buckets), "bucket")
        .sortWithinPartitions("bucket", "key", "digest")
        .select("entry", "key", "digest", "text", "keep_id", "n")
        .mapInArrow(_chains, _GROUP)
    )
    index = materialize(chained, "dedup-index")
    heads = index.where("head").select(F.col("entry").alias("group"), "sha", "keep_id", "group_size", F.col("keep_entry"))
    links = index.where("not head").select("entry", F.col("keep_entry").alias("group"))
    members = log.select("entry", "ids", "at").join(links, "entry").join(heads, "group")
    each = members.select("*", F.posexplode("ids").alias("place", "doc_id"))
    kept = (F.col("entry") == F.col("keep_entry")) & (F.col("place") == F.col("at"))
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def _bucket_of(prefix: str, last: list[int]):
    """The bucket of a prefix: a search in the sorted last prefixes of the directory."""
    ends = np.array(last, dtype=np.int64)

    @F.arrow_udf("int")
    def lookup(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends, values.to_numpy(zero_copy_only=False)).astype(np.int32))

    return lookup(F.col(prefix))
