"""Quality scores: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are its words, word pairs and word shapes (length, first and last byte
class, repeat of the word before) with their pairs and triples, hashed into a fixed number
of slots; a text's vector has length one. Training runs on a bounded sample of labelled
rows, in shards whose leaders are averaged between rounds. Scoring is a sparse dot product
over whole texts and runs where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedframe.llm.words import LOWER, VISIBLE, Chunk, chunks, mixed, salted, sequences
from feedframe.session import materialize

#: log2 of the number of weights.
BITS = 18
#: Labelled rows to learn from, at most: those with the smallest hashes of their ids.
MAX_TRAIN = 24_000
#: Rows of a shard, about; shards, at most.
SHARD_ROWS, SHARDS = 4_000, 6
#: Rounds, at least and at most, and the rows that small samples are shown in all.
ROUNDS, MORE_ROUNDS, SHOWN = 3, 10, 40_000
#: The learner's rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1


def _kinds(byte: np.ndarray) -> np.ndarray:
    """Class of a byte: 0 other, 1 digit, 2 upper case, 3 lower case, 4 beyond ASCII."""
    table = np.zeros(256, dtype=np.uint64)
    table[0x30:0x3A], table[0x41:0x5B], table[0x61:0x7B], table[0x80:] = 1, 2, 3, 4
    return table[byte]


def _hash_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded hashes of the words and of their shapes."""
    starts, ends = chunk.starts, chunk.ends
    shape = np.minimum(15, np.ceil(np.log2((ends - starts).astype(np.float64) + 1) * 3)).astype(np.uint64)
    shape = shape * np.uint64(8) + _kinds(chunk.data[starts])
    shape = shape * np.uint64(8) + _kinds(chunk.data[ends - 1])
    folded = Chunk(chunk.first, LOWER[chunk.data], chunk.texts, starts, ends, chunk.bounds).hashes()
    same = np.zeros(len(folded), dtype=np.uint64)
    same[1:] = folded[1:] == folded[:-1]
    return folded, mixed(shape * np.uint64(2) + same)


def features(chunk: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the texts of a chunk: text, slot and value, each slot once for a text, sorted by text."""
    words, shapes = _hash_words(chunk)
    owners = chunk.owners()
    parts, texts = [], []
    for salt, (hashes, n) in enumerate([(words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3)]):
        at = chunk.windows(n)
        parts.append(salted(sequences(hashes, n)[at], salt) >> np.uint64(64 - bits))
        texts.append(owners[at])
    # How many of its words a text repeats, in tenths, and how long it is, as two more slots.
    counts = chunk.counts
    pairs = np.unique((owners.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    distinct = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=chunk.n_texts)
    full = np.flatnonzero(counts)
    tenth = (10 * distinct[full] // counts[full]).astype(np.uint64)
    length = np.log2(counts[full] + 1).astype(np.uint64)
    parts += [salted(tenth, 90) >> np.uint64(64 - bits), salted(tenth * np.uint64(64) + length, 91) >> np.uint64(64 - bits)]
    texts += [full, full]
    code = (np.concatenate(texts).astype(np.uint64) << np.uint64(bits)) | np.concatenate(parts)
    code, times = np.unique(code, return_counts=True)
    text = (code >> np.uint64(bits)).astype(np.int64)
    slot = (code & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(text, value * value, minlength=chunk.n_texts))
    return text, slot, value / norm[text]


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that follow from the learner's two sums."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def learn(texts: pa.Array, labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass over labelled texts; updates the two sums. The last slot is the intercept."""
    for chunk in chunks(texts, VISIBLE):
        text, slot, value = features(chunk, int(np.log2(len(z) - 1)))
        cuts = np.searchsorted(text, np.arange(chunk.n_texts + 1))
        for t in range(chunk.n_texts):
            at = np.append(slot[cuts[t] : cuts[t + 1]], len(z) - 1)
            x = np.append(value[cuts[t] : cuts[t + 1]], 1.0)
            w = leader(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[chunk.first + t]) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown


def score_texts(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of whole texts: a sparse dot product each, through the logistic function."""
    bits = int(np.log2(len(weights) - 1))
    out = []
    for chunk in chunks(texts, VISIBLE):
        text, slot, value = features(chunk, bits)
        sums = np.bincount(text, weights[slot] * value, minlength=chunk.n_texts) + weights[-1]
        out.append(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, max_train: int) -> tuple[DataFrame, int]:
    """Texts with their label and shard, and their number: at most ``max_train`` labelled rows, by the hash of their id.

    The rows picked are a small table of known size, so it is broadcast to the texts. Rows
    without an id, or whose label is neither 0 nor 1, are passed over; of several labels
    of one id the greatest counts.
    """
    picked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    picked = picked.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    picked = picked.groupBy("_id").agg(F.max("_label").alias("_label"))
    picked = picked.withColumn("_order", F.xxhash64(F.lit(3), "_id")).orderBy("_order", "_id", "_label").limit(max_train)
    picked = materialize(picked, f"{label}-labels")
    n = picked.count()
    shards = max(1, min(SHARDS, n // SHARD_ROWS))
    picked = picked.select("_id", "_label", F.pmod("_order", F.lit(shards)).cast("int").alias("shard"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    return materialize(rows.select("shard", F.col("_doc").alias("doc_id"), "text", F.col("_label").alias("label")), f"{label}-sample"), n


def n_rounds(n: int) -> int:
    """Rounds over ``n`` rows: small samples are shown more often."""
    return max(ROUNDS, min(MORE_ROUNDS, SHOWN // max(1, n)))


def train(sample: DataFrame, rounds: int = ROUNDS, bits: int = BITS) -> np.ndarray:
    """Weights from ``shard, doc_id, text, label`` rows.

    Each round learns every shard from the mean of the shards' sums. Only these sums, of
    a size fixed by ``bits``, reach the driver. Without rows all weights are zero.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        start = sample.sparkSession.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def learn_shard(table: pa.Table) -> pa.Table:
            z, n = (a.astype(np.float64) for a in start.value)
            table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
            order = np.random.default_rng(7).permutation(table.num_rows)
            table = table.take(pa.array(order)).combine_chunks()
            labels = table.column("label").to_numpy()
            base = 0
            for piece in table.column("text").chunks:
                learn(piece, labels[base : base + len(piece)], z, n)
                base += len(piece)
            return pa.table({"z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

        sums = sample.groupBy("shard").applyInArrow(learn_shard, "z binary, n binary").collect()
        if not sums:
            break
        z = np.mean([np.frombuffer(r.z, dtype=np.float32) for r in sums], axis=0, dtype=np.float64)
        n = np.mean([np.frombuffer(r.n, dtype=np.float32) for r in sums], axis=0, dtype=np.float64)
        start.unpersist()
    return leader(z, n).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; an empty or null text gets the intercept's.

    All columns pass; one named as the new column is replaced. The text is ``text``.
    """
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_row", column])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kinds = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField(column, T.DoubleType())])
    return rows.mapInArrow(score_batches, kinds).select("_row.*", F.col(f"`{column}`"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, max_train: int = MAX_TRAIN, column: str = "score") -> DataFrame:
    """``docs`` with a quality score in ``column``, learned from ``labels`` (``doc_id, quality``).

    ``held_out`` maps an id column to whether its labels must not be learned. Labels, ids
    and other columns are no inputs of a score. Without labels every score is 0.5; an empty
    table gives no rows; repeated rows are scored alike.
    """
    sample, n = labelled_sample(docs, labels, "quality", held_out, max_train)
    return score(docs, train(sample, n_rounds(n)), column)
