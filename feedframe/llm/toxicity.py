"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its
hashed words and their stems; a document is toxic if at least one sentence is, so its
probability is their noisy-or, ``1 - prod(1 - p)``. Only documents have labels: the loss is
that of the noisy-or, and its gradient reaches each sentence by the share it has in it. The
trained sentence model also says which sentences are at fault.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedframe.llm.quality import ROUNDS, labelled_sample, n_rounds
from feedframe.llm.words import ALNUM, Chunk, chunks, salted

BITS = 18
#: Bytes of the stems that count beside whole words, as a language may join an insult to other syllables.
STEMS = (4, 5, 6)
#: Labelled rows to learn from, at most: those with the smallest hashes of their ids.
MAX_TRAIN = 24_000
#: The learner's rate, the offset that keeps small gradients small, the penalty on a weight,
#: and the fixed log-odds of a sentence in which nothing is known.
RATE, OFFSET, PENALTY, START = 2.0, 1.0, 0.003, -8.0

_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True


def sentences(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each word, numbered over the chunk, and the text of each sentence.

    A sentence ends at a full stop, exclamation or question mark or at a line end. Every
    text has at least one sentence; one without words has no features.
    """
    stops = np.concatenate([[0], np.cumsum(_STOPS[chunk.data])])
    owners = chunk.owners()
    code = owners * (len(chunk.data) + 1) + stops[chunk.starts]
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    return np.cumsum(new) - 1, owners[new]


def features(chunk: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sentence, slot)`` of each feature, and the text of each sentence (texts without words come last)."""
    of_word, of_sentence = sentences(chunk)
    slots, owners = [salted(chunk.hashes(), 1)], [of_word]
    for n in STEMS:
        longer = np.flatnonzero(chunk.ends - chunk.starts > n)
        starts = chunk.starts[longer]
        stems = Chunk(chunk.first, chunk.data, chunk.texts, starts, starts + n, chunk.bounds).hashes()
        slots.append(salted(stems, 2 + n))
        owners.append(of_word[longer])
    empty = np.flatnonzero(chunk.counts == 0)
    code = (np.concatenate(owners).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(slots) >> np.uint64(64 - bits))
    code = np.unique(code)
    return (code >> np.uint64(bits)).astype(np.int64), (code & np.uint64((1 << bits) - 1)).astype(np.int64), np.concatenate([of_sentence, empty])


def sentence_scores(sentence: np.ndarray, slot: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Probability of each of ``n`` sentences; the last weight is the intercept."""
    z = np.bincount(sentence, weights[slot], minlength=n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_texts))


def learn(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> None:
    """One pass over labelled bags; each step is scaled by the squares of the slot's gradients so far."""
    bits = int(np.log2(len(weights) - 1))
    for chunk in chunks(texts, ALNUM, lower=True):
        sentence, slot, text = features(chunk, bits)
        order = np.argsort(text, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        sentence = rank[sentence]  # sentences of one text now stand together
        by = np.argsort(sentence, kind="stable")
        sentence, slot, text = sentence[by], slot[by], text[order]
        s_cuts = np.searchsorted(text, np.arange(chunk.n_texts + 1))
        f_cuts = np.searchsorted(sentence, s_cuts)
        for t in range(chunk.n_texts):
            a, b = f_cuts[t], f_cuts[t + 1]
            local, n = sentence[a:b] - s_cuts[t], s_cuts[t + 1] - s_cuts[t]
            p = sentence_scores(local, slot[a:b], n, weights)
            whole = max(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()), 1e-9)
            g = -p * (1 - whole) / whole if labels[chunk.first + t] else p
            at, where = np.unique(slot[a:b], return_inverse=True)
            step = np.bincount(where, g[local], minlength=len(at))
            squares[at] += step * step
            rate = RATE / (OFFSET + np.sqrt(squares[at]))
            moved = weights[at] - rate * step
            weights[at] = np.sign(moved) * np.maximum(np.abs(moved) - rate * PENALTY, 0)


def train(sample: DataFrame, rounds: int = ROUNDS, bits: int = BITS) -> np.ndarray:
    """Sentence weights from ``shard, doc_id, text, label`` rows: shards learn, their weights are averaged, again and again."""
    size = (1 << bits) + 1
    weights, squares = np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)
    weights[-1] = START
    for _ in range(rounds):
        start = sample.sparkSession.sparkContext.broadcast((weights, squares))

        def learn_shard(table: pa.Table) -> pa.Table:
            w, q = (a.astype(np.float64) for a in start.value)
            table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
            table = table.take(pa.array(np.random.default_rng(7).permutation(table.num_rows))).combine_chunks()
            labels, base = table.column("label").to_numpy(), 0
            for piece in table.column("text").chunks:
                learn(piece, labels[base : base + len(piece)], w, q)
                base += len(piece)
            return pa.table({"w": [w.astype(np.float32).tobytes()], "q": [q.astype(np.float32).tobytes()]})

        found = sample.groupBy("shard").applyInArrow(learn_shard, "w binary, q binary").collect()
        if not found:
            break
        parts = [np.frombuffer(r.w, dtype=np.float32) for r in found]
        seen = [np.frombuffer(r.q, dtype=np.float32) - squares for r in found]
        total = np.sum(seen, axis=0)
        # A weight is the mean over the shards that saw its slot, by how much they saw of it.
        weights = np.where(total > 0, np.sum([p * s for p, s in zip(parts, seen, strict=True)], axis=0) / np.maximum(total, 1e-12), weights).astype(np.float32)
        squares = (squares + total / len(found)).astype(np.float32)
        start.unpersist()
    return weights


def score_texts(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(weights) - 1))
    out = []
    for chunk in chunks(texts, ALNUM, lower=True):
        sentence, slot, text = features(chunk, bits)
        out.append(noisy_or(sentence_scores(sentence, slot, len(text), weights), text, chunk.n_texts))
    return np.concatenate(out) if out else np.zeros(0)


def offending(text: str, weights: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """Byte ranges and probabilities of the sentences of one text that score ``least`` or more."""
    bits = int(np.log2(len(weights) - 1))
    found = []
    for chunk in chunks(pa.array([text]), ALNUM, lower=True):
        of_word, _ = sentences(chunk)
        sentence, slot, owners = features(chunk, bits)
        p = sentence_scores(sentence, slot, len(owners), weights)
        for s in np.flatnonzero(p[: (of_word[-1] + 1) if len(of_word) else 0] >= least):
            words = np.flatnonzero(of_word == s)
            found.append((int(chunk.starts[words[0]]), int(chunk.ends[words[-1]]), float(p[s])))
    return found


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out, max_train: int = MAX_TRAIN, least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``offending``: sentences as ``start, end`` (bytes) and ``score``.

    The model is learned from ``labels`` (``doc_id, toxic``), but for ids that ``held_out``
    maps to true. Labels, ids and other columns are no inputs of a score. Null and empty
    texts are one sentence without words. Without labels every sentence has the starting
    intercept. Repeated rows score alike; an empty table gives no rows; all columns pass,
    and those named as the new ones are replaced.
    """
    sample, n = labelled_sample(docs, labels, "toxic", held_out, max_train)
    shared = docs.sparkSession.sparkContext.broadcast(train(sample, n_rounds(n)))
    kept = [c for c in docs.columns if c.lower() not in ("score", "offending")]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            scores = score_texts(texts, shared.value)
            spans: list = [[] for _ in scores]
            for i in np.flatnonzero(scores >= least):
                spans[i] = [{"start": a, "end": b, "score": p} for a, b, p in offending(texts[int(i)].as_py(), shared.value, least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["_row", "score", "offending"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    kinds = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    return rows.mapInArrow(score_batches, kinds).select("_row.*", "score", "offending")
