"""Ranked lexical search by a document FP-tree and branch and bound.

A document is cut down to the terms that some item asks for: its restricted term vector.
Tasks sort the vectors of a block of documents, each from its most to its least frequent
term, so that documents with the same beginnings lie side by side: ranges of them are the
nodes of a trie whose paths they share. A node knows, of all documents below it, the
greatest count of each term and the least ``m``. A score grows with the counts and falls
with ``m``, so those two bound every score below the node, and an item's search goes down
depth first, best bound first, and leaves out nodes that cannot reach its best documents
so far. These are carried from block to block of a task; a salted top list of the tasks'
lists and a final one give the ranks.

Items come in blocks of bounded size (``BLOCK_TERMS`` item terms); each block is met by
all documents. Words are found by a 64-bit hash and compared byte by byte.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedframe.llm.words import ALNUM, Chunk, chunks
from feedframe.session import materialize

#: Documents that an item gets.
TOP = 20
#: Item terms of a block of items; what a task is sent is bounded by it.
BLOCK_TERMS = 1 << 15
#: Documents and postings of a tree, and documents of a leaf, at most.
TREE_DOCS, TREE_POSTINGS, LEAF_DOCS = 1 << 13, 1 << 21, 64
#: A cut of a node's range leaves no more than this part of it in one child, where it can.
LARGEST_CHILD = 0.75
#: Parts that an item's candidates are ranked in before the last ranking.
SALTS = 64

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"


class Asked(NamedTuple):
    """A term of an item, and how often the item holds it."""

    item: int
    term: str
    times: int


class Vocabulary:
    """The terms of a block of items, numbered, for finding them among the words of texts."""

    def __init__(self, terms: list[str]):
        chunk = next(chunks(pa.array([" ".join(terms)], pa.large_string()), ALNUM), None)
        self.data, self.starts, self.sizes = chunk.data, chunk.starts, chunk.ends - chunk.starts
        hashes = chunk.hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("Two terms of the items share a 64-bit hash")

    def find(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Words of a chunk that are terms, and the term of each."""
        hashes = chunk.hashes()
        if not len(hashes) or not len(self.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        words = np.flatnonzero(self.hashes[at] == hashes)
        terms = self.order[at[words]]
        sizes = chunk.ends[words] - chunk.starts[words]
        same = sizes == self.sizes[terms]
        words, terms, sizes = words[same], terms[same], sizes[same]
        if not len(words):
            return words, terms
        heads = np.cumsum(sizes) - sizes
        within = np.arange(sizes.sum()) - np.repeat(heads, sizes)
        equal = chunk.data[np.repeat(chunk.starts[words], sizes) + within] == self.data[np.repeat(self.starts[terms], sizes) + within]
        same = np.logical_and.reduceat(equal, heads)
        return words[same], terms[same]


def _restricted(terms: list[str]):
    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of words of each text, and its counts of the block's terms."""
        vocabulary = Vocabulary(terms)
        for batch in batches:
            for chunk in chunks(batch.column(1), ALNUM, lower=True):
                words, found = vocabulary.find(chunk)
                owner = np.searchsorted(chunk.bounds, words, side="right") - 1
                code, times = np.unique(owner * len(terms) + found, return_counts=True)
                cuts = np.searchsorted(code, np.arange(chunk.n_texts + 1) * len(terms)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.n_texts),
                        pa.array(chunk.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array((code % max(1, len(terms))).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return restrict


def term_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class FpTree:
    """Restricted vectors of a block of documents as ranges of a trie.

    ``ranks`` number terms from the most frequent one on; each document's are ascending.
    """

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        starts = np.cumsum(sizes) - sizes
        raw = ranks.astype(">u4").tobytes()
        paths = [raw[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        order = np.array(sorted(range(len(paths)), key=lambda d: (paths[d], m[d], ids[d])), dtype=np.int64)
        self.ids, self.known, self.m, sizes = ids[order], known[order], m[order], sizes[order]
        self.starts = np.append(0, np.cumsum(sizes))
        posting = np.repeat(starts[order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        ranks, self.tfs = ranks[posting], tfs[posting].astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.ranks, column = np.unique(ranks, return_inverse=True)
        self.width = len(self.ranks)
        self.keys = owner * self.width + column
        self._cut(self._shared(ranks, owner, sizes))
        self._maxima(owner, column)

    def _shared(self, ranks: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length of the path that each document shares with the one before it."""
        depth = np.arange(len(ranks)) - self.starts[owner]
        before = np.where(owner > 0, self.starts[owner - 1], 0) + depth
        same = (owner > 0) & (depth < np.append(0, sizes[:-1])[owner])
        same[same] = ranks[before[same]] == ranks[same]
        return np.minimum.reduceat(np.where(same, sizes[owner], depth), self.starts[:-1])

    def _cut(self, shared: np.ndarray) -> None:
        """Nodes as ranges of documents: ``low``, ``high`` and the numbers of their children."""
        self.low, self.high, self.children = [0], [len(self.ids)], [()]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF_DOCS:
                continue
            inner = shared[low + 1 : high]
            depths = np.unique(inner)
            first, last = 0, len(depths) - 1
            while first < last:  # the least depth whose branches are small enough
                middle = (first + last) // 2
                cuts = np.concatenate([[low], low + 1 + np.flatnonzero(inner <= depths[middle]), [high]])
                if np.diff(cuts).max() <= LARGEST_CHILD * (high - low):
                    last = middle
                else:
                    first = middle + 1
            cuts = [low, *(low + 1 + np.flatnonzero(inner <= depths[first])).tolist(), high]
            begin, born = low, []
            for a, b in zip(cuts[1:], [*cuts[2:], high + LEAF_DOCS + 1], strict=True):
                if b - begin > LEAF_DOCS:  # small neighbours share a child
                    born.append(len(self.low))
                    self.low.append(begin)
                    self.high.append(a)
                    self.children.append(())
                    begin = a
            self.children[node] = tuple(born)
            todo += born

    def _maxima(self, owner: np.ndarray, column: np.ndarray) -> None:
        n = len(self.low)
        self.most = np.zeros((n, self.width), dtype=np.int32)
        self.least_m, self.least_id = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        leaf_of = np.zeros(len(self.ids), dtype=np.int64)
        for node in range(n):
            if not self.children[node]:
                leaf_of[self.low[node] : self.high[node]] = node
                self.least_m[node] = self.m[self.low[node] : self.high[node]].min()
                self.least_id[node] = self.ids[self.low[node] : self.high[node]].min()
        np.maximum.at(self.most.reshape(-1), leaf_of[owner] * self.width + column, self.tfs.astype(np.int32))
        for node in range(n - 1, -1, -1):  # children come after their parent
            if self.children[node]:
                below = list(self.children[node])
                self.most[node] = self.most[below].max(axis=0)
                self.least_m[node], self.least_id[node] = self.least_m[below].min(), self.least_id[below].min()

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Put the documents that score best for an item among ``best``."""
        at = np.minimum(np.searchsorted(self.ranks, ranks), max(0, self.width - 1))
        here = self.ranks[at] == ranks
        columns, weights = at[here], weights[here]
        if not len(columns):
            return
        bounds = term_scores(self.most[:, columns].astype(np.int64), self.least_m[:, None]) @ weights
        stack = [0]
        while stack:
            node = stack.pop()
            if not best.may_take(bounds[node], self.least_id[node]):
                continue
            below = self.children[node]
            if below:
                stack += sorted(below, key=bounds.__getitem__)  # the best bound comes out first
                continue
            docs = np.arange(self.low[node], self.high[node])
            wanted = docs[:, None] * self.width + columns
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            tf = np.where(self.keys[place] == wanted, self.tfs[place], 0)
            best.take(term_scores(tf, self.m[docs][:, None]) @ weights, self.ids[docs], self.known[docs])


class Best:
    """An item's best documents so far: higher scores first, then smaller ids, then rows without id."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids, self.known = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def may_take(self, bound: int, least_id: int) -> bool:
        if len(self.scores) < self.top:
            return bound > 0
        return bound > self.scores[-1] or (bound == self.scores[-1] and least_id <= self.ids[-1])

    def take(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        some = scores > 0
        scores, ids, known = np.append(self.scores, scores[some]), np.append(self.ids, ids[some]), np.append(self.known, known[some])
        order = np.lexsort((ids, ~known, -scores))[: self.top]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Vectors of at most ``TREE_DOCS`` documents and about ``TREE_POSTINGS`` postings."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            more = pa.compute.sum(pa.compute.list_value_length(part.column(2))).as_py() or 0
            if held and (docs + part.num_rows > TREE_DOCS or postings + more > TREE_POSTINGS):
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
            held.append(part)
            docs, postings = docs + part.num_rows, postings + more
    if held:
        yield pa.Table.from_batches(held)


def tree_of(table: pa.Table, rank_of: np.ndarray, n_docs: int, n_words: int) -> FpTree:
    """The tree of a table of vectors."""
    ids, known = table.column("doc_id"), table.column("doc_id").is_valid().to_numpy()
    sizes = pa.compute.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
    ranks = rank_of[pa.compute.list_flatten(table.column("terms")).to_numpy()]
    tfs = pa.compute.list_flatten(table.column("tfs")).to_numpy()
    order = np.lexsort((ranks, np.repeat(np.arange(len(sizes)), sizes)))
    m = 100 - 25 + (25 * table.column("n").to_numpy() * n_docs) // n_words
    return FpTree(ids.fill_null((1 << 63) - 1).to_numpy(), known, m, sizes, ranks[order], tfs[order])


def _searcher(items: list[tuple[np.ndarray, np.ndarray]], rank_of: np.ndarray, n_docs: int, n_words: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for table in _blocks(batches):
            tree = tree_of(table, rank_of, n_docs, n_words)
            for (ranks, weights), mine in zip(items, best, strict=True):
                tree.search(ranks, weights, mine)
        for item, mine in enumerate(best):
            if len(mine.scores):
                ids = pa.array(mine.ids, mask=~mine.known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine.ids), item, dtype=np.int32)), ids, pa.array(mine.scores)], names=["item", "doc_id", "score"])

    return search


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each item: of each of its parts first, so that no task ranks all of a hot item's candidates."""
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = parts.withColumn("nth", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("nth") <= top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= top)


def _block(docs: DataFrame, rows: list[Asked], top: int) -> DataFrame:
    """``item, rank, doc_id, score`` for one block of items, given as ``item, term, times`` rows."""
    spark = docs.sparkSession
    terms = sorted({r.term for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    vectors = materialize(docs.mapInArrow(_restricted(terms), _VECTOR), "term-vectors")
    n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term of the block at most
        df[row["term"]] = row["count"]
    order = np.lexsort((np.arange(len(terms)), -df))
    rank_of = np.empty(len(terms), dtype=np.int64)
    rank_of[order] = np.arange(len(terms))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df]
    items: list = [([], []) for _ in range(1 + max(r.item for r in rows))]
    for r in rows:
        if df[number[r.term]]:
            items[r.item][0].append(rank_of[number[r.term]])
            items[r.item][1].append(weight[number[r.term]] * r.times)
    plans = [(np.array(ranks, dtype=np.int64), np.array(weights, dtype=np.int64)) for ranks, weights in items]
    some = vectors.where(F.size("terms") > 0)
    found = some.mapInArrow(_searcher(plans, rank_of, n_docs, max(1, n_words), top), "item int, doc_id long, score long")
    return _ranked(found, top).select("item", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of letters and digits, A-Z lower-cased. A score sums, over the item's
    terms with repeats, the term's weight (from the documents that hold it) times a
    saturating share of its count that falls with the document's length; see
    ``term_scores``. Only scores above 0 are ranked; equal scores go by ascending id, and a
    row without id comes after those that have one.

    Rows of ``docs`` that repeat or share an id are documents of their own. Rows of one
    item id, also of none, are one item with the terms of all. A null text has no terms;
    an item without terms, or whose terms no document holds, gets no rows, and neither
    does any where a table is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    lowered = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))).alias("term"))
    asked = materialize(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")
    blocks = max(1, -(-asked.count() // block_terms))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for k in range(blocks):
        # About block_terms rows, and never less than one item's.
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        numbers = {item: i for i, item in enumerate(dict.fromkeys(r.item_id for r in rows))}
        if not numbers:
            continue
        named = spark.createDataFrame([(i, item) for item, i in numbers.items()], f"item int, item_id {kind.simpleString()}")
        ranked = _block(texts, [Asked(numbers[r.item_id], r.term, r.times) for r in rows], top)
        parts.append(ranked.join(named, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    return ranked

