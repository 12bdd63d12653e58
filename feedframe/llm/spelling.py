"""Spelling variants grouped by a reduced alphabet.

Letters are hashed to eight symbols, so a word becomes a reduced word, and two words that
differ by one edit have reduced words that are equal or differ by one edit. A word's full
one-edit neighbourhood has thousands of members over all letters, and only about sixteen
for each letter over eight symbols: all are generated, joined with the vocabulary's
reduced words, and the words met that way are compared as they are written.

Counting and joins are plain DataFrame work; only the neighbourhoods are made in Arrow
batches. What a bitmap of the reduced vocabulary excludes never reaches a shuffle.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedframe.llm.words import KeyFilter, mixed, signed
from feedframe.session import materialize

#: Letters of words; A-Z are lower-cased, no other letter is.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points of a word and occurrences in all, at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times as frequent as a word its form has to be.
RATIO = 5
#: Symbols of the reduced alphabet, and words handled at once.
SYMBOLS, WORDS = 8, 4096

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The vocabulary: ``word, n`` of all words long and frequent enough.

    With ``drop_every``, a letter is taken out of about one in so many runs, which the
    checksum of id and run decides: noise to measure the grouping with.
    """
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # A shorter run cannot become a word; the greedy pattern takes whole runs only.
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    if drop_every is None:
        words = docs.select(F.explode(runs).alias("word"))
    else:
        found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
        found = found.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        words = found.select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Reduced:
    """Words of a batch over the reduced alphabet, as one array of symbols."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.symbols = points % SYMBOLS
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(points)) - self.starts[self.owner]
        longest = int(self.sizes.max(initial=0)) + 2
        self.power = np.cumprod(np.append(np.uint64(1), np.full(longest, _BASE)), dtype=np.uint64)
        values = (self.symbols.astype(np.uint64) + np.uint64(1)) * self.power[self.place]
        sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        first = sums[self.starts]
        self.before = sums[:-1] - first[self.owner]  # of the symbols in front of each
        self.value = values
        self.total = sums[self.starts + self.sizes] - first

    @staticmethod
    def _keys(totals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mixed(totals + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    def keys(self) -> np.ndarray:
        return self._keys(self.total, self.sizes)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and key of every reduced word at most one edit away, its own among them."""
        owner, size, whole = self.owner, self.sizes[self.owner], self.total[self.owner]
        before = np.append(-1, self.symbols[:-1].astype(np.int64)) if len(self.symbols) else np.zeros(0, dtype=np.int64)
        before[self.starts[self.sizes > 0]] = -1
        owners, keys = [np.arange(len(self.sizes))], [self.keys()]
        # Of equal neighbouring symbols, taking out any one gives the same.
        once = self.symbols != before
        shorter = self.before + (whole - self.before - self.value) * _INVERSE
        owners.append(owner[once])
        keys.append(self._keys(shorter[once], size[once] - 1))
        ends = np.arange(len(self.sizes))
        last = np.where(self.sizes > 0, self.symbols[np.maximum(self.starts + self.sizes - 1, 0)] if len(self.symbols) else 0, -1)
        for symbol in range(SYMBOLS):
            code = np.uint64(symbol + 1)
            other = self.symbols != symbol
            swapped = whole - self.value + code * self.power[self.place]
            owners.append(owner[other])
            keys.append(self._keys(swapped[other], size[other]))
            # Put in after a symbol of its kind is the same as before it.
            fresh = before != symbol
            longer = self.before + code * self.power[self.place] + (whole - self.before) * _BASE
            owners.append(owner[fresh])
            keys.append(self._keys(longer[fresh], size[fresh] + 1))
            open_ = last != symbol
            owners.append(ends[open_])
            keys.append(self._keys(self.total[open_] + code * self.power[self.sizes[open_]], self.sizes[open_] + 1))
        return np.concatenate(owners), np.concatenate(keys)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = Reduced(batch.column(0).to_pylist()).keys()
        yield pa.RecordBatch.from_arrays([signed(keys), batch.column(0), batch.column(1)], names=["key", "word", "n"])


def _neighbourhoods(test):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, WORDS):
                words = batch.column(0).slice(begin, WORDS)
                owner, keys = Reduced(words.to_pylist()).neighbours()
                some = test(keys)
                owner, keys = owner[some], keys[some]
                order = np.lexsort((keys, owner))
                owner, keys = owner[order], keys[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
                yield pa.RecordBatch.from_arrays([signed(keys[new]), words.take(pa.array(owner[new]))], names=["key", "word"])

    return make


def reduced_words(words: DataFrame) -> DataFrame:
    """``word, n`` rows with the ``key`` of the reduced word, stored."""
    return materialize(words.select("word", "n").mapInArrow(_reduced, "key long, word string, n long"), "reduced-words")


def near_words(reduced: DataFrame) -> DataFrame:
    """``word, near, near_n``: every pair of ``reduced_words`` that one edit of a code point parts, both ways round."""
    hoods = reduced.select("word").mapInArrow(_neighbourhoods(KeyFilter(reduced, "key").tester()), "key long, word string")
    other = reduced.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Spark takes the neighbourhoods for as small as the words they are made of and would broadcast them.
    met = hoods.hint("merge").join(other, "key").where(F.col("word") != F.col("near"))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each of ``word, n`` rows.

    ``form`` is the near word (one inserted, deleted or replaced code point) of largest
    ``n``, of equal ones the first in code-point order, where it occurs at least ``ratio``
    times as often as the word; else null. ``root`` follows forms to the last one; a word
    without form is its own root. ``words`` holds each word once, with counts above 0, and
    ``ratio`` is 2 or more; an empty table gives no rows.
    """
    reduced = reduced_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_words(reduced).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.near"))
    named = reduced.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), (-F.col("best.n")).alias("best_n"))
    named = materialize(named.select("word", "n", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "word-forms")
    # Counts grow along forms by the ratio at least, which bounds the way to any root.
    most = named.agg(F.max("form_n")).first()[0] or 1
    longest = 1 + int(math.log(most) / math.log(ratio))
    links = named.where("form is not null").select("word", "form")
    return named.join(roots(links, longest), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """``word, root`` from ``word, form`` links without circles, of at most ``longest`` steps; each round doubles the steps taken."""
    found, reach = links.select("word", F.col("form").alias("root")), 1
    while reach < longest:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        found, reach = found.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), 2 * reach
    return found


def spelling_variants(docs: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """Spelling variants in the words of all texts: ``word, form, root, n, n_near, form_n``.

    Words are maximal runs of letters, counted over all rows, also repeated ones; see
    ``word_counts`` and ``variant_forms``. A null text has no words, a null id counts as
    empty text, other columns are not read, and an empty table gives no rows.
    """
    found = variant_forms(word_counts(docs, **options), ratio)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
