"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A batch of texts is one byte array with offsets. Words are runs of bytes of a class, found
with array operations; a word's 64-bit hash comes from prefix sums, so that no Python
object is made for a word or a text. All classes used here are unions of ASCII ranges and
"every byte above 0x7F", so cutting UTF-8 at bytes never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes that a word is made of."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
VISIBLE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Maps A-Z to a-z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed copy of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same values, one for each salt."""
    return mixed(x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if size > 4 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Chunk:
    """Some texts of a batch, cut into words."""

    first: int  # index of the first text in the batch
    data: np.ndarray  # bytes, after case folding
    texts: np.ndarray  # byte offsets of the texts, one more than texts
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    bounds: np.ndarray  # word offsets of the texts, one more than texts

    @property
    def n_texts(self) -> int:
        return len(self.texts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text (index in the chunk) of each word."""
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, begin: int, end: int) -> bytes:
        """Words ``begin`` to ``end`` (not with it), joined by one space."""
        return b" ".join(self.word(i) for i in range(begin, end))

    def stream(self, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (kept) words of each text joined by one space, all texts in one array.

        Returns bytes, offsets of the texts in them, and where each such word starts.
        """
        at = np.arange(len(self.starts)) if kept is None else np.flatnonzero(kept)
        owner = self.owners()[at]
        more = np.zeros(len(at), dtype=np.int64)
        more[:-1] = owner[1:] == owner[:-1]
        sizes = self.ends[at] - self.starts[at] + more
        steps = np.zeros(len(self.data) + 2, dtype=np.int8)
        steps[self.starts[at]] += 1
        steps[self.ends[at] + more] -= 1
        spaced = self.data.copy()
        spaced[self.ends[at][more == 1]] = 0x20  # a word before another of its text has a separator behind it
        out = spaced[np.cumsum(steps[: len(self.data)], dtype=np.int8).astype(bool)]
        starts = np.cumsum(sizes) - sizes
        offsets = np.append(starts, len(out))[np.searchsorted(at, self.bounds)]
        return out, offsets, starts

    def windows(self, n: int) -> np.ndarray:
        """The word positions at which ``n`` consecutive words of one text start."""
        room = self.counts - (n - 1)
        keep = room > 0
        room, at = room[keep], self.bounds[:-1][keep]
        if not len(room):
            return np.zeros(0, dtype=np.int64)
        before = np.cumsum(room) - room
        return np.repeat(at - before, room) + np.arange(room.sum())


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each position on, for all but the last ``n - 1``."""
    size = max(0, len(hashes) - n + 1)
    total = np.full(size, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total *= _STEP
        total += hashes[k : k + size]
    return mixed(total)


def chunks(column: pa.Array, table: np.ndarray, lower: bool = False) -> Iterator[Chunk]:
    """The texts of a column in order, about ``CHUNK_BYTES`` of whole texts at a time."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = LOWER[part]
        texts = offsets[first : last + 1] - offsets[first]
        inside = table[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = texts[:-1][texts[:-1] < len(part)]
        begins[heads] = inside[heads]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        tails = heads[heads > 0] - 1
        closes[tails] = inside[tails]
        starts = np.flatnonzero(begins)
        yield Chunk(first, part, texts, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, texts))
        first = last


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as an Arrow column of longs, bit by bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


class KeyFilter:
    """A set of 64-bit keys as one bitmap: no key is missed, others pass at times.

    It saves a shuffle for rows that cannot have a partner. The join behind it decides, so
    a full bitmap costs time and changes no result. The bitmap has about ``SPACE`` bits
    for a key, from 2**LEAST to 2**MOST bits (8 kB to 16 MB).
    """

    LEAST, MOST, SPACE = 16, 27, 16

    def __init__(self, keys: DataFrame, column: str):
        # Spark's bitmaps have 2**15 bits; value v + 1 is bit v % 2**15 of bucket v / 2**15 + 1.
        self.bits = max(self.LEAST, min(self.MOST, (keys.count() * self.SPACE).bit_length()))
        bit = F.expr(f"shiftrightunsigned({column}, {64 - self.bits}) + 1")
        parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        found = np.zeros((1 << self.bits) // 8, dtype=np.uint8)
        for row in parts.collect():  # 2**12 rows of 4 kB at most
            begin = (row.part - 1) * 4096
            found[begin : begin + 4096] |= np.frombuffer(row.bits, dtype=np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(found)

    def tester(self):
        """A function from an array of hashes to flags, for use in tasks."""
        shared, bits = self.shared, self.bits

        def test(hashes: np.ndarray) -> np.ndarray:
            at = hashes.view(np.uint64) >> np.uint64(64 - bits)
            return ((shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

        return test

    def may_hold(self, column: str) -> Column:
        """Whether the key in a column may be in the set."""
        test = self.tester()

        @F.arrow_udf("boolean")
        def check(values: pa.Array) -> pa.Array:
            return pa.array(test(values.to_numpy(zero_copy_only=False)))

        return check(F.col(column))
