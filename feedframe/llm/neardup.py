"""Near-duplicate texts by ProbMinHash, banding and verification.

A text is its shingles (five words) weighted by how often they occur. The similarity is the
probability Jaccard similarity, which is the plain one where all weights are equal. Each
shingle sends arrivals of a Poisson process, as fast as its weight, to random registers;
a register keeps the shingle that arrives first. No arrival after the last register's first
one counts, so generation ends there. Registers of two texts agree with the probability of
their similarity.

Bands of registers make buckets. Pairs are not taken from buckets as such: inside a bucket,
registers of two members give their similarity to within a few hundredths, and

1. only the pairs of a maximum spanning forest are tested by their words. Members that are
   near one another meet through their nearest ones, so copies by the thousand give as many
   pairs as members;
2. where a bucket then still holds several components, each member outside the largest is
   tested with its nearest ones of other components;
3. of what is left apart after that, every pair is tested that the registers do not rule out.

A pair at 0.8 shares no band with probability 0.07, and is ruled out by its registers with
probability 0.01; a class needs only some of its links, so less of them goes missing than
that. Buckets beyond ``BLOCK`` members are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedframe.llm.words import ALNUM, Chunk, KeyFilter, buffers, chunks, mixed, salted, sequences, signed
from feedframe.session import materialize, release

SHINGLE, THRESHOLD = 5, 0.8
#: Registers: BANDS bands of ROWS.
BANDS, ROWS = 24, 10
#: Arrivals a register gets, on average, before the first look and between further looks.
FIRST_LOOK, FURTHER_LOOK = 5.0, 1.5
#: Standard deviations below the threshold at which the registers rule a pair out.
MARGIN = 2.4
#: Members of a bucket compared at once, and nearest ones that a member is tested with.
BLOCK, NEAREST = 2048, 6
#: Pairs of texts that a task compares, about.
TASK_PAIRS = 2048
#: Links that a task joins by itself before components meet.
LOCAL_LINKS = 1 << 20


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle; a text of fewer words is one shingle."""
    hashes, counts = chunk.hashes(), chunk.counts
    at = chunk.windows(SHINGLE)
    owners, values = [chunk.owners()[at]], [sequences(hashes, SHINGLE)[at] if len(at) else np.zeros(0, dtype=np.uint64)]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            owners.append(short)
            values.append(sequences(hashes, n)[chunk.bounds[:-1][short]])
    return np.concatenate(owners), np.concatenate(values)


def weighted(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles of each text, sorted by text."""
    owner, value = shingles(chunk)
    code, times = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)), return_counts=True)
    return (code >> np.uint64(44)).astype(np.int64), mixed(code & np.uint64((1 << 44) - 1)), times.astype(np.float64)


def _draws(element: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The waiting time (at rate 1) before an element's nth arrival, and a hash for its register."""
    x = mixed(element + nth * np.uint64(0x9E3779B97F4A7C15))
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53), salted(x, 1) >> np.uint64(32)


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Registers of each text: the element that arrives first. Texts without elements have zeros."""
    first = np.full(n_texts * m, np.inf)
    holder = np.zeros(n_texts * m, dtype=np.uint64)
    total = np.bincount(owner, weight, minlength=n_texts)
    nth = np.ones(len(element), dtype=np.uint64)
    wait, place = _draws(element, nth)
    at = wait / weight
    open_ = total > 0
    until = np.zeros(n_texts)
    until[open_] = FIRST_LOOK * m / total[open_]
    alive = np.arange(len(element))
    while open_.any():
        alive = alive[open_[owner[alive]]]
        now = alive[at[alive] < until[owner[alive]]]
        while len(now):
            slot = owner[now] * m + ((place[now] * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, slot, at[now])
            won = first[slot] == at[now]
            holder[slot[won]] = element[now[won]]
            nth[now] += np.uint64(1)
            wait, place[now] = _draws(element[now], nth[now])
            at[now] += wait / weight[now]
            now = now[at[now] < until[owner[now]]]
        # Later arrivals cannot win once every register was reached before now.
        open_ &= first.reshape(n_texts, m).max(axis=1) > until if n_texts else open_
        until[open_] += FURTHER_LOOK * m / total[open_]
    return holder.reshape(n_texts, m)


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of each text."""
    n = len(registers)
    out = np.zeros((n, BANDS), dtype=np.uint64)
    parts = registers.reshape(n, BANDS, ROWS)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + parts[:, :, k] + np.uint64(k + 1))
    return salted(out + np.arange(BANDS, dtype=np.uint64), 9)


def _sketcher(first_copy):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets and registers (a byte of each) of each text with words, without rows that are surely copies."""
        for batch in batches:
            batch = batch.filter(pa.array(first_copy(batch.column(1).to_numpy(zero_copy_only=False)), pa.bool_()))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(2), ALNUM, lower=True):
                full = np.flatnonzero(chunk.counts)
                registers = prob_min_hash(*weighted(chunk), chunk.n_texts)[full]
                raw = np.ascontiguousarray((salted(registers, 2) >> np.uint64(56)).astype(np.uint8))
                offsets = (np.arange(len(full) + 1) * registers.shape[1]).astype(np.int32)
                sketches = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                bins = pa.ListArray.from_arrays(pa.array((np.arange(len(full) + 1) * BANDS).astype(np.int32)), signed(bands(registers).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[chunk.first + full]), bins, sketches], names=["key", "bins", "sketch"])

    return sketch


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal registers of each of ``x`` with each of ``y``, less what chance gives to bytes."""
    if len(x) * len(y) <= 4096:
        equal = (x[:, None, :] == y[None, :, :]).sum(axis=2)
    else:
        equal = np.zeros((len(x), len(y)), dtype=np.uint16)
        for k in range(x.shape[1]):
            equal += x[:, k, None] == y[None, :, k]
    return (equal / x.shape[1] - 1 / 256) / (1 - 1 / 256)


def spanning_forest(similar: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over the pairs of at least ``least``, by growing trees."""
    n = len(similar)
    best, link = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    out, open_ = [], np.ones(n, dtype=bool)
    for _ in range(n):
        at = int(np.argmax(np.where(open_, best, -2.0)))
        open_[at] = False
        if best[at] >= least:
            out.append((int(link[at]), at))
        nearer = similar[at] > best
        best[nearer], link[nearer] = similar[at][nearer], at
    return out


def _group_pairs(keys: np.ndarray, labels: np.ndarray, registers: np.ndarray, stage: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket's members to be tested at a stage."""
    similar = agreement(registers, registers)
    similar[labels[:, None] == labels[None, :]] = -1
    np.fill_diagonal(similar, -1)
    if stage == 0:
        edges = np.array(spanning_forest(similar, least), dtype=np.int64).reshape(-1, 2)
        i, j = edges[:, 0], edges[:, 1]
    elif stage == 1:
        # Members of the bucket's largest component are met by the others, not the other way round.
        names, times = np.unique(labels, return_counts=True)
        asking = np.flatnonzero(labels != names[np.argmax(times)]) if times.max() > 1 else np.arange(len(keys))
        near = np.concatenate([np.argsort(-similar[asking[a : a + 256]], axis=1, kind="stable")[:, :NEAREST] for a in range(0, max(1, len(asking)), 256)])
        i, j = np.repeat(asking, near.shape[1]), near.reshape(-1)
        some = similar[i, j] >= least
        i, j = i[some], j[some]
    else:
        i, j = np.nonzero(np.triu(similar >= least, 1))
    return np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])


def _pairs(stage: int, least: float):
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and block; a group is looked at when all of it is there."""
        held: pa.Table | None = None

        def looked(table: pa.Table) -> pa.RecordBatch:
            groups = [table.column(n).to_numpy() for n in ("bin", "low", "high")]
            new = np.any([g[1:] != g[:-1] for g in groups], axis=0)
            cuts = [0, *(1 + np.flatnonzero(new)).tolist(), len(groups[0])]
            keys, labels = table.column("key").to_numpy(), table.column("label").to_numpy()
            raw, offsets = buffers(table.column("sketch").combine_chunks())
            registers = raw.reshape(len(keys), -1)
            found = [_group_pairs(keys[a:z], labels[a:z], registers[a:z], stage, least) for a, z in zip(cuts, cuts[1:], strict=False) if z - a > 1]
            a, b = (np.concatenate([f[k] for f in found]) if found else keys[:0] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held.column(n)[-1].as_py() for n in ("bin", "low", "high")]
            same = np.all([held.column(n).to_numpy() == v for n, v in zip(("bin", "low", "high"), last, strict=True)], axis=0)
            whole = int(np.argmax(same))
            if whole:
                yield looked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield looked(held)

    return pair


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bin and key: each once, and only those whose bin holds another key."""
    held, waiting = None, None  # the last row seen, and whether it has not come out yet
    for batch in batches:
        bins, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.ones(len(bins), dtype=bool)
        new[1:] = (bins[1:] != bins[:-1]) | (keys[1:] != keys[:-1])
        bins, keys = bins[new], keys[new]
        if held is not None and len(bins) and held == (bins[0], keys[0]):
            bins, keys = bins[1:], keys[1:]
        if not len(bins):
            continue
        same = np.zeros(len(bins), dtype=bool)  # as the row before
        same[1:] = bins[1:] == bins[:-1]
        same[0] = held is not None and held[0] == bins[0]
        live = same.copy()
        live[:-1] |= same[1:]
        out_bins, out_keys = bins[live], keys[live]
        if waiting and same[0]:
            out_bins, out_keys = np.append(held[0], out_bins), np.append(held[1], out_keys)
        held, waiting = (bins[-1], keys[-1]), not live[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_bins), pa.array(out_keys)], names=["bin", "key"])


def prob_jaccard(x: dict | tuple, y: tuple) -> float:
    """Probability Jaccard similarity of two weighted sets, as sorted elements and their weights."""
    (xe, xw), (ye, yw) = x, y
    if not len(xe) or not len(ye):
        return 0.0
    both = np.union1d(xe, ye)
    a, b = np.zeros(len(both)), np.zeros(len(both))
    a[np.searchsorted(both, xe)], b[np.searchsorted(both, ye)] = xw, yw
    with np.errstate(divide="ignore"):
        ratio = np.where(a > 0, b / np.where(a > 0, a, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    low, high = np.cumsum(a)[upto - 1], b.sum() - np.cumsum(b)[upto - 1]
    shared = (a > 0) & (b > 0)
    return float(np.sum(1 / (low[shared] / a[shared] + high[shared] / b[shared])))


def _texts(column: pa.Array) -> list[tuple]:
    """Distinct shingles and their counts of each text."""
    found = []
    for chunk in chunks(column, ALNUM, lower=True):
        owner, value = shingles(chunk)
        order = np.argsort(owner, kind="stable")
        value, cuts = value[order], np.searchsorted(owner[order], np.arange(chunk.n_texts + 1))
        found += [np.unique(value[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return found


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                near = [prob_jaccard(a, b) for a, b in zip(_texts(part.column(2)), _texts(part.column(3)), strict=True)]
                kept = pa.array([s >= threshold for s in near], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.float64())], names=["a", "b", "similarity"]).filter(kept)

    return verify


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task's links: each node with the least one it reaches."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    u, v = (table.column(n).to_numpy() for n in ("u", "v"))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        if (least[a] == least[b]).all():
            break
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
    above = least != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[above]), pa.array(nodes[least[above]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes of ``a, b`` edges: the least node of each component.

    Tasks join what links they have, at most ``LOCAL_LINKS`` of them. What several tasks
    found then meets by large and small stars in turn (a node's larger neighbours, then its
    smaller ones, are tied to the least) until nothing changes, each round stored.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    tasks = 1 + links.count() // LOCAL_LINKS
    joined = materialize(links.coalesce(tasks).mapInArrow(_joined, "u long, v long"), "links")
    release(links)
    links, mark = joined, None
    while tasks > 1:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, links = links, materialize(small.where("u <> v").distinct(), "links")
        release(before)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select("v", "v").distinct())


def _dealt(marked: DataFrame, sizes: DataFrame, every: bool) -> DataFrame:
    """Members of buckets in groups of bounded size: blocks, or with ``every`` all pairs of blocks."""
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    rows = marked.join(sizes, "bin").withColumn("block", block)
    if not every:
        return rows.withColumn("low", F.col("block")).withColumn("high", F.col("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def linked(rows: DataFrame, firsts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key, label`` of texts that are near another: ``rows`` has ``doc_id, key, sha, text``, ``firsts`` the first row of each text."""
    spark = rows.sparkSession
    code = F.xxhash64("key", "doc_id").alias("code")
    sketcher = _sketcher(KeyFilter(firsts.select(code), "code").tester())
    sketches = materialize(rows.select("key", code, "text").mapInArrow(sketcher, "key long, bins array<long>, sketch binary"), "sketches")
    bins = sketches.select(F.explode("bins").alias("bin"), "key")
    buckets = materialize(bins.repartition("bin").sortWithinPartitions("bin", "key").mapInArrow(_sharing, "bin long, key long"), "buckets")
    members = buckets.select("key").distinct()
    registers = materialize(sketches.join(members, "key", "left_semi").select("key", "sketch").dropDuplicates(["key"]), "registers")
    release(sketches)
    labels = spark.createDataFrame([], "key long, label long")
    least = threshold - MARGIN * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5
    stored, edges, tested = [buckets, registers], None, None
    for stage in range(3):
        marked = buckets.join(labels, "key", "left").select("bin", "key", F.coalesce("label", "key").alias("label"))
        several = marked.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        sizes = several.select("bin", F.expr(f"1 + (n - 1) div {BLOCK}").alias("blocks"))
        dealt = _dealt(marked, sizes, every=stage == 2).join(registers, "key").select("bin", "low", "high", "key", "label", "sketch")
        grouped = dealt.repartition("bin", "low", "high").sortWithinPartitions("bin", "low", "high", "key")
        pairs = grouped.mapInArrow(_pairs(stage, least), "a long, b long").distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        stored.append(pairs)
        n_pairs = pairs.count()
        if not n_pairs:
            continue
        tested = pairs if tested is None else tested.union(pairs)
        # Few pairs make few files, whatever the number of shuffle partitions.
        tasks = max(spark.sparkContext.defaultParallelism, 1 + n_pairs // TASK_PAIRS)
        near = materialize(_verified(rows, firsts, pairs, threshold, tasks), "near-pairs")
        edges = near if edges is None else edges.union(near)
        stored += [near, labels]
        labels = materialize(components(edges).select(F.col("node").alias("key"), "label"), "labels")
    release(*stored)
    return labels


def _verified(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """Pairs of keys whose texts reach the threshold, with their similarity, by ``tasks`` tasks at most."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    ends = materialize(ends.join(firsts.select("key", F.col("doc_id").alias("first_id"), "sha"), "key").coalesce(tasks), "pair-ends")
    needed = rows.where(KeyFilter(ends, "key").may_hold("key")).alias("r").join(ends.alias("e"), F.expr("r.key = e.key and r.sha = e.sha and doc_id <=> first_id"))
    # One text for each key, also where rows repeat; the copies of a text have other ids and stay behind.
    texts = materialize(needed.select("r.key", "text").dropDuplicates(["key"]).coalesce(tasks), "pair-texts")
    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")
    return joined.select("a", "b", "a_text", "b_text").coalesce(tasks).mapInArrow(_verifier(threshold), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept``, and the text's ``key``.

    Texts are linked when equal, or when their word shingles (letters and digits, case
    folded) have a similarity of ``threshold`` or more; classes are what links connect.
    ``class_id`` is the least id of the class, and its row is kept; of equal rows one is.
    Texts without words are linked to equal texts only; a null text is empty. A null id
    stands above all others, and a class of null ids has a null ``class_id`` and keeps one
    row. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"))
    ids = materialize(rows.select("doc_id", "key", "sha"), "near-ids")
    firsts = materialize(ids.groupBy("key", "sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "near-firsts")
    labels = linked(rows, firsts, threshold)
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("known"), "doc_id", "key")
    classes = firsts.join(labels, "key", "left").select("*", F.coalesce("label", "key").alias("class"))
    heads = classes.groupBy("class").agg(F.min(order).alias("head"), F.sum("n").alias("class_size"))
    of_text = classes.select("key", "sha", "class").join(heads, "class").select("key", "sha", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("head_key"), "class_size")
    equal = Window.partitionBy("key", "doc_id").orderBy(F.lit(0))
    joined = ids.join(of_text, ["key", "sha"])
    keeps = joined.where(F.col("key") == F.col("head_key")).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keeps = keeps.withColumn("kept", F.row_number().over(equal) == 1)
    rest = joined.where(~((F.col("key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("class_id")))).withColumn("kept", F.lit(False))
    return keeps.unionByName(rest).select("doc_id", "class_id", "class_size", "kept", "key")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    names, id_col, text_col = docs.columns, options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = near_duplicates(docs, **options).where("kept").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    keyed = docs.select(row, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_at"), F.col(id_col).cast("long").alias("_doc"))
    joined = keyed.join(kept, (F.col("_at") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")))
    equal = Window.partitionBy("_at", "_doc").orderBy(F.lit(0))
    return joined.withColumn("_nth", F.row_number().over(equal)).where("_nth = 1").select("_row.*")
