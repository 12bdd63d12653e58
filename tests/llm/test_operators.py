"""The operators against plain versions, on small inputs with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedframe.llm import chat, exact, leakage, mixing, neardup, quality, sharding, spans, toxicity, warc, words
from feedframe.llm.queries import crc_fold
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, shard int, _row string, target string"


def prose(rng, n):
    return " ".join(rng.choice("the of And in. on réa que ein der x9 zu - ,".split()) + rng.choice(["", "", "a", "bé", "q1"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, nulls, empty, blank and very long texts."""
    rng = random.Random(4)
    passage, base = prose(rng, 60), prose(rng, 200)
    found = [prose(rng, rng.choice([0, 1, 4, 12, 13, 14, 40, 300])) for _ in range(40)]
    found += [f"{prose(rng, 30)} {passage}\n{prose(rng, 30)}" for _ in range(12)]
    found += [base, base.replace(" que ", " QUE ", 2), base + " tail", base, base]
    found += ["la " * 400, "la " * 401, None, "", "  \n\t ", None, "!!! ???", prose(rng, 20_000)]
    order = list(enumerate(found))
    rng.shuffle(order)
    return [(i, t) for (i, (_, t)) in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, texts):  # noqa: F811
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, 7, "r", "t") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)


def test_words_are_those_of_the_pattern(texts):
    column = pa.array([t for _, t in texts])
    for table, lower, pattern in ((words.VISIBLE, False, brute.VISIBLE), (words.ALNUM, True, brute.ALNUM)):
        got = []
        for chunk in words.chunks(column, table, lower):
            out, offsets, _ = chunk.stream()
            got += [out[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        want = [" ".join(pattern.findall(brute.lowered(t) if lower else t or "")) for _, t in texts]
        assert got == want


def test_substring_dedup(docs, texts, nothing):
    got = sorted(tuple(r)[:4] for r in spans.remove_repeats(docs).collect())
    assert got == sorted(brute.repeats(texts))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in spans.remove_repeats(docs).collect())
    assert spans.remove_repeats(nothing).count() == 0


def test_substring_dedup_of_repeated_ids_and_null_ids(spark, texts):  # noqa: F811
    rows = [(i // 2, t) for i, t in texts] + texts[:5] + [(None, t) for _, t in texts[:9]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:4] for r in spans.remove_repeats(frame).collect()), key=order) == sorted(brute.repeats(rows), key=order)


def test_decontamination(spark, docs, texts, nothing):  # noqa: F811
    long = max((t for _, t in texts if t), key=len).split()
    items = [(1, " ".join(long[50:75])), (2, "la"), (3, None), (4, ""), (5, " ".join(long[60:70]).upper()), (6, "la la la"), (7, "nowhere to be found at all"), (10, "la"), (None, "la")]
    items += [(20 + i, t) for i, t in texts[:6]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in leakage.benchmark_hits(docs, bench).collect())
    assert got == sorted(brute.contamination(texts, items))
    clean = {r.doc_id for r in leakage.decontaminated(docs, bench).collect()}
    assert clean == {d for d, _, n, _ in got if not n}
    assert leakage.benchmark_hits(nothing, bench).count() == 0
    assert leakage.benchmark_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_near_duplicates(docs, texts, nothing):
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute.near_classes(texts)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})
    assert neardup.one_of_each(docs).columns == docs.columns
    assert neardup.one_of_each(docs).count() == len({r.class_id for r in got})
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_small_blocks_lose_no_link(spark, monkeypatch):  # noqa: F811
    """Texts around a common one, many of them below the threshold, in buckets of several blocks."""
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"x{rng.randint(0, 99999)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:60] + [f"y{rng.randint(0, 99999)}" for _ in range(60)])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.near_classes(rows)
    for block in (2048, 9):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in neardup.near_duplicates(frame).collect()} == want


def test_spanning_forest_takes_the_nearest():
    similar = np.array([[-1, 0.9, 0.8, 0], [0.9, -1, 0.95, 0], [0.8, 0.95, -1, 0.5], [0, 0, 0.5, -1]])
    assert {frozenset(e) for e in neardup.spanning_forest(similar, 0.7)} == {frozenset((0, 1)), frozenset((1, 2))}
    x = np.array([[1, 2, 3, 4], [1, 2, 9, 9]], dtype=np.uint8)
    assert neardup.agreement(x, x)[0, 1] == pytest.approx((0.5 - 1 / 256) / (1 - 1 / 256))


def test_near_duplicates_keep_one_of_equal_rows(spark):  # noqa: F811
    frame = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "x")] * 2, "doc_id long, text string")
    assert neardup.one_of_each(frame).count() == 2


def test_prob_jaccard_is_its_definition():
    rng = random.Random(2)
    for _ in range(50):
        x = {k: rng.randint(1, 4) for k in rng.sample(range(12), rng.randint(1, 10))}
        y = {k: rng.randint(1, 4) for k in rng.sample(range(12), rng.randint(1, 10))}
        pair = [(np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)], dtype=float)) for d in (x, y)]
        assert neardup.prob_jaccard(*pair) == pytest.approx(brute.similarity(x, y))


def test_registers_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(1, 1 << 63, 90).astype(np.uint64), rng.integers(1, 1 << 63, 20).astype(np.uint64)
    sets = [np.sort(np.concatenate([shared, own[:10]])), np.sort(np.concatenate([shared, own[10:]]))]
    got = neardup.prob_min_hash(np.repeat([0, 1], 100), np.concatenate(sets), np.ones(200), 2, m=4000)
    assert (got[0] == got[1]).mean() == pytest.approx(90 / 110, abs=0.03)


@pytest.mark.parametrize("local", [1 << 20, 4])
def test_components_of_a_chain(spark, monkeypatch, local):  # noqa: F811
    monkeypatch.setattr(neardup, "LOCAL_LINKS", local)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(50, 40), (60, 60)], "a long, b long").repartition(7)
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def test_mixing(docs, texts, nothing):
    rows = mixing.mix_sources(docs).collect()
    size = {i: len(brute.VISIBLE.findall(t or "")) for i, t in texts}
    assert {r.doc_id: r["size"] for r in rows} == size
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    for source in by_source.values():
        assert sum(r.taken for r in source) == int(source[0].target)
    total = sum(size.values())
    assert sum(s[0].target for s in by_source.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(sorted(by_source, key=lambda s: (s is None, s or "")), [3, 1, 2, 3, 1], strict=True))
    level = max(s[0].target / weights[k] for k, s in by_source.items())
    for k, s in by_source.items():
        assert s[0].target == pytest.approx(min(level * weights[k], 2 * s[0].source_size))
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(nothing).count() == 0


def test_mixing_keeps_bins_apart(docs, monkeypatch):
    whole = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    assert {(r.doc_id, r.taken) for r in mixing.mix_sources(docs).collect()} == whole


def test_exact_dedup(spark, docs, texts, nothing):  # noqa: F811
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact.dedup_texts(docs).collect()} == want
    assert {tuple(r) for r in exact.dedup_texts(docs, capacity=3).collect()} == want
    assert exact.dedup_texts(nothing).count() == 0
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact.dedup_texts(odd).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got} == {1, None}


def test_directory_splits_overfull_buckets_only():
    found = exact.directory({0: 5, 1: 5, 2: 1, 7: 1}, capacity=5, depth=3)
    assert found == [(0, 0, 3), (1, 1, 3), (2, 3, 2), (4, 7, 1)]


def test_sharding(docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 4000)
    rows = sharding.write_shards(docs, bucket_bytes=4000).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in texts]
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert dict(texts) == {r.doc_id: r.text for r in rows}
    assert sharding.write_shards(nothing).count() == 0


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(1000, (1, 2)).tolist()) == list(range(1000))
    assert sharding.fisher_yates(0, (1, 2)).tolist() == []


pieces = st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "|turn|>", "</s>", "a", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces | st.text(max_size=3), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROLS + chat.FOREIGN)


def test_chat_round_trip(spark):  # noqa: F811
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 0, None, "x"), (2, None, "tool", "é <|turn|>"), (None, 0, "assistant", "y" * 5000), (1, 1, "assistant", said)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {}
    for r in chat.format_conversations(frame).collect():
        got[r.conv_id] = chat.read_turns(r.input_ids, r.loss_mask)
        assert r.n_chars == len(chat.rendered(r.input_ids))
        assert len(r.input_ids) == len(r.loss_mask)
    assert got[1] == [("user", said, False), ("assistant", said, True), ("assistant", said, True), ("assistant", "", False)]
    assert got[2] == [("tool", "é <|turn|>", False), ("", "x", False)]
    assert got[None] == [("assistant", "y" * 5000, True)]
    parts = chat.format_conversations(frame, part_tokens=4).where("conv_id = 1").orderBy("part").collect()
    assert len(parts) > 1 and [t for p in parts for t in chat.read_turns(p.input_ids, p.loss_mask)] == got[1]
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_loss_mask_by_prefix_sums():
    assert chat.loss_mask([2, 0, 3, 1], [True, True, False, True]).tolist() == [1, 1, 0, 0, 0, 1]
    assert chat.loss_mask([], []).tolist() == []


def test_warc_of_rows_that_come_in_another_order_each_time(spark):  # noqa: F811
    """Pages out of an aggregation, read by several plans with other columns and partitions."""
    rows = [(i, f"http://a{i % 7}.example.com/{i}", f"<p>{i % 40}</p>" if i % 3 else f"own {i}") for i in range(600)]
    frame = spark.createDataFrame([r for r in rows for _ in range(2)], "page_id long, url string, html string").repartition(9)
    from pyspark.sql import functions as F

    pages = frame.groupBy("page_id").agg(F.max("url").alias("url"), F.max("html").alias("html"))
    index = warc.capture_index(spark, warc.write_archives(pages))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()}
    assert got == brute.captures([(p, h) for p, _, h in rows]) and index.count() == 600


def test_small_payloads_are_all_responses(spark):  # noqa: F811
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "v", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc.capture_index(spark, warc.write_archives(frame, least=3)).collect()
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in rows if r.page_id < 3) == [(1, "u", "response", None), (2, "u", "response", None)]
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in rows if r.page_id > 2) == [(3, "u", "revisit", 4), (4, "u", "revisit", 4), (4, "v", "response", None)]


def test_warc(spark):  # noqa: F811
    rows = [(i, f"http://a{i % 2}.example.com/é?x={i}\r\nWARC-Type: x", h) for i, h in enumerate(["<p>", None, "", "a\r\n\r\nWARC/1.1\r\n\r\nb", "<p>", "é" * 3000, "<p>", "\r\n\r\n"])]
    rows += [(8, None, "own"), (8, None, "own")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string")
    index = warc.capture_index(spark, warc.write_archives(frame))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect() if r.page_id != 8]
    want = brute.captures([(p, h) for p, _, h in rows if p != 8])
    assert {g[0]: g[1:] for g in got} == want and len(got) == 8
    assert sorted(r.record_type for r in index.where("page_id = 8").collect()) == ["response", "revisit"]
    order = [(r.url_key, r.captured) for r in index.collect()]
    assert order == sorted(order)
    assert warc.capture_index(spark, warc.write_archives(frame.limit(0))).count() == 0


def test_loser_tree_merges():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


@pytest.fixture(scope="module")
def labelled(spark):  # noqa: F811
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = prose(rng, 60) if not bad else " | ".join(prose(rng, 30).split())
        if toxic:
            text += ". What a scumface thing. " + prose(rng, 10)
        rows.append((i, text, "s", 1, "r", "t"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(400, None, "s", 1, "r", "t"), (401, "", "s", 1, "r", "t")]
    labels += [(None, 1, 1), (5, None, None), (9999, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality(labelled, nothing):
    frame, labels, truth = labelled
    rows = quality.quality_scores(frame, labels, crc_fold(4, 2)).collect()
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id][0]) for r in held]) > 0.95
    assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(nothing, labels, crc_fold(4, 2)).count() == 0
    assert {r.score for r in quality.quality_scores(frame, labels.limit(0), crc_fold(4, 2)).collect()} == {0.5}


def test_toxicity_and_its_sentences(labelled, nothing):
    frame, labels, truth = labelled
    rows = toxicity.toxicity_scores(frame, labels, crc_fold(3, 1)).collect()
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.7) == bool(truth[r.doc_id][1]) for r in held]) > 0.95
    for r in held:
        for span in r.offending:
            assert "scumface" in r.text.encode()[span["start"] : span["end"]].decode()
    assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(nothing, labels, crc_fold(3, 1)).count() == 0


def test_scores_of_rows_with_any_column_names(spark):  # noqa: F811
    frame = spark.createDataFrame([(1, "a b c", 5, "x"), (2, None, None, None)], "doc_id long, text string, `my col-1` int, `from:to` string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 7, -1)], "doc_id long, quality int, toxic int")
    for rows in (quality.quality_scores(frame, labels, crc_fold(4, 2)), toxicity.toxicity_scores(frame, labels, crc_fold(3, 1))):
        assert rows.columns[:4] == frame.columns
        assert sorted((r[0], r[2]) for r in rows.collect()) == [(1, 5), (2, None)]


def test_held_out_labels_are_not_learned(labelled):
    frame, labels, _ = labelled
    sample, n = quality.labelled_sample(frame, labels, "quality", crc_fold(4, 2), 100)
    ids = [r.doc_id for r in sample.collect()]
    assert n == 100 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
