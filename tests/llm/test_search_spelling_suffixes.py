"""Ranked search, spelling variants and byte-level dedup against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from feedframe.llm import ranking, spelling, suffixes
from tests.llm import brute
from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, rank int, term string, word string, bytes int, bin string, item_id int"
EXTRA = (7, "t", "w", 1, "b", 3)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    passage = prose(rng, 60)
    found = [prose(rng, rng.choice([0, 1, 4, 12, 40, 300])) for _ in range(60)]
    found += [f"{prose(rng, 30)} {passage}\n{prose(rng, 30)}" for _ in range(20)]
    found += ["la " * 400, "la " * 401, "aaaa" * 90, None, "", " \n ", None, "!!!", prose(rng, 9000), passage, passage, passage]
    rng.shuffle(found)
    return list(enumerate(found))


def ranks(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_ranking(spark, texts):  # noqa: F811
    rng = random.Random(12)
    items = [(k, prose(rng, rng.choice([1, 3, 30]))) for k in range(30)] + [(40, None), (41, ""), (42, "absent-word"), (43, "LA la the"), (None, "the of"), (44, "réa"), (44, "réa in")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    docs = [*texts, (None, "la la the of"), (None, "la la the of"), (3, "la la the of")]
    want = sorted(brute.ranking(docs, items), key=repr)
    assert ranks(ranking.rank_documents(frame(spark, docs), asked)) == want
    # Items in many blocks, documents in one task, trees of many levels.
    assert ranks(ranking.rank_documents(frame(spark, docs, 1), asked, block_terms=20)) == want
    assert ranks(ranking.rank_documents(frame(spark, docs), asked, top=2)) == sorted(brute.ranking(docs, items, top=2), key=repr)
    assert ranking.rank_documents(frame(spark, []), asked).count() == 0
    assert ranking.rank_documents(frame(spark, docs), asked.limit(0)).count() == 0


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(1)
    rows = []
    for d in range(3000):
        terms = np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 40)), 200)) - 1
        rows.append((d, int(rng.integers(40, 400)), terms.tolist(), rng.integers(1, 6, len(terms)).tolist()))
    table = pa.table({"doc_id": [r[0] for r in rows], "n": [r[1] for r in rows], "terms": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "tfs": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})
    n_words = sum(r[1] for r in rows)
    tree = ranking.tree_of(table, np.arange(200), 3000, n_words)
    leaves = [(a, b) for a, b, c in zip(tree.low, tree.high, tree.children, strict=True) if not c]
    assert sorted(leaves)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(leaves), sorted(leaves)[1:], strict=False))
    assert max(b - a for a, b in leaves) <= ranking.LEAF_DOCS
    for _ in range(40):
        terms, weights = np.unique(rng.integers(0, 200, 12)), rng.integers(0, 5000, 12)
        weights = weights[: len(terms)]
        best = ranking.Best(20)
        taken = []
        take = best.take
        best.take = lambda *a, take=take, taken=taken: (taken.append(len(a[0])), take(*a))
        tree.search(terms, weights, best)
        scores = []
        for d, n, ts, tfs in rows:
            m = 75 + 25 * n * 3000 // n_words
            got = dict(zip(ts, tfs, strict=True))
            scores.append((-sum(int(w) * (10**9 * got[t] // (1000 * got[t] + 12 * m)) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in got), d))
        want = [(-s, d) for s, d in sorted(scores)[:20] if s < 0]
        assert list(zip(best.scores.tolist(), best.ids.tolist(), strict=True)) == want
    assert sum(taken) < len(rows)


def test_spelling(spark):  # noqa: F811
    rng = random.Random(13)
    base = ["planet", "planets", "plànets", "kettles", "kettle", "mountain", "mountaine", "Montain", "aaaaaa", "aaaaaaa", "aaaaaab", "×÷×÷×÷", "short"]
    base += ["".join(rng.choice("abdé") for _ in range(rng.choice([6, 7, 8]))) for _ in range(120)] + ["x" * 300, "x" * 299 + "y"]
    weight = [rng.choice([1, 5, 6, 30, 200]) for _ in base]
    docs = [(d, " ".join(rng.choices(base, weight, k=400)) + rng.choice([".", "\n", "1"])) for d in range(40)] + [(None, "planets kettles " * 9), (40, None), (41, ""), (1, "planet " * 8)]
    for every in (None, 3):
        got = sorted(tuple(r) for r in spelling.spelling_variants(frame(spark, docs), drop_every=every).collect())
        assert got == sorted(brute.variants(docs, every))
    assert any(r[1] != r[2] for r in brute.variants(docs, 3))
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, docs[-3:-1])).count() == 0


def test_roots_follow_long_chains(spark):  # noqa: F811
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("a", "w03")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(links, longest=21).collect()}
    assert set(got.values()) == {"w21"} and len(got) == 22


def test_neighbourhoods_are_whole():
    words = ["abc", "aa", "", "abcabc", "bbbbb"]
    owner, keys = spelling.Reduced(words).neighbours()
    for k, w in enumerate(words):
        s = [ord(c) % 8 for c in w]
        every = {tuple(s)} | {tuple(s[:i] + s[i + 1 :]) for i in range(len(s))} | {tuple([*s[:i], c, *s[i + 1 :]]) for i in range(len(s)) for c in range(8)}
        every |= {tuple([*s[:i], c, *s[i:]]) for i in range(len(s) + 1) for c in range(8)}
        # Reduced words are made of the letters h, a, ..., g, whose code points are 0 to 7 modulo 8.
        want = set(spelling.Reduced(["".join("habcdefg"[c] for c in x) for x in every]).keys().tolist())
        mine = keys[owner == k].tolist()
        assert set(mine) == want and len(mine) == len(want)


def test_neighbourhoods_are_not_broadcast(spark):  # noqa: F811
    words = spark.createDataFrame([("planet", 9), ("planets", 3), ("garden", 5)], "word string, n long")
    near = spelling.near_words(spelling.reduced_words(words))
    assert "BroadcastExchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.near, r.near_n) for r in near.collect()} == {("planet", "planets", 3), ("planets", "planet", 9)}


def byte_rows(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_byte_dedup(spark, texts):  # noqa: F811
    rows = [*texts, (None, texts[5][1]), (None, "la " * 400), (500, "é" * 300), (501, "x" + "é" * 90), (502, "y" * 99), (503, "y" * 100), (504, "y" * 101)]
    want = sorted(brute.byte_repeats(rows), key=repr)
    got = suffixes.remove_repeated_bytes(frame(spark, rows))
    assert byte_rows(got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    # Every bin with more than one kind of run by groups instead of in a task.
    assert byte_rows(suffixes.remove_repeated_bytes(frame(spark, rows), bin_runs=1)) == want
    assert byte_rows(suffixes.remove_repeated_bytes(frame(spark, rows), window=30, gram=7)) == sorted(brute.byte_repeats(rows, 30), key=repr)
    assert suffixes.remove_repeated_bytes(frame(spark, [])).count() == 0


def test_byte_dedup_of_repeated_rows(spark):  # noqa: F811
    rng = random.Random(14)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, a), (2, a), (2, a), (3, b + " " + a), (3, b + " " + a), (0, "short")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeated_bytes(frame(spark, rows), keep_text=False).collect())
    n, m = len(a.encode()), len((b + " " + a).encode())
    assert got == [(0, 5, 0, 0), (1, n, 0, 0), (1, n, 0, 0), (2, n, n, 1), (2, n, n, 1), (3, m, n, 1), (3, m, n, 1)]


def test_sort_tells_windows_of_one_code_apart(monkeypatch):
    """Where all codes collide, bytes still decide."""
    monkeypatch.setattr(suffixes, "mixed", lambda x: x * np.uint64(0))
    rows = [(1, b"a" * 4 + b"xyzw"), (2, b"bxyzwq"), (3, b"xyzwq123")]
    table = pa.table({"bin": [9, 9, 9], "doc_id": [r[0] for r in rows], "key": [0, 0, 0], "begin": pa.array([0, 5, 0], pa.int32()), "bytes": pa.array([r[1] for r in rows], pa.binary())})
    got = suffixes.sort_windows(table, window=4, digit=2).to_pylist()
    assert [(r["doc_id"], r["begin"], r["size"]) for r in got] == [(2, 6, 4), (3, 0, 5)]
