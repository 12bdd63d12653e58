"""The pipeline stage by stage, and its queries, on the smallest driver tables."""

import os

import pytest

import corpus_pipeline
from feedframe.llm import queries
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.doc_id for r in docs.collect()]
        if name != names[-1]:
            assert docs.columns == columns
        if name == "near-dedup":
            assert sorted(after) == sorted(set(brute.near_classes(before).values()))
        if name == "decontamination":
            assert sorted(after) == sorted(d for d, _, n, _ in brute.contamination(before, items) if not n)
        if name == "sharding":
            assert sorted(after) == sorted(d for d, _ in before)
        assert after


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    from checks import compare

    got = queries.QUERIES[name](spark, SF_DIR)
    want = compare.connect(SF_DIR).execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert compare._bag(got.columns, [tuple(r) for r in got.collect()]) == compare._bag(columns, want.fetchall())
