"""Registered queries against their oracles on the smallest driver tables.

By default some of each kind; ``FEEDFRAME_ALL=1`` runs all of them.
"""

import os

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SOME = (
    "src_1_document_posts src_4_read_folder src_5_read_runs rte_2_feed_posts prj_4_flatten_posts flt_1_between_dates flt_6_postprocess join_1_handle_user_ids "
    "agg_1_dedup_posts pag_1_page_info pag_2_deep_first pag_3_v1_page_info pag_15_truncate_at_stop top_1_best_video top_5_sort_inputs gen_6_assets gen_8_post_links "
    "snk_1_write_csv snk_7_flatten_to_one_target snk_8_flatten_folder snk_9_save_runs str_2_stream_posts rpt_2_to_recollect"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("FEEDFRAME_ALL") else SOME)
def test_query_matches_its_oracle(spark, duck, name):
    good, note, _ = compare(spark, duck, name, SF_DIR)
    assert good, note


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
