"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from feedframe import build_session  # noqa: E402

HEADLINE = [
    "prj_1_resolve_media",
    "prj_3_post_timestamp",
    "prj_4_flatten_posts",
    "flt_1_between_dates",
    "flt_2_by_author_table",
    "flt_6_postprocess",
    "src_7_parse_responses",
    "rte_2_feed_posts",
    "agg_1_dedup_posts",
    "agg_1_dedup_posts_few_keys",
    "agg_2_dedup_profile_pics",
    "agg_3_page_stats",
    "agg_4_run_summary",
    "pag_1_page_facts",
    "pag_5_page_state",
    "pag_15_truncate_at_stop",
    "join_1_handle_user_ids",
    "join_4_recommended_edges",
    "top_1_best_video",
    "gen_1_video_audio_pairs",
    "gen_3_image_urls",
    "gen_8_post_links",
    "scl_13_safe_target",
    "rpt_2_to_recollect",
    "snk_2_write_parquet",
    "str_2_stream_posts",
]


# Timed beside them, and not in the total: they came later.
MORE = ["pln_1_rebuild_runs_posts", "str_6_stream_stop"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    # One pass over a small query, so that the first timing is not the start of the JVM.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE + MORE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds[n] for n in HEADLINE), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
