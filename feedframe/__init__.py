"""Analytics over collected posts: response logs and result files in, tidy tables out."""

from feedframe.operators.assets import (
    assets,
    image_plan,
    image_urls,
    post_links,
    post_profile_pics,
    user_profile_pics,
    video_audio_pairs,
    video_plan,
    video_urls,
)
from feedframe.operators.dedup import dedup_posts, dedup_profile_pics
from feedframe.operators.filters import between_dates, by_author, postprocess
from feedframe.operators.flatten import flatten_posts, resolve_media
from feedframe.operators.joins import (
    handle_user_ids,
    new_posts,
    private_runs,
    recommended_edges,
    typed_users,
)
from feedframe.operators.paging import (
    default_stop_rules,
    page_facts,
    page_info,
    page_state,
    page_stats,
    run_results,
    stop_code,
    truncate_at_stop,
    v1_page_info,
    with_page_stats,
    with_stop_code,
)
from feedframe.operators.reports import (
    author_filter_alarm,
    response_counts,
    run_summary,
    runs_by_category,
    to_recollect,
)
from feedframe.operators.routing import (
    chaining_users,
    feed_posts,
    profile_users,
    route,
    route_posts,
    route_users,
    search_posts,
    shortcode_posts,
)
from feedframe.plans.lifecycle import rebuild_runs
from feedframe.schemas import FLAT_SCHEMA, PAGE_SCHEMA, POST_SCHEMA
from feedframe.session import build_session
from feedframe.sinks.runs import run_documents, save_all, save_posts, save_runs
from feedframe.sinks.tables import (
    append_jsonl,
    export_posts,
    flatten_paths,
    write_csv,
    write_jsonl,
    write_parquet,
)
from feedframe.sources.files import concat_inputs, read_posts, read_runs, sort_inputs
from feedframe.sources.requests import split_requests, validate_requests
from feedframe.sources.responses import filter_api_responses, parse_responses, payload_rows
from feedframe.streaming.pages import stream_dedup, stream_pages, stream_posts, stream_users
from feedframe.streaming.sinks import fan_out, jsonl_sink, on_new_posts, video_plan_sink, write_stream
from feedframe.streaming.stops import stream_page_rows, stream_page_states, stream_stop
