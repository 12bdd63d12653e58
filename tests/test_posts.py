import pytest
from pyspark.sql import functions as F

import feedframe as ff
from feedframe.functions import posts as fns
from feedframe.functions import scalars
from feedframe.operators.filters import is_rate_limited


def values(df, column):
    return [r[0] for r in df.select(column.alias("v")).collect()]


def node(owner="77", user=None, coauthors=None, taken_at=1700000000):
    return {
        "__typename": "XDTMediaDict",
        "pk": "1",
        "taken_at": taken_at,
        "user": user,
        "owner_id": {"pk": owner, "id": owner},
        "coauthor_producers": coauthors or [],
    }


def kept(frame, handle, ids=None):
    return [r.page_seq for r in ff.by_author(frame, handle, ids).orderBy("page_seq").collect()]


def test_author_falls_back_to_owner_id_only_without_a_name(raw):
    frame = raw(node(), node(owner="9"), node(user={"username": "Other"}), node(user={"username": ""}))
    assert kept(frame, "some_handle") == []
    assert kept(frame, "some_handle", ["77"]) == [0, 3]


def test_author_and_coauthor_match_in_any_case(raw):
    frame = raw(node(user={"username": "Some_Handle"}), node(user={"username": "x"}, coauthors=[None, {"username": "SOME_handle"}]))
    assert kept(frame, "some_handle") == [0, 1]


def test_malformed_nodes_match_nobody(raw):
    assert kept(raw({}, {"user": "text"}, {"coauthor_producers": [None]}), "x") == []


def test_author_ids_from_a_table(raw, spark):
    ids = spark.createDataFrame([("77",), ("77",), ("5",)], "user_id string")
    frame = raw(node(), node(owner="9"), {**node(), "owner_id": {"pk": "3", "id": "5"}}, {**node(), "owner_id": 77})
    assert kept(frame, "h", ids) == [0, 2, 3]


def test_owner_ids(raw):
    frame = raw({"owner_id": {"pk": "1", "id": "1"}}, {"owner_id": "42"}, {}, {"owner_id": 7}, {"owner_id": {"pk": 1, "id": "2"}})
    owner = F.from_json("raw", "owner_id STRING")["owner_id"]
    assert values(frame, fns.owner_ids(owner)) == [["1"], ["42"], [], ["7"], ["1", "2"]]


def test_dates_are_whole_days_at_both_ends(raw):
    day = 1780272000  # 2026-06-01 00:00 UTC
    frame = raw(*[{"taken_at": t} for t in (day - 1, day, day + 86399, day + 86400)], {}, {"taken_at": None})
    assert [r.page_seq for r in ff.between_dates(frame, "2026-06-01", "2026-06-01").collect()] == [1, 2]
    shifted = ff.between_dates(frame, "2026-05-31", "2026-05-31", tz="America/New_York")
    assert [r.page_seq for r in shifted.collect()] == [0, 1]


def test_post_id_counts_values_as_conditions_do(raw):
    frame = raw(
        {"pk": "5", "id": "6"},
        {"pk": 0, "id": 8},
        {"pk": "0", "id": 8},
        {"pk": "", "id": ""},
        {"media": {"pk": "2"}},
        {"pk": None, "media": {"id": 3}},
        {"media": None},
    )
    assert values(frame, fns.post_id(F.col("raw"))) == ["5", "8", "0", "", "2", "3", None]


def test_timestamp_prefers_the_caption_key_even_when_null(raw):
    frame = raw(
        {"caption": {"created_at": 5}, "taken_at": 9},
        {"caption": {"created_at": None}, "taken_at": 9},
        {"caption": {}, "taken_at": 9},
        {"caption": None, "taken_at": "9"},
        {"taken_at": 0, "media": {"taken_at": 4}},
        {"taken_at": 0, "media": None},
        {"caption": {"created_at": "soon"}},
        {"caption": "text", "taken_at": 9},
    )
    assert values(frame, fns.post_timestamp(F.col("raw"))) == [5, None, 9, 9, 4, None, None, 9]
    assert values(frame, fns.post_timestamp(F.col("raw"), strict=False))[1] == 9


def test_resolve_media(raw):
    frame = raw({"__typename": "XDTMediaDict", "pk": 1}, {"__typename": "XDTFeedItem", "media": {"pk": 2}}, {"__typename": "XDTFeedItem", "media": None}, {"pk": 3})
    assert [r.raw.replace(" ", "") for r in ff.resolve_media(frame).collect()] == ['{"__typename":"XDTMediaDict","pk":1}', '{"pk":2}']


def test_flat_table_of_a_full_and_an_empty_post(raw):
    full = {
        "id": "1_2", "pk": 1, "code": "abc", "product_type": "clips", "media_type": 8, "taken_at": 1700000000,
        "caption": {"text": "héllo", "created_at": "1700000001"}, "image_versions2": {}, "video_dash_manifest": "<MPD/>",
        "carousel_media": [{"image_versions2": {"candidates": []}}, {"video_dash_manifest": ""}, None],
        "user": {"username": "u", "pk": "7"}, "owner": {"id": 7}, "coauthor_producers": [{"username": "a"}, {"username": ""}, {"username": "b"}],
        "usertags": {"in": [{"user": None}, {"user": {"username": "t"}}]}, "location": "nowhere",
        "clips_metadata": {"music_info": {"music_asset_info": {"title": "Song", "display_artist": "Her"}}},
    }
    row, empty = ff.flatten_posts(raw(full, {})).collect()
    assert len(row) == 44
    assert (row.url, row.media_type, row.taken_at_iso) == ("https://www.instagram.com/reel/abc/", "carousel", "2023-11-14T22:13:20+00:00")
    assert (row.caption_text, row.caption_created_at_iso) == ("héllo", "2023-11-14T22:13:21+00:00")
    assert (row.num_images, row.num_videos) == (1, 1)
    assert (row.owner_id, row.coauthor_usernames, row.tagged_usernames) == (None, "a;b", "t")
    assert (row.location_name, row.audio_label) == (None, "Song — Her")
    assert {k: v for k, v in empty.asDict().items() if v is not None} == {"num_images": 0, "num_videos": 0}


def test_iso_of_unreadable_and_far_times(spark):
    frame = spark.createDataFrame([("1700000000",), ("x",), (None,), ("999999999999999",), ("1700000000.9",)], "t string")
    assert values(frame, scalars.iso_utc(F.col("t"))) == ["2023-11-14T22:13:20+00:00", None, None, None, "2023-11-14T22:13:20+00:00"]


def test_rate_limit_phrases(spark):
    kind = "errors array<struct<message:string>>"
    frame = spark.createDataFrame([([("Please wait a few minutes before you try again.",)],), ([("some other error",)],), ([(None,)],), (None,)], kind)
    assert values(frame, is_rate_limited(F.col("errors"))) == [True, False, False, False]


@pytest.mark.parametrize(
    ("path", "stem"),
    [("/a/foo.json.gz", "foo"), ("foo.bar.jsonl", "foo.bar"), ("x/foo.ndjson", "foo"), ("foo.txt", "foo"), ("foo", "foo"), (".hidden", ".hidden")],
)
def test_input_stem(spark, path, stem):
    assert spark.range(1).select(scalars.input_stem(F.lit(path)).alias("s")).head().s == stem


def test_hot_id_meets_its_posts_without_being_gathered(spark, raw):
    """The plan joins ids; no aggregate collects them, and nothing is a cross join."""
    runs = spark.createDataFrame([("r", "UserTimeline", {"handle": "h", "start_date": "2023-01-01", "end_date": "2024-01-01"}, "success")], "run_id string, endpoint string, query map<string,string>, result string")
    users = spark.createDataFrame([("r", "H", "77", None, False, None)], "run_id string, username string, id string, pk string, is_private boolean, profile_pic_url string")
    cleaned = ff.postprocess(runs, raw(node(), node(owner="8"), node(taken_at=1)), users)
    assert [r.page_seq for r in cleaned.collect()] == [0]
    more = [("r", "h", i, None, False, None) for i in ("5", "6", "77", "90")]
    crowded = users.unionByName(spark.createDataFrame(more, users.schema))
    rest = ff.postprocess(runs, raw(node(), node(owner="8"), node(owner="6")), crowded)
    assert sorted(r.page_seq for r in rest.collect()) == [0, 2]
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
