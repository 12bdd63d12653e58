from pyspark.sql import functions as F

import feedframe as ff
from feedframe.functions.manifests import audio_track, best_video, distinct_base_urls, parse_manifest, representations

REP = '<Representation {}><BaseURL>{}</BaseURL></Representation>'


def mpd(*sets):
    return '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period>' + "".join(sets) + "</Period></MPD>"


def adaptation(mime, *reps):
    return f'<AdaptationSet mimeType="{mime}">' + "".join(reps) + "</AdaptationSet>"


VIDEOS = adaptation("video/mp4", REP.format('bandwidth="5"', "a"), REP.format('bandwidth="50"', "b&amp;c"), REP.format('bandwidth="x"', "z"))
AUDIO = adaptation("other", REP.format('mimeType="audio/mp4"', "s1"), REP.format('mimeType="audio/mp4"', "s2"))


def test_manifest(spark):
    frame = spark.createDataFrame(
        [(mpd(VIDEOS, AUDIO),), (mpd(AUDIO),), ("<MPD><Period>",), (None,), (mpd(adaptation("video/mp4", REP.format('bandwidth="9"', "k"), REP.format('bandwidth="9"', "l"), '<Representation bandwidth="99"/>')),)],
        "xml string",
    ).withColumn("m", parse_manifest(F.col("xml"))).withColumn("r", representations(F.col("m")))
    got = frame.select(best_video(F.col("r")).alias("v"), audio_track(F.col("r")).alias("a"), distinct_base_urls(F.col("m")).alias("u")).collect()
    assert [(r.v, r.a) for r in got] == [("b&c", "s2"), (None, "s2"), (None, None), (None, None), ("l", None)]
    assert got[0].u == ["a", "b&c", "s1", "s2", "z"] and (got[2].u or []) == []


def test_urls_of_every_level_once_and_sorted(spark, capsys):
    url = "<BaseURL>{}</BaseURL>".format
    whole = f"<MPD>{url('m')}<Period>{url('p')}<AdaptationSet>{url('s')}{url('')}<Representation>{url('z')}{url('m')}</Representation></AdaptationSet></Period>{url('k')}<Period/><Period>{url('é')}{url('Z')}<AdaptationSet/></Period></MPD>"
    frame = spark.createDataFrame([(0, whole), (1, "<MPD/>"), (2, None), (3, "<MPD><Period>")], "n int, xml string")
    found = frame.withColumn("m", parse_manifest(F.col("xml"))).select("n", distinct_base_urls(F.col("m")).alias("urls"))
    assert {r.n: r.urls for r in found.collect()} == {0: ["Z", "k", "m", "p", "s", "z", "é"], 1: [], 2: [], 3: []}
    found.explain()
    assert capsys.readouterr().out.count("AdaptationSet, [") <= 1  # each level is walked once


def test_pairs_number_manifests_and_skip_those_without_video(raw):
    post = {"id": "7", "video_dash_manifest": mpd(VIDEOS, AUDIO), "carousel_media": [{"video_dash_manifest": ""}, {"video_dash_manifest": mpd(AUDIO)}, {"video_dash_manifest": mpd(VIDEOS)}]}
    got = ff.video_audio_pairs(raw(post)).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("7", 0, "b&c", "s2"), ("7", 2, "b&c", None)]
    plan = {r.idx: r for r in ff.video_plan(raw(post), merge=True).collect()}
    assert plan[0].saved == ["7.mp4"] and plan[2].saved == ["7_2_video.mp4"]
    kept = {r.idx: r.saved for r in ff.video_plan(raw(post), merge=True, keep_streams=True).collect()}
    assert kept[0] == ["7.mp4", "7_video.mp4", "7_audio.mp4"]


def image(*urls):
    return {"candidates": [{"url": u} for u in urls]}


def test_images(raw):
    post = {"id": "7", "image_versions2": image("https://x/a.jpg?k=1", "small"), "carousel_media": [{"image_versions2": image()}, {"image_versions2": {}}, {"image_versions2": None}, None, {"image_versions2": image("https://x/b.webp.heic")}]}
    frame = raw(post, {"id": "8", "image_versions2": {"other": 1}})
    assert [(r.post_id, r.image_url) for r in ff.image_urls(frame).orderBy("pos").collect()] == [("7", "https://x/a.jpg?k=1"), ("7", "https://x/b.webp.heic")]
    assert sorted(r.name for r in ff.image_plan(frame).collect()) == ["7_a.png", "7_b.webp.png"]


def test_pictures_first_of_each_handle(raw, spark):
    post = {
        "user": {"username": "me", "hd_profile_pic_url_info": {"url": "hd"}},
        "facepile_top_likers": [{"id": "9", "profile_pic_url": "p9"}, {"username": "me", "profile_pic_url": "again"}, {"username": "nopic"}],
        "owner": {"username": "me", "profile_pic_url": "o"},
    }
    frame = raw(post, {"owner": {"username": "9", "profile_pic_url": "late"}})
    assert [(r.handle, r.profile_pic_url) for r in ff.post_profile_pics(frame, keep=("page_seq",)).orderBy("page_seq", "pos").collect()] == [("me", "hd"), ("9", "p9"), ("9", "late")]
    users = spark.createDataFrame([("me", "u0", 0), ("new", "u1", 1), ("new", "u2", 2), ("blank", "", 3)], "username string, profile_pic_url string, n bigint")
    pics = ff.assets(frame, users, ("page_seq",), ("n",)).profile_pics
    assert sorted(tuple(r) for r in pics.collect()) == [("9", "p9"), ("me", "hd"), ("new", "u1")]


def test_links_of_odd_anchors(spark):
    from feedframe.operators.assets import hrefs

    pages = {
        '<a data-href="/p/NO/" href="/about">': ["/about"],
        '<A HREF="/p/UP/">': ["/p/UP/"],
        "<a href=/p/bare>x</a><a\nclass='x' href = '/p/q\"uote/'>": ["/p/bare", '/p/q"uote/'],
        '<a title="1 > 0" href="/p/x/?a=1&amp;b=&quot;2&quot;">': ['/p/x/?a=1&b="2"'],
        '<!-- <a href="/p/1/"> --><script>"<a href=/p/2/>"</script><abbr href="/p/3/"><a><a href="/p/4/" href="/p/5/">': ["/p/4/"],
        '<a href="/p/' + "x" * 100_000 + '/"' + ' data-x="y"' * 3000 + ">": ["/p/" + "x" * 100_000 + "/"],
        "<a href='": [],
    }
    frame = spark.createDataFrame([(h,) for h in pages], "html string")
    assert {r.html: r.links for r in frame.select("html", hrefs(F.col("html")).alias("links")).collect()} == pages
