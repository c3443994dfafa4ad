import json

import pytest
from pyspark.sql import functions as F

from tidepool.sources import segments as seg
from tidepool.sources import timeline as tl
from tidepool.streaming import ingest


def user(name):
    return {"user_results": {"result": {"rest_id": "u" + name, "core": {"screen_name": name, "name": name.title()}, "legacy": {"followers_count": 3, "verified": True}}}}


def post(i, text, **legacy):
    return {"__typename": "Tweet", "rest_id": str(i), "core": user(f"user{i}"), "views": {"count": "12"}, "legacy": {"id_str": str(i), "full_text": text, "created_at": "Wed May 21 10:00:00 +0000 2025", "favorite_count": 2, **legacy}}


def item(result):
    return {"content": {"entryType": "TimelineTimelineItem", "itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": result}}}}


def response(*entries):
    return json.dumps({"data": {"home": {"home_timeline_urt": {"instructions": [{"type": "TimelineAddEntries", "entries": list(entries)}]}}}})


@pytest.fixture(scope="module")
def rows(spark):
    photo = {"type": "photo", "media_url_https": "https://h/p/ab c.jpg", "ext_alt_text": "alt"}
    video = {"type": "video", "video_info": {"duration_millis": 9, "variants": [{"content_type": "video/mp4", "bitrate": 1, "url": "low"}, {"content_type": "x", "url": "no"}, {"content_type": "video/mp4", "bitrate": 5, "url": "high"}]}}
    quoted = post(2, "quoted")
    plain = post(1, "short", extended_entities={"media": [photo, video]}, entities={"hashtags": [{"text": "tag"}], "urls": [{"url": "s", "expanded_url": "e", "display_url": "d"}], "user_mentions": [{"id_str": "9", "screen_name": "m"}]})
    plain |= {"note_tweet": {"note_tweet_results": {"result": {"text": "the long text"}}}, "quoted_status_result": {"result": quoted}}
    repost = post(3, "RT cut", retweeted_status_result={"result": post(4, "original text") | {"quoted_status_result": {"result": quoted}}})
    article = post(5, "link") | {"article": {"article_results": {"result": {"title": "T", "content_state": {
        "blocks": [{"type": "header-one", "text": "Head"}, {"type": "unstyled", "text": "body"}, {"type": "blockquote", "text": "q"}, {"type": "atomic", "entityRanges": [{"key": 0}]}, {"type": "ordered-list-item", "text": "i"}],
        "entityMap": [{"key": "0", "value": {"data": {"mediaItems": [{"mediaId": "m1"}]}}}]}, "media_entities": [{"media_id": "m1", "media_info": {"original_img_url": "https://h/x/pic.png"}}]}}}}
    stub = post(6, "stub") | {"article": {"article_results": {"result": {"title": "T"}}}}
    module = {"content": {"entryType": "TimelineTimelineModule", "items": [{"item": {"itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": {"__typename": "TweetWithVisibilityResults", "tweet": post(7, "hidden")}}}}}, {"item": {"itemContent": {"itemType": "TimelineUser"}}}]}}
    body = response(item(plain), item(repost), item(article), item(stub), module, {"content": {"entryType": "TimelineTimelineCursor", "cursorType": "Bottom"}}, item({"__typename": "TweetTombstone"}))
    frame = spark.createDataFrame([("HomeTimeline", body), ("Other", '{"data": {"instructions": []}}'), ("HomeTimeline", "no json")], "endpoint string, body string")
    return tl.posts(frame).cache()


def test_posts(rows):
    got = {r["id"]: r for r in rows.collect()}
    assert sorted(got) == ["1", "2", "3", "5", "7"] and rows.count() == 6  # 2 is quoted by two posts
    one = got["1"]
    assert one["text"] == "the long text" and one["created_at"] == "2025-05-21T10:00:00.000Z"
    assert one["author"].asDict() == {"id": "uuser1", "username": "user1", "display_name": "User1", "verified": True, "follower_count": 3}
    assert [m.asDict() for m in one["media"]] == [
        {"type": "photo", "url": "https://h/p/ab c.jpg:orig", "alt_text": "alt", "duration_ms": None}, {"type": "video", "url": "high", "alt_text": None, "duration_ms": 9},
    ]
    assert one["hashtags"] == ["tag"] and one["urls"][0]["expanded"] == "e" and one["mentions"][0]["username"] == "m"
    assert one["metrics"]["likes"] == 2 and one["metrics"]["views"] == 12 and one["metrics"]["quotes"] == 0
    assert got["3"]["text"] == "original text" and got["3"]["is_retweet"]
    assert got["5"]["text"] == "# Head\nbody\n> q\n![pic.png](media/5/pic.png)\n1. i" and got["5"]["is_article"]


def test_image_jobs(rows):
    assert [tuple(r) for r in tl.image_jobs(rows).collect()] == [("1", "https://h/p/ab c.jpg:orig", "media/1/abc.jpg")]


def test_dates(spark):
    frame = spark.createDataFrame([("Wed May 21 10:00:00 +0000 2025",), ("soon",), (None,)], "d string")
    assert [r[0] for r in frame.select(tl.iso_date(F.col("d"))).collect()] == ["2025-05-21T10:00:00.000Z", "soon", None]


def test_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    lines = spark.createDataFrame([("posts/a", "1"), ("posts/a", "2"), ("attempts/x", "3")], "path string, line string")
    seg.append(lines, log, "2024-01-01T00:00:00Z", "t1")
    first = seg.snapshot(seg.segments(spark, log))
    first = spark.createDataFrame(first.collect(), first.schema)
    before = first.count(), seg.revision(first)
    seg.append(lines.limit(1), log, "2024-01-02T00:00:00Z", "t2")
    second = seg.snapshot(seg.segments(spark, log))
    assert before[0] >= 2 and before[1] != seg.revision(second)
    assert [r["change"] for r in seg.changes(first, second).collect()] == ["added"]
    got = sorted((r["transaction_id"], r["kind"], r["line"]) for r in seg.records(seg.segments(spark, log)).collect())
    assert got[:3] == [("t1", "attempt", "3"), ("t1", "post", "1"), ("t1", "post", "2")] and len(got) == 4


def test_config_is_of_the_last_writer(spark):
    rows = [(1, t, c, [("config/x", "write", None, content)], f) for t, c, content, f in (("b", "2024-01-02", "new", "f1"), ("a", "2024-01-02", "older", "f0"), ("z", "2024-01-01", "old", "f2"))]
    frame = spark.createDataFrame(rows, seg.SEGMENT + ", file string")
    assert seg.config(frame, "config/x").first()[0] == "new"


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert seg.restore(spark, root) == {}
    made = None
    for i in range(6):
        made = seg.publish({"t": spark.range(i + 1)}, root, str(i), made["generation"] if made else None)
    assert seg.restore(spark, root)["t"].count() == 6
    with pytest.raises(seg.Stale):
        seg.publish({"t": spark.range(1)}, root, "x", None)
    assert seg.prune(spark, root) == []  # all are younger than a day
    assert len(seg.prune(spark, root, age_ms=-60_000)) == 2 and seg.restore(spark, root)["t"].count() == 6


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, contributed_by string, captured_at string, replay_pos long"
    rows = [(str(i % 5), f"c{i % 2}", str(i * 7 % 11), i) for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        q = ingest.start(spark, f"{tmp_path}/in", schema, f"file://{tmp_path}/out", f"{tmp_path}/check", files=1)
        q.awaitTermination(120)
    got = sorted(tuple(r) for r in ingest.captures(spark, f"file://{tmp_path}/out").select("id", "contributed_by", "captured_at").collect())
    want = sorted((i, c, max(r[2] for r in rows if r[:2] == (i, c))) for i, c in {r[:2] for r in rows})
    assert got == want


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "id string, contributed_by string, captured_at string, replay_pos long"
    fold = ingest.fold_batches(root, buckets=16)
    assert ingest.captures(spark, root) is None
    fold(spark.createDataFrame([(str(i), "c", "2024", i) for i in range(200)], schema), 0)
    before = seg.manifest(spark, root)["folders"]
    fold(spark.createDataFrame([("7", "c", "2025", 300), ("new", "c", "2025", 301)], schema), 1)
    fold(spark.createDataFrame([("8", "c", "2026", 400)], schema), 1)  # a batch that runs again changes nothing
    after = seg.manifest(spark, root)["folders"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    got = {r["id"]: r["captured_at"] for r in ingest.captures(spark, root).collect()}
    assert len(got) == 201 and got["7"] == "2025" and got["8"] == "2024" and got["new"] == "2025"


def test_append_is_idempotent_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seg, "LINES", 10)
    log = f"file://{tmp_path}/log"
    lines = spark.createDataFrame([("posts/hot", f"{i:04d}") for i in range(500)] + [("attempts/x", "a")], "path string, line string")
    for _ in range(2):
        seg.append(lines, log, "2024-01-01T00:00:00Z", "t1")
    found = seg.segments(spark, log)
    assert found.selectExpr("max(size(operations[0].lines))").first()[0] <= 10
    assert sorted(r["line"] for r in seg.records(found).where("kind = 'post'").collect()) == [f"{i:04d}" for i in range(500)]
    with pytest.raises(seg.Conflict):
        seg.append(lines.limit(3), log, "2024-01-01T00:00:00Z", "t1")
    counts = {r["kind"]: (r["lines"], r["latest"]) for r in seg.stats(found).collect()}
    assert counts == {"post": (500, "2024-01-01T00:00:00Z"), "attempt": (1, "2024-01-01T00:00:00Z")}
    assert {r["category"] for r in seg.category(found).collect()} == {"post", "attempt"}
    seen = found.where("category = 'post'")
    assert seg.unseen(found.union(found), seen).count() == found.where("category = 'attempt'").count()


def test_latest_receipt(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    rows = [("receipts/a", json.dumps({"finished_at": t, "n": n})) for n, t in enumerate(("2024-03-01", "2024-05-01", "2024-04-01"))]
    seg.append(spark.createDataFrame(rows + [("posts/x", json.dumps({"finished_at": "2025"}))], "path string, line string"), log, "2024-01-01T00:00:00Z")
    assert json.loads(seg.latest_receipt(seg.segments(spark, log)).first()["line"])["n"] == 1


def test_times_never_go_back():
    assert seg.next_time("2024-01-01T00:00:00.000Z", None) == "2024-01-01T00:00:00.000Z"
    assert seg.next_time("2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.999Z") == "2024-01-02T00:00:01.000Z"
    assert seg.next_time("2024-01-03T00:00:00.000Z", "2024-01-02T00:00:00.999Z") == "2024-01-03T00:00:00.000Z"


def test_instructions_of_unknown_endpoints_are_found(spark):
    add = {"type": "TimelineAddEntries", "entries": [{"content": {"entryType": "TimelineTimelineItem"}}]}
    deep = lambda n: {"instructions": [add]} if not n else {"k": deep(n - 1)}
    bodies = [(f"e{n}", json.dumps(deep(n))) for n in range(7)] + [("list", json.dumps([{"a": 1}, deep(1)])), ("none", json.dumps({"instructions": [{"type": "TimelineClearCache"}]}))]
    got = {r["endpoint"] for r in tl.entries(spark.createDataFrame(bodies, "endpoint string, body string")).collect()}
    assert got == {"e0", "e1", "e2", "e3", "e4", "list"}
