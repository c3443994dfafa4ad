"""Posts out of timeline responses: semi-structured extraction with VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_USER = "$.data.user.result.timeline.timeline.instructions"
_HOME = "$.data.home.home_timeline_urt.instructions"
#: Where each endpoint keeps its instructions.
INSTRUCTION_PATHS = {
    "HomeTimeline": _HOME, "HomeLatestTimeline": _HOME, "UserTweets": _USER, "UserTweetsAndReplies": _USER,
    "UserMedia": _USER, "UserLikes": _USER, "UserArticlesTweets": _USER, "UserHighlightsTweets": _USER,
    "TweetDetail": "$.data.threaded_conversation_with_injections_v2.instructions",
    "SearchTimeline": "$.data.search_by_raw_query.search_timeline.timeline.instructions",
    "ListLatestTweetsTimeline": "$.data.list.tweets_timeline.timeline.instructions",
    "Bookmarks": "$.data.bookmark_timeline_v2.timeline.instructions",
    "Likes": _USER,
    "CommunityTweetsTimeline": "$.data.communityResults.result.ranked_community_timeline.timeline.instructions",
    "BookmarkFolderTimeline": "$.data.bookmark_collection_timeline.timeline.instructions",
}


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _list(v: Column | str, path: str) -> Column:
    return F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))


#: Objects within each other that a search for instructions looks into.
DEPTH = 5


def found_instructions(v: Column) -> Column:
    """The first list of instructions with entries in the objects and lists of a value, DEPTH levels
    deep: the shallowest, then by key. Levels are made by the built-in functions, without recursion."""
    none = F.array().cast("array<variant>")
    fits = lambda i: (get(i, "$.type").isin("TimelineAddEntries", "TimelineAddToModule")) | get(i, "$.entries", "variant").isNotNull()
    own = lambda x: F.coalesce(get(x, "$.instructions", "array<variant>"), none)
    held = lambda x: F.coalesce(F.map_values(F.map_filter(get(x, "$", "map<string,variant>"), lambda k, _: k != "instructions")), get(x, "$", "array<variant>"), none)
    level, out = F.array(v), []
    for _ in range(DEPTH):
        good = F.filter(F.transform(level, own), lambda i: F.exists(i, lambda x: F.coalesce(fits(x), F.lit(False))))
        out.append(F.try_element_at(good, F.lit(1)))
        level = F.flatten(F.transform(level, held))
    return F.coalesce(*out)


def entries(responses: DataFrame) -> DataFrame:
    """endpoint, entry: of responses (endpoint, body). Bodies that are no JSON have none. Where an
    endpoint is not known, or keeps its instructions elsewhere, they are searched for."""
    parsed = responses.withColumn("v", F.try_parse_json("body"))
    instructions = F.lit(None).cast("array<variant>")
    for endpoint, path in INSTRUCTION_PATHS.items():
        instructions = F.when(F.col("endpoint") == endpoint, get("v", path, "array<variant>")).otherwise(instructions)
    each = parsed.select("endpoint", F.explode(F.coalesce(instructions, found_instructions(F.col("v")))).alias("i"))
    one = F.when(get("i", "$.entry", "variant").isNotNull(), F.array(get("i", "$.entry", "variant")))
    every = F.concat(_list("i", "$.entries"), F.coalesce(one, F.array().cast("array<variant>")), _list("i", "$.moduleItems"))
    return each.select("endpoint", F.explode(every).alias("entry"))


def items(rows: DataFrame) -> DataFrame:
    """endpoint, result: the post results of entries; cursors and other items are skipped."""
    c = rows.withColumn("c", F.coalesce(get("entry", "$.content", "variant"), F.col("entry")))
    kind = F.coalesce(get("c", "$.entryType"), get("c", "$.__typename"))
    cursor = (kind == "TimelineTimelineCursor") | get("c", "$.cursorType").isNotNull()
    modules = F.transform(_list("c", "$.items"), lambda x: F.coalesce(get(x, "$.item.itemContent", "variant"), get(x, "$.itemContent", "variant")))
    single = F.array(F.coalesce(get("c", "$.itemContent", "variant"), get("c", "$.item.itemContent", "variant")))
    contents = F.when(kind == "TimelineTimelineModule", modules).otherwise(single)
    each = c.where(~F.coalesce(cursor, F.lit(False))).select("endpoint", F.explode(contents).alias("item")).where("item is not null")
    posts = each.where(F.coalesce(get("item", "$.itemType"), get("item", "$.__typename")) == "TimelineTweet")
    return posts.select("endpoint", get("item", "$.tweet_results.result", "variant").alias("result")).where("result is not null")


def unwrap(v: Column) -> Column:
    """The post within a visibility wrapper; null for a tombstone."""
    kind = get(v, "$.__typename")
    inner = F.when(kind == "TweetWithVisibilityResults", get(v, "$.tweet", "variant")).when(kind == "TweetTombstone", None).otherwise(v)
    return F.when(get(inner, "$.legacy", "variant").isNotNull(), inner)


def _with_quoted(rows: DataFrame) -> DataFrame:
    """Posts, and those that they or what they repost quote, once each."""
    raw = rows.withColumn("raw", unwrap(F.col("result"))).where("raw is not null")
    reposted = unwrap(get("raw", "$.legacy.retweeted_status_result.result", "variant"))
    more = raw.withColumn("q1", unwrap(get("raw", "$.quoted_status_result.result", "variant"))).withColumn(
        "q2", unwrap(get(reposted, "$.quoted_status_result.result", "variant"))
    )
    q = lambda c: get(c, "$.legacy.id_str")
    second = F.when(~(F.coalesce(q("q1"), F.lit("")) == F.coalesce(q("q2"), F.lit(""))), F.col("q2"))
    return more.select("endpoint", F.explode(F.array("raw", "q1", second)).alias("raw")).where("raw is not null")


def media(legacy: Column) -> Column:
    """type, url, alt_text, duration_ms: photos in full size, the mp4 of the highest bitrate."""
    found = F.coalesce(get(legacy, "$.extended_entities.media", "array<variant>"), _list(legacy, "$.entities.media"))

    def one(m: Column) -> Column:
        kind = get(m, "$.type")
        mp4 = F.filter(_list(m, "$.video_info.variants"), lambda v: get(v, "$.content_type") == "video/mp4")
        ranked = F.transform(mp4, lambda v: F.struct((-F.coalesce(get(v, "$.bitrate", "long"), F.lit(0))).alias("b"), get(v, "$.url").alias("u")))
        url = F.when(kind == "photo", F.concat(get(m, "$.media_url_https"), F.lit(":orig"))).when(
            kind.isin("video", "animated_gif"), F.get(F.array_sort(ranked), F.lit(0))["u"]
        )
        length = F.when(kind == "video", get(m, "$.video_info.duration_millis", "long"))
        return F.struct(kind.alias("type"), url.alias("url"), get(m, "$.ext_alt_text").alias("alt_text"), length.alias("duration_ms"))

    return F.transform(found, one)


# What stands before the text of a block of each type.
BLOCK_PREFIX = {
    "header-one": "# ", "header-two": "## ", "header-three": "### ", "ordered-list-item": "1. ",
    "unordered-list-item": "- ", "blockquote": "> ",
}


def article_text(raw: Column) -> Column:
    """A long-form post as text, a line for each block; image blocks name their file."""
    result = get(raw, "$.article.article_results.result", "variant")
    post = F.coalesce(get(raw, "$.legacy.id_str"), get(raw, "$.rest_id"))
    pairs = lambda items, k, v: F.map_from_entries(F.transform(items, lambda x: F.struct(k(x), v(x))))
    held = F.filter(_list(result, "$.content_state.entityMap"), lambda e: get(e, "$.value.data.mediaItems[0].mediaId").isNotNull())
    of_entity = pairs(held, lambda e: get(e, "$.key"), lambda e: get(e, "$.value.data.mediaItems[0].mediaId"))
    with_url = F.filter(_list(result, "$.media_entities"), lambda e: get(e, "$.media_id").isNotNull())
    file_of = pairs(with_url, lambda e: get(e, "$.media_id"), lambda e: F.coalesce(F.element_at(F.split(get(e, "$.media_info.original_img_url"), "/"), -1), F.lit("null")))

    def line(b: Column) -> Column:
        kind, text = get(b, "$.type"), F.coalesce(get(b, "$.text"), F.lit(""))
        name = F.try_element_at(file_of, F.try_element_at(of_entity, get(b, "$.entityRanges[0].key")))
        out = F.when(kind == "atomic", F.concat(F.lit("!["), name, F.lit("](media/"), post, F.lit("/"), name, F.lit(")")))
        for k, prefix in BLOCK_PREFIX.items():
            out = out.when(kind == k, F.concat(F.lit(prefix), text))
        return out.otherwise(text)

    lines = F.filter(F.transform(_list(result, "$.content_state.blocks"), line), lambda x: x.isNotNull())
    return F.when(F.size(_list(result, "$.content_state.blocks")) > 0, F.array_join(lines, "\n"))


def iso_date(c: Column) -> Column:
    """A legacy date (weekday first) as ISO text; what can't be parsed stays."""
    ts = F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), c)


def posts(responses: DataFrame) -> DataFrame:
    """One row for each post of timeline responses, quoted ones included. Long-form posts
    without their content are left out."""
    raw = _with_quoted(items(entries(responses)))
    legacy, user = get("raw", "$.legacy", "variant"), get("raw", "$.core.user_results.result", "variant")
    has_article = get("raw", "$.article.article_results.result", "variant").isNotNull()
    article = article_text(F.col("raw"))
    note = lambda v: F.coalesce(F.nullif(get(v, "$.note_tweet.note_tweet_results.result.text"), F.lit("")), get(v, "$.legacy.full_text"), F.lit(""))
    reposted = unwrap(get(legacy, "$.retweeted_status_result.result", "variant"))
    number = lambda p: F.coalesce(get(legacy, p, "long"), F.lit(0))
    name = F.coalesce(get(user, "$.core.screen_name"), get(user, "$.legacy.screen_name"))
    return raw.where(~has_article | article.isNotNull()).select(
        F.coalesce(get(legacy, "$.id_str"), get("raw", "$.rest_id")).alias("id"), iso_date(get(legacy, "$.created_at")).alias("created_at"),
        F.struct(
            F.coalesce(get(user, "$.rest_id"), get(legacy, "$.user_id_str")).alias("id"), name.alias("username"),
            F.coalesce(get(user, "$.core.name"), get(user, "$.legacy.name")).alias("display_name"),
            F.coalesce(get(user, "$.legacy.verified", "boolean"), F.lit(False)).alias("verified"),
            get(user, "$.legacy.followers_count", "long").alias("follower_count"),
        ).alias("author"),
        F.coalesce(article, F.when(reposted.isNotNull(), note(reposted)).otherwise(note("raw"))).alias("text"), get(legacy, "$.lang").alias("lang"),
        F.struct(
            number("$.favorite_count").alias("likes"), number("$.retweet_count").alias("retweets"), number("$.reply_count").alias("replies"),
            F.nullif(get("raw", "$.views.count", "long"), F.lit(0)).alias("views"), number("$.bookmark_count").alias("bookmarks"), number("$.quote_count").alias("quotes"),
        ).alias("metrics"),
        media(legacy).alias("media"),
        F.transform(_list(legacy, "$.entities.urls"), lambda u: F.struct(get(u, "$.display_url").alias("display"), get(u, "$.expanded_url").alias("expanded"), get(u, "$.url").alias("shortened"))).alias("urls"),
        F.transform(_list(legacy, "$.entities.hashtags"), lambda h: get(h, "$.text")).alias("hashtags"),
        F.transform(_list(legacy, "$.entities.user_mentions"), lambda m: F.struct(get(m, "$.id_str").alias("id"), get(m, "$.screen_name").alias("username"))).alias("mentions"),
        get(legacy, "$.in_reply_to_status_id_str").alias("in_reply_to"), get(legacy, "$.quoted_status_id_str").alias("quoted_id"),
        get(legacy, "$.conversation_id_str").alias("conversation_id"), get(legacy, "$.retweeted_status_result", "variant").isNotNull().alias("is_retweet"),
        get("raw", "$.exclusivityInfo", "variant").isNotNull().alias("is_subscriber_only"), article.isNotNull().alias("is_article"), F.col("endpoint").alias("source_endpoint"),
    )


def image_jobs(rows: DataFrame) -> DataFrame:
    """post_id, url, file: photos to download, with names that are safe as paths."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._-]", "")
    each = rows.where(F.col("id").rlike(r"^[0-9]+$")).select("id", F.posexplode("media").alias("n", "m")).where("m.type = 'photo' and m.url is not null")
    base = F.regexp_replace(F.element_at(F.split("m.url", "/"), -1), ":orig$", "")
    return each.select(F.col("id").alias("post_id"), F.col("m.url").alias("url"), F.concat(F.lit("media/"), "id", F.lit("/"), safe(base)).alias("file")).where(
        ~F.col("file").rlike(r"/\.*$")
    )
