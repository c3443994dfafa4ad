"""Days, paths, ids and URLs as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of facts, and the folder, the name and the layout of their daily files.
FACT_PATHS = {
    "enrichment": "enrichment/{y}/{m}/enrichment-{d}.jsonl",
    "attempt": "enrichment/attempts/{y}/{m}/attempts-{d}.jsonl",
    "registry": "enrichment/registry/{y}/{m}/registry-{d}.jsonl",
    "receipt": "enrichment/receipts/{d}.jsonl",
}
# Endpoints whose responses hold no posts.
IGNORED_ENDPOINTS = [
    "DataSaverMode", "getAltTextPromptPreference", "useDirectCallSetupQuery",
    "XChatDmSettingsQuery", "useTotalAdCampaignsForUserQuery", "useStoryTopicQuery",
    "useSubscriptionsPaymentFailureQuery", "PinnedTimelines", "ExploreSidebar",
    "SidebarUserRecommendations", "useFetchProductSubscriptionsQuery",
    "ExplorePage", "UserByScreenName",
    "ProfileSpotlightsQuery", "useFetchProfileSections_canViewExpandedProfileQuery",
    "UserSuperFollowTweets", "NotificationsTimeline", "AuthenticatePeriscope",
    "BookmarkFoldersSlice", "EditBookmarkFolder", "fetchPostQuery",
    "useReadableMessagesSnapshotMutation", "UsersByRestIds",
    "CreatorStudioTabBarItemQuery", "DelegatedAccountListQuery",
    "HandleShareBannerQuery", "isEligibleForVoButtonUpsellQuery",
    "useEligibleForHandleShareBannerQuery", "useRelayDelegateDataPendingQuery",
]
# Hosts, the list endpoints, and where the public hub keeps its names.
HOST = r"^https?://(?:[^/?#@]*\.)?(?:x\.com|twitter\.com)(?::\d+)?(?:[/?#]|$)"
STATUS = r"^https://(?:x\.com|twitter\.com)(?::\d+)?/(?:[^/?#]+/)*status/(\d+)(?:[/?#]|$)"
LIST_ID = r"^\d{4,25}$"
LIST_QUERY = r"(?:^|\s)list:(\d{4,25})(?:\s|$)"
HUB = r"(?i)(?:https?://)?huggingface\.co/(?:models/|datasets/)?([\w.-]+/[\w.-]+)"


def _utc(at: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def day_key(at: Column) -> Column:
    """The day in UTC of an ISO timestamp; null if it is none."""
    return F.date_format(_utc(F.try_to_timestamp(at)), "yyyy-MM-dd")


def post_path(contributor: Column, captured_at: Column) -> Column:
    """The daily file of a contributor's posts."""
    d = day_key(captured_at)
    return F.concat(F.lit("data/"), contributor, F.lit("/"), d.substr(1, 4), F.lit("/"), d.substr(6, 2), F.lit("/tweets-"), d, F.lit(".jsonl"))


def fact_path(kind: str, at: Column) -> Column:
    """The daily file of a kind of facts (of FACT_PATHS)."""
    d = day_key(at)
    out = F.replace(F.lit(FACT_PATHS[kind]), F.lit("{d}"), d)
    return F.replace(F.replace(out, F.lit("{y}"), d.substr(1, 4)), F.lit("{m}"), d.substr(6, 2))


def deterministic_uuid(digest: Column) -> Column:
    """A UUID (version 4 by its marks) of the first half of a SHA-256 in hexadecimal digits; null
    if it is not one."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    out = F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)
    )
    return F.when(digest.rlike("^[0-9a-f]{64}$"), out)


def deterministic_time(order: Column) -> Column:
    """The timestamp of the n-th source of an import: n milliseconds after the epoch, so that all
    of them sort before what is written later."""
    return F.date_format(_utc(F.timestamp_millis(order)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_prefix(at: Column) -> Column:
    """yyyy.mm.dd_ of an ISO date; empty if it is none."""
    day = F.regexp_extract(at, r"^(\d{4}-\d{2}-\d{2})(?:T|$)", 1)
    good = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    return F.coalesce(F.when(good, F.concat(F.replace(day, F.lit("-"), F.lit(".")), F.lit("_"))), F.lit(""))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    out = F.regexp_extract(c, pattern, group)
    return F.when(out != "", out)


def status_id(url: Column) -> Column:
    """The post id of a status URL; null if it is none."""
    return _found(url, STATUS)


def endpoint(url: Column) -> Column:
    """The endpoint of a request to the site's GraphQL API; null if it is none."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.when(url.rlike(HOST) & F.contains(path, F.lit("/i/api/graphql/")), _found(path, r"/graphql/[^/]*/([^/]+)"))


def ignored(endpoint_: Column) -> Column:
    return endpoint_.isin(IGNORED_ENDPOINTS)


def list_id(endpoint_: Column, url: Column) -> Column:
    """The list that a timeline request is for: of its variables, or the search for one."""
    variables = F.try_parse_json(F.try_url_decode(F.regexp_extract(url, r"[?&]variables=([^&#]*)", 1)))
    text = lambda k: F.try_variant_get(variables, f"$.{k}", "string")
    own = F.when(text("listId").rlike(LIST_ID), text("listId"))
    return F.when(endpoint_ == "ListLatestTweetsTimeline", own).when(endpoint_ == "SearchTimeline", _found(text("rawQuery"), LIST_QUERY))


def display_name(name: Column, username: Column) -> Column:
    return F.coalesce(F.when(name != "", name), username)


def quoted_url(quoted_id: Column) -> Column:
    return F.when(quoted_id != "", F.concat(F.lit("https://x.com/i/status/"), quoted_id))


def hub_reference(quote: Column) -> Column:
    """The first name of a public model or data set in a quote."""
    return _found(quote, HUB)


def hub_name(reference: Column) -> Column:
    """The label that a reference stands for."""
    return F.regexp_replace(F.regexp_replace(F.lower(reference), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def hub_names(rows, name: str = "name", quote: str = "quote"):
    """name, reference: names whose first reference, in order of post and quote, stands for them.
    Whether the reference exists is asked outside."""
    found = rows.withColumn("reference", hub_reference(F.col(quote))).where("reference is not null")
    first = found.groupBy(name).agg(F.min_by("reference", F.struct("unit_id", "post_id", quote)).alias("reference"))
    return first.where(hub_name(F.col("reference")) == F.col(name))


# The form of a segment's key, and of a transaction's id within it.
SEGMENT_KEY = (
    r"^v1/segments/(tweet|enrichment|attempt|registry|receipt|config|mixed)/([0-9]{4}/[0-9]{2}/[0-9]{2})/"
    r"([0-9]{13})-([0-9a-f-]{36})-([a-f0-9]{64})\.json\.gz$"
)
TRANSACTION_ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def segment_key(key: Column) -> Column:
    """category, day, created_ms, transaction_id and digest that a key says, as a struct; null where it has
    another form."""
    part = lambda i: F.regexp_extract(key, SEGMENT_KEY, i)
    said = F.struct(
        part(1).alias("category"), part(2).alias("day"), part(3).cast("long").alias("created_ms"), part(4).alias("transaction_id"), part(5).alias("digest")
    )
    return F.when(key.rlike(SEGMENT_KEY), said)


def segment_key_fault(said: Column, body_digest: Column) -> Column:
    """What contradicts itself in a parsed key, the first of: form, transaction (no UUID), date (not the UTC
    day of its time), digest (not that of the segment's body)."""
    day = F.date_format(F.timestamp_millis(said["created_ms"]), "yyyy/MM/dd")
    return (
        F.when(said.isNull(), "form").when(~said["transaction_id"].rlike(TRANSACTION_ID), "transaction").when(day != said["day"], "date")
        .when(body_digest != said["digest"], "digest")
    )
