"""Queries of ingest, of paths and ids, and of the facts that labelling runs leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import paths
from tidepool.functions import text as tx
from tidepool.operators import ingest as ing
from tidepool.operators import labels as lab
from tidepool.operators import queue as que
from tidepool.operators import results as res
from tidepool.operators import units as uni
from tidepool.plans import adapter as ad

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None, views: bool = False, more: str = ""):
    def take(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = ad.sql(oracle, more) if views else oracle
        return f

    return take


# ---- paths, ids, URLs ---------------------------------------------------------------------------


@query("post_paths", "SELECT event_id, 'data/u' || user_id || '/' || strftime(ts, '%Y/%m') || '/tweets-' || strftime(ts, '%Y-%m-%d') || '.jsonl' AS path FROM events")
def post_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "events")
    return rows.select("event_id", paths.post_path(F.concat(F.lit("u"), F.col("user_id").cast("string")), ad._iso("ts")).alias("path"))


@query(
    "fact_paths",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'enrichment/' || strftime(ts, '%Y/%m') || '/enrichment-' || strftime(ts, '%Y-%m-%d') || '.jsonl'
      WHEN 1 THEN 'enrichment/attempts/' || strftime(ts, '%Y/%m') || '/attempts-' || strftime(ts, '%Y-%m-%d') || '.jsonl'
      WHEN 2 THEN 'enrichment/registry/' || strftime(ts, '%Y/%m') || '/registry-' || strftime(ts, '%Y-%m-%d') || '.jsonl'
      ELSE 'enrichment/receipts/' || strftime(ts, '%Y-%m-%d') || '.jsonl' END AS path FROM events""",
)
def fact_paths(spark: SparkSession, d: str) -> DataFrame:
    at, out = ad._iso("ts"), F.lit(None).cast("string")
    for i, kind in enumerate(paths.FACT_PATHS):
        out = F.when(F.col("event_id") % 4 == i, paths.fact_path(kind, at)).otherwise(out)
    return ad.table(spark, d, "events").select("event_id", out.alias("path"))


@query(
    "deterministic_ids",
    """SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', 1 + cast('0x' || substr(h, 17, 1) AS int) % 4, 1)
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid, strftime(epoch_ms(o_orderkey), '%Y-%m-%dT%H:%M:%S.%gZ') AS at
      FROM (SELECT o_orderkey, sha256(cast(o_orderkey AS varchar)) AS h FROM orders)""",
)
def deterministic_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    digest = F.sha2(k.cast("string"), 256)
    return ad.table(spark, d, "orders").select(k, paths.deterministic_uuid(digest).alias("uuid"), paths.deterministic_time(k).alias("at"))


@query(
    "date_prefixes",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y.%m.%d') || '_' END AS prefix FROM orders""",
)
def date_prefixes(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(k % 5 == 0, "2024-02-31").when(k % 7 == 0, F.concat(day, F.lit(" 10:00"))).when(k % 2 == 0, F.concat(day, F.lit("T10:00:00Z"))).otherwise(day)
    return ad.table(spark, d, "orders").select(k, paths.date_prefix(said).alias("prefix"))


@query(
    "request_urls",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN cast(o_custkey AS varchar) END AS status_id,
      CASE o_orderkey % 6 WHEN 3 THEN 'ListLatestTweetsTimeline' WHEN 4 THEN 'SearchTimeline' END AS endpoint,
      CASE WHEN o_custkey >= 1000 AND o_orderkey % 6 IN (3, 4) THEN cast(o_custkey AS varchar) END AS list_id FROM orders""",
)
def request_urls(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    api = lambda e, v: F.concat(F.lit(f"https://x.com/i/api/graphql/q1/{e}?variables="), F.url_encode(v), F.lit("&features=1"))
    url = (
        F.when(k == 0, F.concat(F.lit("https://x.com/user/status/"), c)).when(k == 1, F.concat(F.lit("https://twitter.com/i/web/status/"), c, F.lit("/photo/1")))
        .when(k == 2, F.concat(F.lit("https://x.com/status/"), c, F.lit("?s=20"))).when(k == 3, api("ListLatestTweetsTimeline", F.concat(F.lit('{"listId":"'), c, F.lit('"}'))))
        .when(k == 4, api("SearchTimeline", F.concat(F.lit('{"rawQuery":"a list:'), c, F.lit(' b"}')))).otherwise(F.concat(F.lit("https://x.org/i/api/graphql/q/E/status/"), c))
    )
    rows = ad.table(spark, d, "orders").select("o_orderkey", url.alias("url")).withColumn("endpoint", paths.endpoint(F.col("url")))
    return rows.select("o_orderkey", paths.status_id(F.col("url")).alias("status_id"), "endpoint", paths.list_id(F.col("endpoint"), F.col("url")).alias("list_id"))


IGNORED_SQL = ", ".join(f"'{e}'" for e in paths.IGNORED_ENDPOINTS)


@query("endpoint_filter", f"SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN list_extract([{IGNORED_SQL}], cast(1 + o_orderkey % 29 AS int)) ELSE 'HomeTimeline' END NOT IN ({IGNORED_SQL})")
def endpoint_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, paths.IGNORED_ENDPOINTS)), (1 + k % 29).cast("int"))).otherwise("HomeTimeline")
    return ad.table(spark, d, "orders").withColumn("endpoint", said).where(~paths.ignored(F.col("endpoint"))).select("o_orderkey")


@query(
    "display_names",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'u' || c_custkey ELSE c_name END AS name,
      CASE WHEN c_custkey % 2 = 0 THEN 'https://x.com/i/status/' || c_custkey END AS quoted_url FROM customer""",
)
def display_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "").otherwise(F.col("c_name"))
    quoted = F.when(k % 2 == 0, k.cast("string")).when(k % 3 == 0, "")
    return ad.table(spark, d, "customer").select(
        k, paths.display_name(said, F.concat(F.lit("u"), k.cast("string"))).alias("name"), paths.quoted_url(quoted).alias("quoted_url")
    )


@query(
    "hub_references",
    """SELECT p_partkey, reference, trim(regexp_replace(lower(reference), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM (
      SELECT p_partkey, nullif(regexp_extract('see https://HuggingFace.co/' || CASE WHEN p_partkey % 2 = 0 THEN 'datasets/' ELSE '' END || p_brand || '/' || p_type || ' ok',
        '(?i)(?:https?://)?huggingface\\.co/(?:models/|datasets/)?([\\w.-]+/[\\w.-]+)', 1), '') AS reference FROM (
      SELECT p_partkey, replace(p_brand, '#', CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '_' END) AS p_brand, replace(p_type, ' ', '.') AS p_type FROM part))""".replace("\\\\", "\\"),
)
def hub_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    owner, name = F.replace("p_brand", F.lit("#"), F.when(k % 3 == 0, "!").otherwise("_")), F.replace("p_type", F.lit(" "), F.lit("."))
    quote = F.concat(F.lit("see https://HuggingFace.co/"), F.when(k % 2 == 0, "datasets/").otherwise(""), owner, F.lit("/"), name, F.lit(" ok"))
    rows = ad.table(spark, d, "part").select("p_partkey", paths.hub_reference(quote).alias("reference"))
    return rows.select("p_partkey", "reference", paths.hub_name(F.col("reference")).alias("name"))


@query(
    "linkify",
    r"""SELECT page_id, md5(string_agg(CASE WHEN p LIKE 'http%' THEN '<a href="' || e || '" target="_blank" rel="noopener noreferrer">' || e || '</a>'
        WHEN p LIKE '#%' AND length(p) > 1 THEN '<a href="https://x.com/hashtag/' || url_encode(substr(p, 2)) || '" target="_blank" rel="noopener noreferrer">' || e || '</a>'
        WHEN p LIKE '@%' AND length(p) > 1 AND m THEN '<a href="https://x.com/' || substr(p, 2) || '" target="_blank" rel="noopener noreferrer">' || e || '</a>'
        ELSE e END, '' ORDER BY i)) AS digest
      FROM (SELECT page_id, i, p, regexp_full_match(p, '@[A-Za-z0-9_]{1,15}') AS m,
              replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS e
            FROM (SELECT page_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i
                  FROM (SELECT page_id, regexp_extract_all(html, '(?:https?://[^\s]+)|(?:@[A-Za-z0-9_]{1,15})|(?:#[\p{L}0-9_]+)|(?s:.)') AS parts FROM pages))) GROUP BY page_id""",
)
def linkify(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "pages").select("page_id", F.md5(tx.linkified(F.col("html"))).alias("digest"))


# ---- ingest -----------------------------------------------------------------------------------

#: A post as JSON, some of them faulty; in SQL only the fault is told.
LINE_FAULT = """CASE WHEN event_id % 23 = 0 THEN 'json' WHEN event_id % 29 = 0 THEN 'id' WHEN event_id % 31 = 0 THEN 'captured_at' WHEN event_id % 37 = 0 THEN 'username' END"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    post = F.to_json(F.struct(
        F.when(k % 29 != 0, k.cast("string")).alias("id"), F.lit("u").alias("url"), F.lit("t").alias("text"),
        F.when(k % 31 != 0, ad._iso("ts")).otherwise("2024-13-01T00:00:00Z").alias("captured_at"),
        F.struct(F.when(k % 37 != 0, "someone").otherwise("").alias("username")).alias("author"),
        F.when(k % 3 == 0, F.concat(F.lit("c"), (k % 5).cast("string"))).when(k % 3 == 1, "").alias("contributed_by"),
        F.when(k % 4 == 0, "2024-05-05T00:00:00.000Z").alias("pooled_at"),
    ))
    line = F.when(k % 23 == 0, F.substring(post, 1, 20)).otherwise(post)
    path = F.concat(F.lit("data/u"), (k % 7).cast("string"), F.lit("/2024/01/tweets.jsonl"))
    return ad.table(spark, d, "events").select(path.alias("path"), k.alias("line_n"), line.alias("line"))


@query(
    "post_lines",
    f"""SELECT cast(event_id AS varchar) AS id, CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 5) ELSE 'u' || (event_id % 7) END AS contributed_by,
      CASE WHEN event_id % 4 = 0 THEN '2024-05-05T00:00:00.000Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS pooled_at
      FROM events WHERE {LINE_FAULT} IS NULL""",
)
def post_lines(spark: SparkSession, d: str) -> DataFrame:
    return ing.posts(_lines(spark, d)).select("id", "contributed_by", "pooled_at")


@query("source_faults", f"SELECT 'data/u' || (event_id % 7) || '/2024/01/tweets.jsonl' AS path, event_id + 1 AS line_n, reason FROM (SELECT *, {LINE_FAULT} AS reason FROM events) WHERE reason IS NOT NULL")
def source_faults(spark: SparkSession, d: str) -> DataFrame:
    return ing.faults(_lines(spark, d))


@query(
    "stamped_days",
    f"""SELECT 'data/me/' || strftime(ts, '%Y/%m') || '/tweets-' || strftime(ts, '%Y-%m-%d') || '.jsonl' AS path, count(*) AS n FROM events WHERE {LINE_FAULT} IS NULL GROUP BY 1""",
)
def stamped_days(spark: SparkSession, d: str) -> DataFrame:
    stamped = ing.stamp(ing.posts(_lines(spark, d)), F.lit("me"), F.lit("2024-06-01T00:00:00.000Z"))
    return ing.daily(stamped).groupBy("path").agg(F.count("*").alias("n"))


@query("envelopes", "SELECT user_id % 13 AS envelope, count(*) AS n, count(*) BETWEEN 1 AND 1000 AS taken FROM events GROUP BY 1")
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    return ing.envelopes(ad.table(spark, d, "events").select((F.col("user_id") % 13).alias("envelope"), F.col("event_id").alias("position")))


@query(
    "pinned_import",
    """SELECT path, digest, source_order, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', 1 + cast('0x' || substr(h, 17, 1) AS int) % 4, 1)
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS transaction_id, strftime(epoch_ms(source_order), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at
      FROM (SELECT *, sha256(path || ':' || digest) AS h, row_number() OVER (ORDER BY path) - 1 AS source_order FROM (
        SELECT 'data/' || lpad(cast(page_id AS varchar), 9, '0') || '.jsonl' AS path, sha256(html) AS digest FROM pages))""",
)
def pinned_import(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("data/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".jsonl"))
    return ing.pinned(ad.table(spark, d, "pages").select(path.alias("path"), F.col("html").alias("content")))


# ---- selections --------------------------------------------------------------------------------

SELECTED_SQL = """
uf AS (SELECT unit_id, max(captured_at) AS activity, NOT bool_or(is_subscriber_only) AND bool_or(NOT is_retweet) AS public_original FROM mr GROUP BY unit_id),
sel AS (SELECT unit_id FROM uf WHERE public_original AND activity <= '2024-01-20'),
se AS (SELECT unit_id FROM elig WHERE unit_id IN (SELECT unit_id FROM sel) AND unit_id IN (SELECT unit_id FROM asg WHERE kind = 'preset' AND name IN ('good', 'lang-en')))"""
CUTOFF, LABELS = "2024-01-20", ["good", "lang-en"]


def _selected(spark: SparkSession, d: str, **more) -> DataFrame:
    return uni.selected(ad.member_rows(spark, d), cutoff=CUTOFF, public_original=True, **more)


def _selected_eligible(spark: SparkSession, d: str, labels: list[str] = LABELS, every: bool = False) -> DataFrame:
    own = ad.eligible(spark, d).join(_selected(spark, d), "unit_id", "left_semi")
    return lab.with_presets(own, ad.assignments(spark, d), labels, every)


@query("selected_labels", "SELECT t.name, t.description, count(DISTINCT a.unit_id) AS units FROM tax t LEFT JOIN (SELECT * FROM asg WHERE kind = 'preset' AND unit_id IN (SELECT unit_id FROM se)) a USING (name) GROUP BY ALL", True, SELECTED_SQL)
def selected_labels(spark: SparkSession, d: str) -> DataFrame:
    return lab.preset_counts(ad.assignments(spark, d), _selected_eligible(spark, d), ad.taxonomy(spark))


@query("selected_free_labels", "SELECT name, count(DISTINCT unit_id) AS units FROM asg JOIN reg USING (name) WHERE kind = 'free' AND reg.status = 'approved' AND unit_id IN (SELECT unit_id FROM se) GROUP BY name", True, SELECTED_SQL)
def selected_free_labels(spark: SparkSession, d: str) -> DataFrame:
    return lab.free_counts(lab.approved_pairs(ad.assignments(spark, d), _selected_eligible(spark, d), ad.registry(spark, d)))


@query(
    "selected_graph",
    """SELECT a.name AS source, b.name AS target, count(*) AS weight FROM pr a JOIN pr b ON a.unit_id = b.unit_id AND a.name < b.name GROUP BY ALL""",
    True, SELECTED_SQL + ", pr AS (SELECT DISTINCT unit_id, name FROM asg JOIN reg USING (name) WHERE kind = 'free' AND reg.status = 'approved' AND unit_id IN (SELECT unit_id FROM se))",
)
def selected_graph(spark: SparkSession, d: str) -> DataFrame:
    return lab.links(lab.approved_pairs(ad.assignments(spark, d), _selected_eligible(spark, d), ad.registry(spark, d)))


@query("selected_twice_named", "SELECT unit_id FROM elig WHERE false", True)
def selected_twice_named(spark: SparkSession, d: str) -> DataFrame:
    """All labels of a list that names one twice: as many are asked as there are names, so none has them."""
    return _selected_eligible(spark, d, ["good", "good"], True)


@query(
    "selected_status",
    "SELECT count(*) AS units, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in que.STATUSES)
    + ", min(first_queued_at) FILTER (status IN ('pending', 'running', 'retrying')) AS oldest_waiting, max(activity) AS latest_activity FROM queue WHERE unit_id IN (SELECT unit_id FROM sel)",
    True, SELECTED_SQL,
)
def selected_status(spark: SparkSession, d: str) -> DataFrame:
    return que.status_counts(ad.queue(spark, d).join(_selected(spark, d), "unit_id", "left_semi"))


# ---- results, events, costs, chains --------------------------------------------------------------

#: Results of units, made of clicks: some of another contract or taxonomy, with a member missing, an
#: old hash or a quote that is not there.
RESULTS_SQL = """
un AS (SELECT unit_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, max(captured_at) AS activity, min(pid) AS least_pid FROM mr GROUP BY unit_id),
rs AS (SELECT unit_id, event_id AS pos, strftime(ts, '%Y-%m-%dT%H') AS enriched_at, activity, least_pid,
    event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND (event_id % 9 <> 0) AND event_id % 13 <> 0 AS ok
  FROM events JOIN mem ON mem.id = cast(event_id // 4 AS varchar) JOIN un USING (unit_id) WHERE event_type = 'click'),
cr AS (SELECT unit_id, pos, enriched_at FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY enriched_at DESC, pos) AS n FROM rs WHERE ok) WHERE n = 1)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    return ad.member_rows(spark, d).groupBy("unit_id").agg(
        F.array_sort(F.collect_set("id")).alias("post_ids"), F.max("captured_at").alias("activity"), F.min("pid").alias("least_pid")
    ).withColumn("input_hash", F.sha2("unit_id", 256))


def _results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = ad.table(spark, d, "events").where("event_type = 'click'").withColumn("post", F.floor(k / 4).cast("string"))
    own = ad.members(spark, d).select(F.col("id").alias("post"), "unit_id")
    rows = e.join(own, "post").join(_units(spark, d).drop("activity", "least_pid"), "unit_id")
    return rows.select(
        k.alias("result_id"), "unit_id", F.when(k % 9 == 0, F.array_append(F.slice("post_ids", 2, 10_000), F.lit("none"))).otherwise(F.reverse("post_ids")).alias("post_ids"),
        F.when(k % 11 == 0, "old").otherwise(F.col("input_hash")).alias("input_hash"), F.when(k % 5 == 0, "k0").otherwise("k1").alias("contract_hash"),
        F.when(k % 7 == 0, 1).otherwise(2).alias("taxonomy_version"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("enriched_at"), k.alias("pos"),
    )


def _current_results(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d)
    quotes = results.select("result_id", (F.col("result_id") % 13 != 0).alias("verbatim"))
    return res.current(results, _units(spark, d), quotes, "k1", 2)


@query("applied_results", "SELECT unit_id, pos, enriched_at FROM cr", True, RESULTS_SQL)
def applied_results(spark: SparkSession, d: str) -> DataFrame:
    return _current_results(spark, d).select("unit_id", "pos", "enriched_at")


@query(
    "queue_refresh",
    """SELECT unit_id, CASE WHEN unit_id IN (SELECT unit_id FROM cr) THEN 'done' WHEN least_pid % 3 = 0 OR least_pid % 4 = 0 OR least_pid % 5 = 0 THEN 'pending' ELSE 'retrying' END AS status,
      cast(CASE WHEN unit_id IN (SELECT unit_id FROM cr) OR least_pid % 3 = 0 OR least_pid % 4 = 0 OR least_pid % 5 = 0 THEN 0 ELSE 2 END AS int) AS attempts,
      CASE WHEN least_pid % 3 = 0 THEN activity ELSE '2024-01-01' END AS first_queued_at FROM un""",
    True, RESULTS_SQL,
)
def queue_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Units known before (but for each third) are registered again, some with another input or contract."""
    units, k = _units(spark, d), F.col("least_pid")
    known = units.where(k % 3 != 0).select(
        "unit_id", F.when(k % 4 == 0, "other").otherwise(F.col("input_hash")).alias("input_hash"), F.when(k % 5 == 0, "k0").otherwise("k1").alias("contract_hash"),
        F.lit("retrying").alias("status"), F.lit(2).alias("attempts"), F.lit("2024-01-01").alias("first_queued_at"),
    )
    return res.refreshed(units, known, _current_results(spark, d), "k1").select("unit_id", "status", "attempts", "first_queued_at")


@query(
    "reply_parse",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN 'u' || c_custkey END AS unit_id, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN c_custkey % 6 END AS n_free FROM customer""",
)
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies: whole, within prose, with an unknown field, too many labels, a broken or missing object."""
    k = F.col("c_custkey")
    label = lambda i: F.concat(F.lit('{"name":"n'), i.cast("string"), F.lit('","evidence":[{"tweet_id":"1","quote":"q"}]}'))
    listed = lambda n: F.concat_ws(",", F.transform(F.slice(F.array(*map(F.lit, range(6))), 1, n), label))
    unit = lambda n, more="": F.concat(F.lit('{"units":{"u'), k.cast("string"), F.lit('":{"preset_labels":[],"free_labels":['), listed(n), F.lit(f"]{more}}}}}}}"))
    few = (k % 6).cast("int")
    reply = (
        F.when(k % 7 < 2, unit(few)).when(k % 7 == 2, F.concat(F.lit("Here:\n```json\n"), unit(few), F.lit("\n```"))).when(k % 7 == 3, unit(few, ',"why":1'))
        .when(k % 7 == 4, unit(F.lit(6))).when(k % 7 == 5, F.concat(unit(few), F.lit("}"))).otherwise("no object")
    )
    rows = ad.table(spark, d, "customer").select("c_custkey", F.map_entries(res.reply_units(reply)).getItem(0).alias("u"))
    return rows.select("c_custkey", F.col("u.key").alias("unit_id"), F.when(F.col("u").isNotNull(), F.size("u.value.free_labels")).cast("long").alias("n_free"))


@query(
    "registry_event_stamps",
    """SELECT name, status, 10 + row_number() OVER (ORDER BY pos, name) AS registry_revision, CASE WHEN status = 'candidate' THEN 'first_observed' ELSE 'why' END AS reason FROM (
      SELECT name, pos, CASE WHEN length(name) = 9 THEN 'candidate' WHEN status = 'candidate' AND first_observed_at < '2024-01-10' THEN 'approved' WHEN status = 'candidate' THEN 'rejected' END AS status
      FROM (SELECT name, first_observed_at, status, length(name) * 3 AS pos FROM reg)) WHERE status IS NOT NULL""", True,
)
def registry_event_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Events of names: those of nine letters are not known yet, all others are judged."""
    reg = ad.registry(spark, d)
    short = F.length("name") == 9
    decision = F.when(short, "observe").when(F.col("first_observed_at") < "2024-01-10", "approve").otherwise("reject")
    wanted = reg.select("name", decision.alias("decision"), F.lit("why").alias("reason"), (F.length("name") * 3).alias("pos"))
    return res.registry_events(wanted, reg.where(~short), "2024-03-01T00:00:00.000Z", "k1", 10).select("name", "status", "registry_revision", "reason")


@query(
    "run_cost_totals",
    """SELECT run, calls, CASE WHEN unknown = 0 THEN total END AS cents FROM (
      SELECT user_id % 50 AS run, count(*) AS calls, count(*) FILTER (event_id % 3 <> 0 AND event_id % 89 = 1) AS unknown,
        cast(round(sum(CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE value END) * 100) AS bigint) AS total FROM events GROUP BY 1)""",
)
def run_cost_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    calls = ad.table(spark, d, "events").select((F.col("user_id") % 50).alias("run"), (k % 3 != 0).alias("ok"), F.when(k % 89 != 1, F.col("value")).alias("cost_usd"))
    return res.run_costs(calls, 0.25).select("run", "calls", F.round(F.col("cost_usd") * 100).cast("long").alias("cents"))


@query(
    "result_chains",
    """SELECT o_custkey AS chain, n AS sequence, CASE WHEN o_orderkey % 41 = 0 THEN 'hash' END AS fault FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE o_orderkey % 41 = 0 AND n > 1""",
)
def result_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a customer's orders, of which some name another link as the one before."""
    from pyspark.sql import Window as W

    w, k = W.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    digest = F.sha2(k.cast("string"), 256)
    rows = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.row_number().over(w).cast("long").alias("sequence"), digest.alias("sha256"),
        F.when((k % 41 == 0) & F.lag("o_orderkey").over(w).isNotNull(), "other").otherwise(F.lag(digest).over(w)).alias("previous_sha256"))
    return res.chain_faults(rows, "chain")
