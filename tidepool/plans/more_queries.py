"""Queries of the parser on payloads made of table rows, results, digests, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators import access as acc
from tidepool.operators import captures as cap
from tidepool.operators import queue as que
from tidepool.operators import units as uni
from tidepool.plans import adapter as ad
from tidepool.sources import timeline as tl

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None, views: bool = False, more: str = ""):
    def take(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = ad.sql(oracle, more) if views else oracle
        return f

    return take


@query(
    "media_normalize",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' ELSE 'animated_gif' END AS type,
      CASE p_partkey % 3 WHEN 0 THEN 'https://h/' || p_partkey || '.jpg:orig' ELSE CASE WHEN p_size % 2 = 0 THEN 'second' ELSE 'first' END END AS url,
      CASE WHEN p_partkey % 3 = 1 THEN p_size * 1000 END AS duration_ms FROM part""",
)
def media_normalize(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    variant = lambda kind, rate, url: F.struct(F.lit(kind).alias("content_type"), rate.cast("long").alias("bitrate"), F.lit(url).alias("url"))
    item = F.struct(
        F.when(k % 3 == 0, "photo").when(k % 3 == 1, "video").otherwise("animated_gif").alias("type"),
        F.concat(F.lit("https://h/"), k.cast("string"), F.lit(".jpg")).alias("media_url_https"),
        F.struct(
            (size * 1000).alias("duration_millis"),
            F.array(variant("video/mp4", size % 2 + 10, "first"), variant("other", F.lit(99), "no"), variant("video/mp4", F.lit(11) - size % 2, "second")).alias("variants"),
        ).alias("video_info"),
    )
    legacy = F.parse_json(F.to_json(F.struct(F.struct(F.array(item).alias("media")).alias("extended_entities"))))
    found = ad.table(spark, d, "part").select("p_partkey", F.explode(tl.media(legacy)).alias("m"))
    return found.select("p_partkey", "m.type", "m.url", "m.duration_ms")


KINDS = ["unstyled", *tl.BLOCK_PREFIX]
PREFIXES = ", ".join(f"'{tl.BLOCK_PREFIX.get(k, '')}'" for k in KINDS)


@query(
    "article_render",
    f"SELECT l_orderkey, string_agg(list_extract([{PREFIXES}], 1 + l_linenumber % 7) || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey",
)
def article_render(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (1 + n % 7).cast("int"))
    block = F.struct(n.alias("n"), F.struct(kind.alias("type"), F.col("l_returnflag").alias("text")).alias("b"))
    blocks = F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"])
    orders = ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(blocks.alias("blocks"))
    result = F.struct(F.struct(F.struct(F.struct(F.col("blocks")).alias("content_state")).alias("result")).alias("article_results"))
    raw = F.parse_json(F.to_json(F.struct(result.alias("article"))))
    return orders.select("l_orderkey", tl.article_text(raw).alias("text"))


@query(
    "image_jobs",
    "SELECT cast(p_partkey AS varchar) AS post_id, 'media/' || p_partkey || '/' || regexp_replace(p_brand, '[^A-Za-z0-9._-]', '', 'g') AS file FROM part WHERE p_partkey % 2 = 0",
)
def image_jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    media = F.array(F.struct(F.when(k % 2 == 0, "photo").otherwise("video").alias("type"), F.concat(F.lit("https://h/"), "p_brand", F.lit(":orig")).alias("url")))
    posts = ad.table(spark, d, "part").select(k.cast("string").alias("id"), media.alias("media"))
    return tl.image_jobs(posts).select("post_id", "file")


@query("photo_media", "SELECT id, array_to_string(list_slice(list(cast(replay_pos AS varchar) ORDER BY replay_pos), 1, 4), ',') AS photos FROM cap WHERE has_media GROUP BY id", views=True)
def photo_media(spark: SparkSession, d: str) -> DataFrame:
    """Up to four photos of each post, in order."""
    pos = F.transform(F.array_sort(F.collect_list("replay_pos")), lambda x: x.cast("string"))
    return ad.captures(spark, d).where("has_media").groupBy("id").agg(F.array_join(F.slice(pos, 1, 4), ",").alias("photos"))


RESULTS_SQL = """
rs AS (SELECT unit_id, event_id AS pos, strftime(ts, '%Y-%m-%dT%H') AS enriched_at, event_id % 3 <> 0 AS hash_ok, event_id % 8 <> 0 AS members_ok
  FROM events JOIN mem ON mem.id = cast(event_id // 4 AS varchar) WHERE event_type = 'click')"""


@query(
    "current_results",
    "SELECT unit_id, pos, enriched_at FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY enriched_at DESC, pos) AS n FROM rs WHERE hash_ok AND members_ok) WHERE n = 1",
    views=True, more=RESULTS_SQL,
)
def current_results(spark: SparkSession, d: str) -> DataFrame:
    """The newest valid result of each unit; of equally new ones the first."""
    k = F.col("event_id")
    e = ad.table(spark, d, "events").where("event_type = 'click'").where((k % 3 != 0) & (k % 8 != 0))
    own = ad.members(spark, d).select("id", "unit_id")
    rows = e.join(own, F.floor(k / 4).cast("string") == own["id"]).select("unit_id", k.alias("pos"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("enriched_at"))
    n = F.row_number().over(W.partitionBy("unit_id").orderBy(F.col("enriched_at").desc(), "pos"))
    return rows.withColumn("n", n).where("n = 1").drop("n")


@query(
    "reconcile_digest",
    "SELECT contributed_by, count(*) AS n, sum(cast('0x' || substr(sha256(id || '|' || captured_at), 1, 8) AS bigint))::bigint AS digest FROM cur GROUP BY contributed_by",
    views=True,
)
def reconcile_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a set of rows that is summed, so it neither sorts nor gathers them."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "captured_at"), 256), 1, 8), 16, 10).cast("long")
    return ad.current(spark, d).groupBy("contributed_by").agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


@query("duplicate_lines", "SELECT id, captured_at, count(*) AS n FROM cap GROUP BY id, captured_at HAVING count(*) > 1 UNION ALL SELECT id, contributed_by, count(*) FROM cap GROUP BY id, contributed_by HAVING count(*) > 1", views=True)
def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    c = ad.captures(spark, d)
    both = [c.groupBy("id", F.col(k).alias("captured_at")).agg(F.count("*").alias("n")).where("n > 1") for k in ("captured_at", "contributed_by")]
    return both[0].unionAll(both[1])


@query(
    "dirty_units",
    """SELECT DISTINCT unit_id FROM mem WHERE id IN (SELECT id FROM cap WHERE replay_pos >= 600)
       UNION SELECT DISTINCT unit_key FROM cap WHERE replay_pos < 600 AND id IN (SELECT id FROM cap WHERE replay_pos >= 600)""", views=True,
)
def dirty_units(spark: SparkSession, d: str) -> DataFrame:
    """Units that a batch touches: where its posts are now, and where they were."""
    every = cap.project(ad.captures(spark, d))
    touched = every.where("replay_pos >= 600").select("id").distinct()
    now = uni.members(every).join(touched, "id", "left_semi").select("unit_id")
    before = uni.members(every.where("replay_pos < 600")).join(touched, "id", "left_semi").select("unit_id")
    return now.union(before).distinct()


LEASE = "90 minutes"


@query(
    "scrape_runs",
    """SELECT user_id, run, count(*) AS beats, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_beat FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, run""",
)
def scrape_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each source: a beat later than the lease begins a new one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w)
    new = F.when(gap.isNull() | (F.col("ts") - gap > F.expr(f"INTERVAL {LEASE}")), 1).otherwise(0)
    rows = ad.table(spark, d, "events").withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("user_id", "run").agg(F.count("*").alias("beats"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_beat"))


@query(
    "contract_hash",
    """SELECT sha256('{"labels":[' || string_agg('{"description":"' || description || '","name":"' || name || '"}', ',' ORDER BY name) || '],"model":"m","taxonomy_version":1}') AS contract_hash FROM tax""",
    views=True,
)
def contract_hash(spark: SparkSession, d: str) -> DataFrame:
    """sha256 of canonical JSON: keys in order, labels by name. The taxonomy is a short list."""
    label = F.struct(F.col("name").alias("k"), F.struct("description", "name").alias("l"))
    labels = F.transform(F.array_sort(F.collect_list(label)), lambda x: x["l"])
    whole = F.to_json(F.struct(labels.alias("labels"), F.lit("m").alias("model"), F.lit(1).alias("taxonomy_version")))
    return ad.taxonomy(spark).agg(F.sha2(whole, 256).alias("contract_hash"))


@query("feed_until_day", "SELECT id, contributed_by, sort_ts FROM cur WHERE sort_ts <= '2024-01-10' || 'T23:59:59.999Z' AND sort_ts >= '2024-01-10'", views=True)
def feed_until_day(spark: SparkSession, d: str) -> DataFrame:
    """A day as the last one of a range counts to its end."""
    day = "2024-01-10"
    return ad.current(spark, d).where((F.col("sort_ts") <= F.concat(F.lit(day), F.lit("T23:59:59.999Z"))) & (F.col("sort_ts") >= day)).select("id", "contributed_by", "sort_ts")


@query("registry_status_counts", "SELECT status, count(*) AS names, min(first_observed_at) AS first_at FROM reg GROUP BY status", views=True)
def registry_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return ad.registry(spark, d).groupBy("status").agg(F.count("*").alias("names"), F.min("first_observed_at").alias("first_at"))


@query("registry_scan", "SELECT name FROM reg WHERE status = 'candidate' AND name > (SELECT min(name) FROM reg WHERE status = 'candidate') ORDER BY name LIMIT 25", views=True)
def registry_scan(spark: SparkSession, d: str) -> DataFrame:
    """The next candidates after a cursor; here the first name is the cursor."""
    names = ad.registry(spark, d).where("status = 'candidate'").select("name")
    after = names.agg(F.min("name").alias("after"))
    return names.join(F.broadcast(after), F.col("name") > F.col("after")).select("name").orderBy("name").limit(25)


@query(
    "failure_marks",
    "SELECT unit_id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 5 OR least_pid % 6 = 0 THEN 'blocked' ELSE 'retrying' END AS status FROM queue WHERE status = 'running'",
    views=True,
)
def failure_marks(spark: SparkSession, d: str) -> DataFrame:
    """Running units after a failure; some failures block at once."""
    running = ad.queue(spark, d).where("status = 'running'")
    return que.failed(running, F.col("least_pid") % 6 == 0).select("unit_id", "attempts", "status")


@query(
    "released_leases",
    "SELECT unit_id, CASE WHEN attempts > 0 THEN 'retrying' ELSE 'pending' END AS status FROM queue WHERE status = 'running' AND activity < '2024-01-25'", views=True,
)
def released_leases(spark: SparkSession, d: str) -> DataFrame:
    """Running units whose lease (here: until their latest activity) is over wait again."""
    return que.released(ad.queue(spark, d), F.col("activity") < "2024-01-25").select("unit_id", "status")


@query(
    "receipt_metrics",
    """SELECT l_orderkey, cast(round(CASE WHEN u + f = 0 THEN 0 ELSE f / (u + f) END * 10000) AS bigint) AS error_bp, cast(round(CASE WHEN u = 0 THEN 0 ELSE d / u END * 10000) AS bigint) AS discarded_bp FROM (
      SELECT l_orderkey, count(*) FILTER (l_linenumber > 2)::double AS u, count(*) FILTER (l_linenumber = 1)::double AS f, count(*) FILTER (l_returnflag = 'R')::double AS d FROM lineitem GROUP BY l_orderkey)""",
)
def receipt_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders as receipts: later lines are units, first ones failures, returned ones discarded labels."""
    n = F.col("l_linenumber")
    receipts = ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(n > 2).alias("units"), F.count_if(n == 1).alias("failures"), F.count_if(F.col("l_returnflag") == "R").alias("discarded")
    )
    bp = lambda c: F.round(F.col(c) * 10000).cast("long")
    return que.receipt_rates(receipts).select("l_orderkey", bp("error_rate").alias("error_bp"), bp("discarded_per_unit").alias("discarded_bp"))


@query(
    "pool_grants",
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'admin' WHEN c_custkey % 10 IN (2, 3) THEN 'member' WHEN c_nationkey IN (1, 2, 3) OR c_nationkey % 5 = 0 THEN 'member_org' END AS "grant",
      CASE WHEN c_custkey % 11 = 0 OR c_custkey % 10 IN (1, 2, 3) THEN NULL WHEN c_nationkey IN (1, 2, 3) THEN 'o' || c_nationkey WHEN c_nationkey % 5 = 0 THEN 'five' END AS org FROM customer""",
)
def pool_grants(spark: SparkSession, d: str) -> DataFrame:
    """Customers as people, with their nation as an organisation; names of some are none."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.when(k % 11 == 0, "-no name").otherwise(F.concat(F.lit(" User"), (k % 10).cast("string")))
    orgs = F.array(F.concat(F.lit("o"), n.cast("string")), F.when(n % 5 == 0, "five").otherwise("none"))
    people = ad.table(spark, d, "customer").select("c_custkey", name.alias("username"), orgs.alias("orgs"))
    rows = [("admin", "USER1"), ("member", "user2"), ("member", "user1"), ("member", "User3 "), ("org", "o1"), ("org", "o2"), ("org", "o3"), ("org", "five")]
    config = spark.createDataFrame(rows, "kind string, value string").coalesce(1)
    return acc.grants(people, config, "c_custkey").select("c_custkey", "grant", "org")
