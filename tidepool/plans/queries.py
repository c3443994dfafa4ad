"""Queries over the derived facts, each with the SQL that an oracle can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions import paths
from tidepool.operators import captures as cap
from tidepool.operators import labels as lab
from tidepool.operators import queue as que
from tidepool.operators import units as uni
from tidepool.operators.order import numbered
from tidepool.plans import adapter as ad

QUERIES: dict = {}
ORACLES: dict = {}

POST = ["id", "contributed_by", "captured_at", "sort_ts", "author_username"]
POST_SQL = ", ".join(POST)
AUTHORS = [f"a{i}" for i in range(10)]
AUTHORS_SQL = ", ".join(f"'{a}'" for a in AUTHORS)
PAGE = 50
FEED_CURSOR = ("2024-01-20T00:00:00.000Z", "5", "c1")
UNIT_CURSOR = ("2024-01-20T00:00:00.000Z", "5:user1")
LABELS = ["good", "lang-en"]


def query(name: str, oracle: str | None = None, more: str = ""):
    """Register a function (spark, sf_dir) under a name, with the body of its oracle."""

    def take(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = ad.sql(oracle, more)
        return f

    return take


def flag(c: str):
    return F.col(c).cast("int").alias(c)


# ---- ingest and projection -----------------------------------------------------------------


@query("captures_current", "SELECT id, contributed_by, captured_at, sort_ts, author_username, cast(has_media AS int) AS has_media, cast(is_article AS int) AS is_article FROM cur")
def captures_current(spark: SparkSession, d: str) -> DataFrame:
    return ad.current(spark, d).select(*POST, flag("has_media"), flag("is_article"))


def _posted(spark: SparkSession, d: str) -> DataFrame:
    """Posts as clients send them, some of them faulty."""
    e = F.col("replay_pos")
    c = ad.captures(spark, d)
    return c.select(
        F.when(e % 29 != 0, F.col("id")).alias("id"), F.when(e % 31 != 0, F.concat(F.lit("u/"), "id")).alias("url"),
        F.when(e % 37 != 0, F.lit("t")).alias("text"),
        F.when(e % 41 == 0, F.lit("2024-13-01T00:00:00Z")).when(e % 43 == 0, F.lit("2024-01-01")).otherwise(F.col("captured_at")).alias("captured_at"),
        F.when(e % 47 == 0, F.lit("soon")).otherwise(F.col("created_at")).alias("created_at"),
        F.when(e % 53 != 0, F.col("username")).otherwise("").alias("username"), e.alias("position"), "contributed_by",
    )


POSTED_SQL = """
posted AS (
  SELECT replay_pos AS position, CASE WHEN replay_pos % 29 = 0 THEN 'id' WHEN replay_pos % 31 = 0 THEN 'url' WHEN replay_pos % 37 = 0 THEN 'text'
    WHEN replay_pos % 41 = 0 OR replay_pos % 43 = 0 THEN 'captured_at' WHEN replay_pos % 47 = 0 THEN 'created_at' WHEN replay_pos % 53 = 0 THEN 'username' END AS reason,
    contributed_by
  FROM cap)"""


@query("ingest_rejects", "SELECT position, reason FROM posted WHERE reason IS NOT NULL", POSTED_SQL)
def ingest_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _posted(spark, d).withColumn("reason", cap.reject_reason()).where("reason is not null").select("position", "reason")


#: The first events are stored, the later ones are a batch.
STORED = 600
BATCH_SQL = f"""
old AS (SELECT id, contributed_by, max(captured_at) AS known FROM cap WHERE replay_pos < {STORED} GROUP BY ALL),
batch AS (
  SELECT cap.*, rn = 1 AND (known IS NULL OR captured_at > known) AS accepted FROM (
    SELECT *, row_number() OVER (PARTITION BY id, contributed_by ORDER BY captured_at DESC, replay_pos) AS rn FROM cap WHERE replay_pos >= {STORED}) cap
  LEFT JOIN old USING (id, contributed_by))"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    every = cap.project(ad.captures(spark, d))
    return cap.classify(every.where(F.col("replay_pos") >= STORED), cap.freshest(every.where(F.col("replay_pos") < STORED)))


@query("ingest_classify", "SELECT replay_pos, cast(accepted AS int) AS accepted FROM batch", BATCH_SQL)
def ingest_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("replay_pos", flag("accepted"))


@query(
    "ingest_summary",
    "SELECT count(*) FILTER (accepted) AS added, count(*) FILTER (NOT accepted) AS duplicates, (SELECT count(*) FROM posted WHERE reason IS NOT NULL) AS rejected FROM batch",
    BATCH_SQL + "," + POSTED_SQL,
)
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    rejected = _posted(spark, d).where(cap.reject_reason().isNotNull()).agg(F.count("*").alias("rejected"))
    counts = _classified(spark, d).agg(F.count_if("accepted").alias("added"), F.count_if(~F.col("accepted")).alias("duplicates"))
    return counts.join(F.broadcast(rejected))  # two single rows


@query("unit_ids", "SELECT DISTINCT id, unit_key AS unit_id FROM cap")
def unit_ids(spark: SparkSession, d: str) -> DataFrame:
    return cap.project(ad.captures(spark, d)).select("id", uni.unit_key().alias("unit_id")).distinct()


@query("unit_members", "SELECT id, unit_id, captured_at FROM mem")
def unit_members(spark: SparkSession, d: str) -> DataFrame:
    return ad.members(spark, d).select("id", "unit_id", "captured_at")


@query("unit_activity", "SELECT unit_id, max(captured_at) AS activity FROM mr GROUP BY unit_id")
def unit_activity(spark: SparkSession, d: str) -> DataFrame:
    return ad.member_rows(spark, d).groupBy("unit_id").agg(F.max("captured_at").alias("activity"))


@query(
    "unit_profile",
    "SELECT unit_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, string_agg(DISTINCT author_id, ',' ORDER BY author_id) AS authors, count(DISTINCT id) AS n_posts FROM mr GROUP BY unit_id",
)
def unit_profile(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    authors = F.when(F.count("author_id") > 0, listed("author_id"))
    return ad.member_rows(spark, d).groupBy("unit_id").agg(listed("id").alias("ids"), authors.alias("authors"), F.countDistinct("id").alias("n_posts"))


@query(
    "unit_text",
    r"SELECT unit_id, left(string_agg(text, E'\n\n' ORDER BY sort_ts, id), 500) AS text FROM up JOIN txt USING (doc_id) GROUP BY unit_id",
    "up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, id ORDER BY captured_at DESC, contributed_by) AS rn FROM mr) WHERE rn = 1)",
)
def unit_text(spark: SparkSession, d: str) -> DataFrame:
    return uni.unit_text(ad.member_rows(spark, d), ad.texts(spark, d), 500)


HASH_SQL = """
SELECT unit_id, sha256('{"members":[' || string_agg(
    '{' || coalesce('"author_id":' || to_json(author_id) || ',', '') || '"author_username":' || to_json(author_username)
    || coalesce(',"conversation_id":' || to_json(conversation_id), '') || ',"expanded_urls":' || to_json(urls) || ',"id":' || to_json(id)
    || ',"is_retweet":' || is_retweet || ',"is_subscriber_only":' || is_subscriber_only || coalesce(',"quoted_status_id":' || to_json(quoted), '')
    || coalesce(',"reply_to":' || to_json(reply_to), '') || ',"text":' || to_json(text) || '}', ',' ORDER BY id)
  || '],"unit_id":' || to_json(unit_id) || '}') AS input_hash
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, id ORDER BY captured_at DESC, contributed_by) AS rn FROM mr) WHERE rn = 1)
JOIN txt USING (doc_id) GROUP BY unit_id"""


@query("unit_input_hash", HASH_SQL)
def unit_input_hash(spark: SparkSession, d: str) -> DataFrame:
    return uni.input_hash(ad.member_rows(spark, d), ad.texts(spark, d))


# ---- feed ----------------------------------------------------------------------------------


def feed(name: str, predicate, where: str, dedup: bool = False, cursor=None, more: str = "") -> None:
    """Register a page of the feed. predicate: rows, spark, dir -> filtered rows."""
    order = cap.FEED_ORDER[:2] if dedup else cap.FEED_ORDER
    at = cursor[: len(order)] if cursor else None
    after = ""
    if at:
        after = f"WHERE ({', '.join(order)}) < ({', '.join(repr(v) for v in at)})"
    source = f"f AS (SELECT * FROM cur WHERE {where})" + (", " + more if more else "")
    columns = POST_SQL
    if dedup:
        source += """, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, contributed_by) AS rn FROM f)
          JOIN (SELECT id, string_agg(DISTINCT contributed_by, ',' ORDER BY contributed_by) AS contributors FROM f GROUP BY id) USING (id) WHERE rn = 1)"""
        columns += ", contributors"
    tail = ", ".join(f"{c} DESC" for c in order)
    body = f"SELECT {columns} FROM {'g' if dedup else 'f'} {after} ORDER BY {tail} LIMIT {PAGE + 1}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = predicate(ad.current(spark, d), spark, d)
        if dedup:
            rows = cap.deduplicated(rows)
        return cap.page(rows, order, PAGE, at).select(*POST, *(["contributors"] if dedup else []))

    run.__name__ = name
    query(name, body, source)(run)


def _saying(rows: DataFrame, spark: SparkSession, d: str, found) -> DataFrame:
    """rows whose text, or else whose author, a test of a column finds. Each document is tested once."""
    held = ad.texts(spark, d).where(found("text")).select("doc_id", F.lit(True).alias("said"))
    return rows.join(held, "doc_id", "left").where(F.col("said") | found("author_username"))


def _labelled(spark: SparkSession, d: str, names: list[str], every: bool) -> DataFrame:
    """Post ids with current preset labels."""
    own = ad.assignments(spark, d).where(F.col("kind") == "preset").where(F.col("name").isin(names)).join(ad.eligible(spark, d), "unit_id", "left_semi")
    units = own.select("unit_id").distinct()
    if every:
        units = own.groupBy("unit_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(set(names))).select("unit_id")
    return ad.members(spark, d).join(units, "unit_id", "left_semi").select("id")


def _free(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    """Post ids with the first approved label of a prefix."""
    first = ad.registry(spark, d).where("status = 'approved'").where(F.col("name").startswith(prefix)).agg(F.min("name").alias("name"))
    units = lab.approved_pairs(ad.assignments(spark, d), ad.eligible(spark, d), ad.registry(spark, d)).join(F.broadcast(first), "name", "left_semi")
    return ad.members(spark, d).join(units, "unit_id", "left_semi").select("id")


IN_LABELS = ", ".join(f"'{x}'" for x in LABELS)
ANY_SQL = f"id IN (SELECT id FROM mem JOIN asg USING (unit_id) WHERE kind = 'preset' AND name IN ({IN_LABELS}) AND unit_id IN (SELECT unit_id FROM elig))"
ALL_SQL = " AND ".join(f"id IN (SELECT id FROM mem JOIN asg USING (unit_id) WHERE kind = 'preset' AND name = '{x}' AND unit_id IN (SELECT unit_id FROM elig))" for x in LABELS)
NONE_SQL = "id NOT IN (SELECT id FROM mem JOIN asg USING (unit_id) WHERE kind = 'preset' AND name <> 'good' AND unit_id IN (SELECT unit_id FROM elig))"
FREE_SQL = "id IN (SELECT id FROM mem JOIN asg USING (unit_id) JOIN reg USING (name) WHERE kind = 'free' AND reg.status = 'approved' AND name = (SELECT min(name) FROM reg WHERE status = 'approved' AND name LIKE 't%') AND unit_id IN (SELECT unit_id FROM elig))"
TEXT_SQL = "doc_id IN (SELECT doc_id FROM txt WHERE {})"
ACCENTS = f"translate(lower({{}}), '{cap._ACCENTED}', '{cap._PLAIN}')"
NORM = "trim(regexp_replace(" + ACCENTS + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

feed("feed_plain", lambda r, s, d: r, "true")
feed("feed_page2", lambda r, s, d: r, "true", cursor=FEED_CURSOR)
feed("feed_dedup", lambda r, s, d: r, "true", dedup=True)
feed("feed_dedup_page2", lambda r, s, d: r, "true", dedup=True, cursor=FEED_CURSOR)
feed("feed_contributors", lambda r, s, d: r.where(F.col("contributed_by").isin("c0", "c2")), "contributed_by IN ('c0', 'c2')", dedup=True)
feed("feed_author", lambda r, s, d: r.where(F.col("author_username") == F.lower(F.lit("User7"))), "author_username = 'user7'")
feed("feed_author_ids", lambda r, s, d: r.where(F.col("author_id").isin(AUTHORS)), f"author_id IN ({AUTHORS_SQL})")
feed("feed_range", lambda r, s, d: r.where((F.col("sort_ts") >= "2024-01-05") & (F.col("sort_ts") <= "2024-01-18T23:59:59.999Z")), "sort_ts >= '2024-01-05' AND sort_ts <= '2024-01-18T23:59:59.999Z'")
feed("feed_flags", lambda r, s, d: r.where("has_media and not is_article"), "has_media AND NOT is_article")
feed("feed_labels_any", lambda r, s, d: r.join(_labelled(s, d, LABELS, False), "id", "left_semi"), ANY_SQL)
feed("feed_labels_all", lambda r, s, d: r.join(_labelled(s, d, LABELS, True), "id", "left_semi"), ALL_SQL)
feed("feed_unlabeled", lambda r, s, d: r.join(_labelled(s, d, [n for n, _ in ad.TAXONOMY if n != "good"], False), "id", "left_anti"), NONE_SQL)
feed("feed_free_label", lambda r, s, d: r.join(_free(s, d, "t"), "id", "left_semi"), FREE_SQL)
feed("feed_search_literal", lambda r, s, d: _saying(r, s, d, lambda c: cap.literal("TH%on", c)),
     "(" + TEXT_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th%on%'") + " OR author_username LIKE '%th%on%')")
feed("feed_search_phrase", lambda r, s, d: _saying(r, s, d, lambda c: cap.phrase("of the", c)),
     "(" + TEXT_SQL.format(f"contains(' ' || {NORM.format('text')}, ' of the')") + ")")


@query("contributors", "SELECT contributed_by, count(*) AS posts, max(pooled_at) AS last_pooled_at FROM cur GROUP BY contributed_by")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    return cap.contributors(ad.current(spark, d))


@query("capture_count", "SELECT count(*) AS n FROM cur")
def capture_count(spark: SparkSession, d: str) -> DataFrame:
    return ad.current(spark, d).agg(F.count("*").alias("n"))


# ---- units ---------------------------------------------------------------------------------


def units(name: str, predicate, where: str, cursor=None, more: str = "") -> None:
    """Register a page of units. predicate: flags, rows, spark, dir -> flags of units that stay."""
    after = f"WHERE (sort_ts, unit_id) < ({', '.join(repr(v) for v in cursor)})" if cursor else ""
    source = f"""uf AS (SELECT unit_id, max(sort_ts) AS sort_ts, max(captured_at) AS activity, bool_and(coalesce(author_id IN ({AUTHORS_SQL}), false)) AS closed,
        NOT bool_or(is_subscriber_only) AND bool_or(NOT is_retweet) AS public_original FROM mr GROUP BY unit_id),
      us AS (SELECT * FROM uf WHERE {where})"""
    body = f"SELECT unit_id, sort_ts FROM us {after} ORDER BY sort_ts DESC, unit_id DESC LIMIT {PAGE + 1}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = ad.member_rows(spark, d)
        kept = predicate(uni.flags(rows, AUTHORS), rows, spark, d)
        return cap.page(kept, uni.UNIT_ORDER, PAGE, cursor).select("unit_id", "sort_ts")

    run.__name__ = name
    query(name, body, source + (", " + more if more else ""))(run)


def _units_with(spark: SparkSession, d: str, kind: str, names: list[str] | None = None) -> DataFrame:
    own = ad.assignments(spark, d).where(F.col("kind") == kind).join(ad.eligible(spark, d), "unit_id", "left_semi")
    return (own.where(F.col("name").isin(names)) if names else own).select("unit_id", "name")


UNIT_LABEL = "unit_id IN (SELECT unit_id FROM asg WHERE kind = 'preset' AND name IN ({}) AND unit_id IN (SELECT unit_id FROM elig))"
units("units_page1", lambda f, r, s, d: f, "true")
units("units_page2", lambda f, r, s, d: f, "true", cursor=UNIT_CURSOR)
units("units_author_closed", lambda f, r, s, d: f.where("closed"), "closed")
units("units_publication", lambda f, r, s, d: f.where("public_original"), "public_original")
units("units_cutoff", lambda f, r, s, d: f.where(F.col("activity") <= "2024-01-15"), "activity <= '2024-01-15'")
units("units_search", lambda f, r, s, d: f.join(_saying(r.where("has_media"), s, d, lambda c: cap.literal("THING", c)), "unit_id", "left_semi"),
      "unit_id IN (SELECT unit_id FROM mr JOIN txt USING (doc_id) WHERE has_media AND (translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%thing%' OR author_username LIKE '%thing%'))")
units("units_labels_any", lambda f, r, s, d: f.join(_units_with(s, d, "preset", LABELS), "unit_id", "left_semi"), UNIT_LABEL.format(IN_LABELS))
units("units_labels_all", lambda f, r, s, d: f.join(_units_with(s, d, "preset", LABELS).groupBy("unit_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(LABELS)), "unit_id", "left_semi"),
      " AND ".join(UNIT_LABEL.format(f"'{x}'") for x in LABELS))
units("units_unlabeled", lambda f, r, s, d: f.join(_units_with(s, d, "preset"), "unit_id", "left_anti"),
      "unit_id NOT IN (SELECT unit_id FROM asg WHERE kind = 'preset' AND unit_id IN (SELECT unit_id FROM elig))")
units("units_free_label", lambda f, r, s, d: f.join(lab.approved_pairs(ad.assignments(s, d), ad.eligible(s, d), ad.registry(s, d)).where("name < 'b'"), "unit_id", "left_semi"),
      "unit_id IN (SELECT unit_id FROM asg JOIN reg USING (name) WHERE kind = 'free' AND reg.status = 'approved' AND name < 'b' AND unit_id IN (SELECT unit_id FROM elig))")

UP_SQL = "up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, id ORDER BY captured_at DESC, contributed_by) AS rn FROM mr) WHERE rn = 1)"


@query("unit_posts", "SELECT unit_id, id, contributed_by, captured_at FROM up", UP_SQL)
def unit_posts(spark: SparkSession, d: str) -> DataFrame:
    return uni.posts(ad.member_rows(spark, d)).select("unit_id", "id", "contributed_by", "captured_at")


@query(
    "units_hydrated",
    f"""SELECT unit_id, uo.sort_ts, posts, n_posts, contributors FROM
      (SELECT unit_id, max(sort_ts) AS sort_ts FROM mr GROUP BY unit_id ORDER BY 2 DESC, 1 DESC LIMIT {PAGE + 1}) uo
      JOIN (SELECT unit_id, string_agg(id, ',' ORDER BY sort_ts, id) AS posts, count(*) AS n_posts FROM up GROUP BY unit_id) USING (unit_id)
      JOIN (SELECT unit_id, string_agg(DISTINCT contributed_by, ',' ORDER BY contributed_by) AS contributors FROM mr GROUP BY unit_id) USING (unit_id)""",
    UP_SQL,
)
def units_hydrated(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.member_rows(spark, d)
    first = cap.page(uni.flags(rows), uni.UNIT_ORDER, PAGE).select("unit_id", "sort_ts")
    return uni.hydrate(rows, first)


# ---- labels and graph ----------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return lab.approved_pairs(ad.assignments(spark, d), ad.eligible(spark, d), ad.registry(spark, d))


PAIRS_SQL = "pr AS (SELECT DISTINCT unit_id, name FROM asg JOIN reg USING (name) WHERE kind = 'free' AND reg.status = 'approved' AND unit_id IN (SELECT unit_id FROM elig))"
TOP = 60
LINKS_SQL = "SELECT a.name AS source, b.name AS target, count(*) AS weight FROM {p} a JOIN {p} b ON a.unit_id = b.unit_id AND a.name < b.name GROUP BY ALL"
NODES_SQL = f"nd AS (SELECT name, count(*) AS units FROM pr GROUP BY name ORDER BY units DESC, name LIMIT {TOP})"


@query("labels_summary", "SELECT t.name, t.description, count(DISTINCT a.unit_id) AS units FROM tax t LEFT JOIN (SELECT * FROM asg WHERE kind = 'preset' AND unit_id IN (SELECT unit_id FROM elig)) a USING (name) GROUP BY ALL")
def labels_summary(spark: SparkSession, d: str) -> DataFrame:
    return lab.preset_counts(ad.assignments(spark, d), ad.eligible(spark, d), ad.taxonomy(spark))


@query("free_label_counts", "SELECT name, count(*) AS units FROM pr GROUP BY name", PAIRS_SQL)
def free_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return lab.free_counts(_pairs(spark, d))


@query("label_detail", "SELECT name, count(DISTINCT unit_id) AS units, count(DISTINCT mem.id) AS posts FROM pr JOIN mem USING (unit_id) GROUP BY name", PAIRS_SQL)
def label_detail(spark: SparkSession, d: str) -> DataFrame:
    own = ad.members(spark, d).select("id", "unit_id")
    return _pairs(spark, d).join(own, "unit_id").groupBy("name").agg(F.countDistinct("unit_id").alias("units"), F.countDistinct("id").alias("posts"))


@query("label_related", "SELECT b.name, count(*) AS shared FROM pr a JOIN pr b ON a.unit_id = b.unit_id AND b.name <> a.name WHERE a.name = (SELECT min(name) FROM pr) GROUP BY b.name ORDER BY shared DESC, b.name LIMIT 50", PAIRS_SQL)
def label_related(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return lab.related(pairs, pairs.agg(F.min("name").alias("wanted")))


@query("graph_nodes", "SELECT * FROM nd", PAIRS_SQL + ", " + NODES_SQL)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return lab.top_nodes(_pairs(spark, d), TOP)


@query("graph_links_complete", LINKS_SQL.format(p="pr"), PAIRS_SQL)
def graph_links_complete(spark: SparkSession, d: str) -> DataFrame:
    return lab.links(_pairs(spark, d))


@query("graph_links_top", LINKS_SQL.format(p="pn") + f" ORDER BY weight DESC, source, target LIMIT {4 * TOP}", PAIRS_SQL + ", " + NODES_SQL + ", pn AS (SELECT * FROM pr WHERE name IN (SELECT name FROM nd))")
def graph_links_top(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return lab.top_links(pairs, lab.top_nodes(pairs, TOP), TOP)


@query("node_degree", "SELECT name, sum(weight)::BIGINT AS degree FROM (SELECT source AS name, weight FROM l UNION ALL SELECT target, weight FROM l) GROUP BY name", PAIRS_SQL + ", l AS (" + LINKS_SQL.format(p="pr") + ")")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    both = lab.links(_pairs(spark, d)).select(F.explode(F.array("source", "target")).alias("name"), "weight")
    return both.groupBy("name").agg(F.sum("weight").alias("degree"))


@query("communities")
def communities(spark: SparkSession, d: str) -> DataFrame:
    from tidepool.operators.graph import communities as find

    pairs = _pairs(spark, d)
    nodes = lab.top_nodes(pairs, TOP)
    return find(nodes, lab.top_links(pairs, nodes, TOP))


@query(
    "visible_assignments",
    """SELECT a.unit_id, a.name, a.kind, coalesce(string_agg(DISTINCT post_id, ',' ORDER BY post_id), '') AS post_ids, count(post_id) AS n_quotes
       FROM asg a LEFT JOIN ev USING (unit_id, name, kind) LEFT JOIN reg ON reg.name = a.name AND a.kind = 'free'
       WHERE a.kind = 'preset' OR reg.status = 'approved' GROUP BY a.unit_id, a.name, a.kind""",
)
def visible_assignments(spark: SparkSession, d: str) -> DataFrame:
    return lab.visible(ad.assignments(spark, d), ad.evidence(spark, d), ad.registry(spark, d))


@query("current_labels", "SELECT mem.id, asg.name FROM mem JOIN asg USING (unit_id) JOIN queue USING (unit_id) WHERE kind = 'preset' AND status = 'done' AND fresh")
def current_labels(spark: SparkSession, d: str) -> DataFrame:
    own = _units_with(spark, d, "preset")
    return ad.members(spark, d).join(own, "unit_id").select("id", "name")


@query("evidence_rows", "SELECT DISTINCT unit_id, name, kind, post_id, quote FROM ev")
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return ad.evidence(spark, d).distinct()


@query("assignments", "SELECT unit_id, name, kind FROM asg")
def assignments(spark: SparkSession, d: str) -> DataFrame:
    return ad.assignments(spark, d)


@query("registry_snapshot", "SELECT reg.name, reg.status, first_observed_at, count(asg.unit_id) AS units FROM reg LEFT JOIN asg ON asg.name = reg.name AND kind = 'free' GROUP BY ALL")
def registry_snapshot(spark: SparkSession, d: str) -> DataFrame:
    counts = ad.assignments(spark, d).where("kind = 'free'").groupBy("name").agg(F.count("*").alias("n"))
    return ad.registry(spark, d).join(counts, "name", "left").select("name", "status", "first_observed_at", F.coalesce("n", F.lit(0)).alias("units"))


SIGNALS_SQL = """sg AS (
  SELECT name, count(DISTINCT asg.unit_id) AS units, count(DISTINCT author_id) AS authors, count(DISTINCT substr(captured_at, 1, 10)) AS days
  FROM asg JOIN mr USING (unit_id) WHERE kind = 'free' {} GROUP BY name)"""


def _signals(spark: SparkSession, d: str, eligible: bool) -> DataFrame:
    own = ad.assignments(spark, d)
    if eligible:
        own = own.join(ad.eligible(spark, d), "unit_id", "left_semi")
    rows = ad.member_rows(spark, d).select("unit_id", "author_id", F.substring("captured_at", 1, 10).alias("day"))
    return lab.signals(own, ad.evidence(spark, d), rows)


@query("candidate_detail", "SELECT sg.* FROM sg JOIN reg USING (name) WHERE status = 'candidate'", SIGNALS_SQL.format(""))
def candidate_detail(spark: SparkSession, d: str) -> DataFrame:
    names = ad.registry(spark, d).where("status = 'candidate'")
    return _signals(spark, d, False).join(names, "name", "left_semi").select("name", "units", "authors", "days")


@query("promotion_signals", "SELECT * FROM sg", SIGNALS_SQL.format("AND asg.unit_id IN (SELECT unit_id FROM elig)"))
def promotion_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d, True).select("name", "units", "authors", "days")


DECIDED_SQL = """SELECT name, CASE WHEN age_days >= 30 THEN 'stale-below-threshold'
    WHEN surfaces THEN CASE WHEN units >= 5 AND authors >= 3 AND days >= 2 THEN 'surface-evidence-threshold' ELSE 'reviewed-no-transition' END
    WHEN hub THEN 'verified-hub-reference'
    WHEN units >= 15 AND authors >= 8 AND days >= 2 AND verdict THEN 'constrained-review-approved'
    WHEN units >= 15 AND authors >= 8 AND days >= 2 AND NOT verdict THEN 'constrained-review-rejected'
    ELSE 'reviewed-no-transition' END AS decision FROM (
  SELECT name, units, authors, days, greatest(0, (epoch_ms(timestamp '2024-02-10') - epoch_ms(cast(replace(first_observed_at, 'Z', '') AS timestamp))) / 86400000.0) AS age_days,
    name IN (SELECT name FROM ev WHERE post_id LIKE '%7' AND contains(regexp_replace(lower(quote), '[^a-z0-9]+', '-', 'g'), name)) AS surfaces,
    name IN (SELECT name FROM ev WHERE trim(regexp_replace(lower(regexp_extract(quote, 'huggingface.co/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1)), '[^a-z0-9]+', '-', 'g'), '-') = name) AS hub, CASE WHEN ascii(name) % 2 = 0 THEN units % 3 = 0 END AS verdict
  FROM sg JOIN reg USING (name))"""


@query("registry_decisions", DECIDED_SQL, SIGNALS_SQL.format("AND asg.unit_id IN (SELECT unit_id FROM elig)"))
def registry_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name surfaces, and whether a public model is called like it, is what its quotes say: for
    the first, those of posts that end in 7 are read. The review's verdict, which a model gives, goes by the name."""
    said = ad.evidence(spark, d)
    own = ad.assignments(spark, d).join(ad.eligible(spark, d), "unit_id", "left_semi")
    rows = ad.member_rows(spark, d).select("unit_id", "author_id", F.substring("captured_at", 1, 10).alias("day"))
    known = lab.signals(own, said.where("post_id like '%7'"), rows)
    hubs = paths.hub_names(said).select("name", F.lit(True).alias("hub"))
    met = known.join(ad.registry(spark, d), "name").join(hubs, "name", "left").select(
        "name", "units", "authors", "days", "surfaces", lab.age_days(F.lit("2024-02-10T00:00:00.000Z"), F.col("first_observed_at")).alias("age_days"),
        F.coalesce("hub", F.lit(False)).alias("hub"), F.when(F.ascii("name") % 2 == 0, F.col("units") % 3 == 0).alias("verdict"),
    )
    return lab.decisions(met)


@query(
    "registry_replay",
    """SELECT name, max_by(status, turn) AS status, min(first_observed_at) AS first_observed_at, max_by(first_observed_at, turn) AS updated_at FROM (
      SELECT *, row_number() OVER (ORDER BY turn, name) AS pos, count(*) OVER () AS n FROM (
        SELECT name, 'candidate' AS status, first_observed_at, 0 AS turn FROM reg UNION ALL SELECT name, status, first_observed_at, 1 FROM reg WHERE status <> 'candidate'))
      WHERE pos < greatest(2, n * 9 // 10) GROUP BY name""",
)
def registry_replay(spark: SparkSession, d: str) -> DataFrame:
    """A chain of events made of the labels: candidates, then decisions. One revision is left out after
    nine tenths, so nothing applies from there on."""
    names = ad.registry(spark, d).select("name", "status", F.col("first_observed_at").alias("at"))
    first = names.withColumn("status", F.lit("candidate")).withColumn("turn", F.lit(0))
    then = names.where("status <> 'candidate'").withColumn("turn", F.lit(1))
    both = first.unionByName(then)
    events = numbered(both, ["turn", "name"], "pos").join(F.broadcast(both.agg(F.count("*").alias("n"))))  # one row
    gap = F.greatest(F.lit(2), F.floor(F.col("n") * 9 / 10))
    events = events.withColumn("revision", F.col("pos") + (F.col("pos") >= gap).cast("long")).withColumn("contract_hash", F.lit("k"))
    return lab.replay_registry(events.withColumn("reason", F.lit(None).cast("string")), "k").select("name", "status", "first_observed_at", "updated_at")


# ---- queue and status ----------------------------------------------------------------------


STATUS_SQL = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in que.STATUSES)


@query("queue_state", "SELECT unit_id, status, activity, first_queued_at, attempts FROM queue")
def queue_state(spark: SparkSession, d: str) -> DataFrame:
    return ad.queue(spark, d).select("unit_id", "status", "activity", "first_queued_at", "attempts")


@query("queue_depth", f"SELECT {STATUS_SQL} FROM queue")
def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    return que.depth(ad.queue(spark, d))


@query("progress_tracks", "SELECT count(*) AS total, count(*) FILTER (status = 'done') AS complete, count(*) FILTER (status = 'running') AS active FROM queue")
def progress_tracks(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return ad.queue(spark, d).agg(F.count("*").alias("total"), F.count_if(s == "done").alias("complete"), F.count_if(s == "running").alias("active"))


@query("status_counts", f"SELECT count(*) AS units, {STATUS_SQL}, min(first_queued_at) FILTER (status IN ('pending', 'running', 'retrying')) AS oldest_waiting, max(activity) AS latest_activity FROM queue")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return que.status_counts(ad.queue(spark, d))


@query("complete_through", "SELECT max(activity) AS complete_through FROM queue WHERE status = 'done' AND ((SELECT min(activity) FROM queue WHERE status <> 'done') IS NULL OR activity < (SELECT min(activity) FROM queue WHERE status <> 'done'))")
def complete_through(spark: SparkSession, d: str) -> DataFrame:
    return que.complete_through(ad.queue(spark, d))


@query("coverage", "SELECT (SELECT count(*) FROM queue) AS units_total, (SELECT count(*) FROM elig) AS units_enriched")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("status") == "done") & F.col("fresh")
    return ad.queue(spark, d).agg(F.count("*").alias("units_total"), F.count_if(ok).alias("units_enriched"))


@query("queue_plan", "SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS ordinal FROM queue WHERE status IN ('pending', 'retrying', 'running')")
def queue_plan(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of waiting units."""
    open_ = ad.queue(spark, d).where(F.col("status").isin("pending", "retrying", "running")).select("unit_id")
    return numbered(open_, ["unit_id"], "ordinal", 0)


CLAIM = 20
CLAIM_SQL = f"""
op AS (SELECT * FROM queue WHERE status IN ('pending', 'retrying')),
nw AS (SELECT unit_id, row_number() OVER (ORDER BY activity DESC, unit_id) AS position FROM op ORDER BY 2 LIMIT {CLAIM // 2}),
od AS (SELECT unit_id, {CLAIM // 2} + row_number() OVER (ORDER BY first_queued_at, unit_id) AS position FROM op WHERE unit_id NOT IN (SELECT unit_id FROM nw) ORDER BY 2 LIMIT {CLAIM - CLAIM // 2})"""


@query("claim_batch", "SELECT unit_id, CASE WHEN src = 0 THEN position ELSE (SELECT count(*) FROM nw) + position - 10 END AS position FROM (SELECT *, 0 AS src FROM nw UNION ALL SELECT *, 1 FROM od)", CLAIM_SQL)
def claim_batch(spark: SparkSession, d: str) -> DataFrame:
    return que.claim(ad.queue(spark, d), CLAIM).select("unit_id", F.col("position").cast("long").alias("position"))


REPLAY_SQL = """
op AS (SELECT unit_id, attempts AS before, status AS was FROM queue WHERE status <> 'done'),
mt AS (SELECT *, greatest(before, coalesce(max(CASE WHEN outcome <> 'dispatched' THEN attempt END) OVER (PARTITION BY unit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached
       FROM att JOIN op USING (unit_id) WHERE matches AND outcome <> 'success'),
ap AS (SELECT unit_id, max(CASE WHEN outcome <> 'dispatched' THEN attempt END) AS a, arg_max(outcome, seq) AS lo, arg_max(attempt, seq) AS la FROM mt WHERE outcome = 'dispatched' OR attempt > reached GROUP BY unit_id)"""


@query("attempt_replay", "SELECT unit_id, coalesce(a, before) AS attempts, CASE WHEN lo = 'dispatched' THEN 'retrying' WHEN la >= 5 OR lo = 'blocked' THEN 'blocked' WHEN lo IS NOT NULL THEN 'retrying' ELSE was END AS status FROM op LEFT JOIN ap USING (unit_id)", REPLAY_SQL)
def attempt_replay(spark: SparkSession, d: str) -> DataFrame:
    return que.replay_attempts(ad.queue(spark, d), ad.attempts(spark, d))


@query("recent_errors", "SELECT error_class, count(*) AS n, max(\"at\") AS latest FROM (SELECT * FROM att WHERE outcome IN ('transient_failure', 'blocked') ORDER BY seq DESC LIMIT 100) GROUP BY error_class")
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    return que.recent_errors(ad.attempts(spark, d))


@query("backoff", "SELECT seq, CASE WHEN outcome = 'blocked' AND attempt >= 5 THEN 86400000 ELSE least(1800000, 30000 * cast(pow(2, greatest(0, attempt - 1)) AS BIGINT)) END AS wait_ms FROM att")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("outcome") == "blocked", "commit_failed").otherwise(F.col("error_class"))
    return ad.attempts(spark, d).select("seq", que.backoff_ms(F.col("attempt"), kind).alias("wait_ms"))


@query("expired_leases", "SELECT unit_id FROM queue WHERE status = 'running' AND activity < '2024-01-25'")
def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return ad.queue(spark, d).where("status = 'running'").where(F.col("activity") < "2024-01-25").select("unit_id")


@query("run_costs", "SELECT outcome, count(*) AS calls, CASE WHEN count(*) = count(CASE WHEN seq % 97 <> 0 THEN 1 END) THEN count(CASE WHEN matches THEN 1 END) END AS settled FROM att GROUP BY outcome")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    """An unknown cost makes the total of its group unknown."""
    unknown = F.bool_or(F.col("seq") % 97 == 0)
    return ad.attempts(spark, d).groupBy("outcome").agg(F.count("*").alias("calls"), F.when(~unknown, F.count_if("matches")).alias("settled"))


@query("compact_keep_units", "SELECT unit_id FROM queue WHERE status <> 'done' UNION SELECT unit_id FROM asg JOIN reg USING (name) WHERE kind = 'free' AND reg.status = 'candidate'")
def compact_keep_units(spark: SparkSession, d: str) -> DataFrame:
    names = ad.registry(spark, d).where("status = 'candidate'")
    carrying = ad.assignments(spark, d).where("kind = 'free'").join(names, "name", "left_semi").select("unit_id")
    return ad.queue(spark, d).where("status <> 'done'").select("unit_id").union(carrying).distinct()


@query("reconcile", "SELECT contributed_by, count(*) AS n, count(DISTINCT id) AS posts, min(captured_at) AS first_at, max(captured_at) AS last_at FROM cur GROUP BY contributed_by")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return ad.current(spark, d).groupBy("contributed_by").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("posts"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at")
    )
