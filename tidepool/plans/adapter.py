"""Facts of a post pool, derived from the star-schema tables, as DataFrames and as DuckDB SQL.

Every query of :mod:`tidepool.plans.queries` starts from these views. They are folded once, each from
those before it (FOLDS), into the tables of a generation, which the functions below read; the SQL
text is the same derivation, written for the oracle. Texts stay in `documents` and are joined late,
by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators import captures as cap_ops
from tidepool.operators import queue as queue_ops
from tidepool.operators import units as unit_ops
from tidepool.plans import generation

DONE_BEFORE = "2024-01-20"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pid() -> Column:
    return F.floor(F.col("event_id") / 4)


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def captures(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """One capture per event; replay_pos orders them as they arrived. Posts share all documents:
    the text of a post is that of the document of its number modulo their count."""
    pid = F.col("pid")
    n = table(spark, d, "documents").agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"))
    e = (table(spark, d, "events") if events is None else events).withColumn("pid", _pid()).join(F.broadcast(n))  # one row
    group = F.floor(pid / 3) % 50
    created = F.when(
        pid % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((1 + pid % 28).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))
    )
    return e.select(
        pid.cast("string").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("contributed_by"),
        _iso("ts").alias("captured_at"), _iso("ts").alias("pooled_at"), created.alias("created_at"),
        F.when(pid % 17 != 0, F.concat(F.lit("a"), group.cast("string"))).alias("author_id"),
        F.concat(F.lit("User"), group.cast("string")).alias("username"),
        F.when(pid % 7 != 0, F.floor(pid / 6).cast("string")).alias("conversation_id"),
        (F.col("event_type") == "view").alias("has_media"), (F.col("event_type") == "purchase").alias("is_article"),
        (pid % 11 == 0).alias("is_retweet"), (pid % 13 == 0).alias("is_subscriber_only"),
        (pid % F.col("n_docs")).alias("doc_id"), pid.alias("pid"), F.col("event_id").alias("replay_pos"), F.col("value"),
        F.when(pid % 9 == 0, (pid - 1).cast("string")).alias("in_reply_to_tweet_id"),
        F.when(pid % 9 < 2, F.concat(F.lit("r"), pid.cast("string"))).alias("reply_to_status_id"),
        F.when(pid % 8 == 0, "").when(pid % 8 == 1, (pid + 1).cast("string")).alias("quoted_status_id"),
        F.when(pid % 8 < 2, (pid + 2).cast("string")).alias("quote_status_id"),
        F.when(pid % 4 != 3, F.array(F.concat(F.lit("https://h/"), (pid % 5).cast("string")), F.lit(""))).alias("expanded_urls"),
        F.when(pid % 6 < 3, F.array(F.concat(F.lit("https://h/"), (pid % 3).cast("string")), F.lit("https://a/\"é\""))).alias("entity_urls"),
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang")


# ---- folds: (spark, dir, tables written before) -> table -------------------------------------


def _captures(spark: SparkSession, d: str, done: dict) -> DataFrame:
    return cap_ops.freshest(cap_ops.project(captures(spark, d))).drop("rn")


def _members(spark: SparkSession, d: str, done: dict) -> DataFrame:
    return unit_ops.members(cap_ops.project(captures(spark, d)))


def _member_rows(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """Current captures with the unit of their post."""
    return done["captures"].join(done["members"].select("id", "unit_id"), "id")


def _queue(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """unit_id, status, activity, first_queued_at, attempts, least_pid, fresh (the result
    matches the unit's input and contract)."""
    u = done["member_rows"].groupBy("unit_id").agg(
        F.max("captured_at").alias("activity"), F.min("captured_at").alias("first_queued_at"), F.min("pid").alias("least_pid")
    )
    k = F.col("least_pid") % 10
    status = (
        F.when(F.col("activity") < DONE_BEFORE, "done").when(k == 0, "pending").when(k == 1, "running")
        .when(k == 2, "retrying").when(k == 3, "blocked").otherwise("done")
    )
    return u.withColumn("status", status).withColumn("attempts", (F.col("least_pid") % 4).cast("int")).withColumn(
        "fresh", F.col("least_pid") % 19 != 0
    )


def _unit_docs(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """Distinct (unit_id, id, doc_id) of the posts of units."""
    return done["member_rows"].select("unit_id", "id", "doc_id").distinct()


#: Names that a unit may have.
MOST_NAMES = 5


def words_of(spark: SparkSession, d: str, pattern: str, of: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """doc_id, name: the distinct words of each document that a pattern finds; of those in `of` alone;
    of each document only the first `most` by name."""
    docs = texts(spark, d) if of is None else texts(spark, d).join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return docs.select("doc_id", F.explode(words if most is None else F.slice(F.array_sort(words), 1, most)).alias("name"))


def first_names(said: DataFrame, of: str = "unit_id", most: int = MOST_NAMES) -> DataFrame:
    """unit_id, name: at most five names a unit (or of what else names are said), the first by name. Those
    of a unit are among the first five of its documents, so documents are cut before units are joined."""
    n = F.row_number().over(W.partitionBy(of).orderBy("name"))
    return said.withColumn("n", n).where(F.col("n") <= most).select(of, "name")


def _free_labels(spark: SparkSession, d: str, done: dict) -> DataFrame:
    units = done["unit_docs"].select("unit_id", "doc_id").distinct()
    words = words_of(spark, d, "[a-z]{9,12}", units if done.get("some") else None, MOST_NAMES)
    return first_names(units.join(words, "doc_id").select("unit_id", "name").distinct())


def _registry(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """name, status, first_observed_at of every free label."""
    n = F.length("name")
    seen = done["free_labels"].join(done["queue"].select("unit_id", "activity"), "unit_id")
    return seen.groupBy("name").agg(F.min("activity").alias("first_observed_at")).withColumn(
        "status", F.when(n <= 10, "approved").when(n == 11, "candidate").otherwise("rejected")
    )


def _preset_labels(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """unit_id, name."""
    marks = table(spark, d, "labels")
    of_doc = (
        texts(spark, d).select("doc_id", F.concat(F.lit("lang-"), "lang").alias("name")).where("name is not null")
        .unionByName(marks.where("quality = 1").select("doc_id", F.lit("good").alias("name")))
        .unionByName(marks.where("toxic = 1").select("doc_id", F.lit("toxic").alias("name")))
    )
    return done["unit_docs"].select("unit_id", "doc_id").distinct().join(of_doc, "doc_id").select("unit_id", "name").distinct()


def _assignments(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """unit_id, name, kind of the current result of every unit that has one."""
    both = done["preset_labels"].withColumn("kind", F.lit("preset")).unionByName(done["free_labels"].withColumn("kind", F.lit("free")))
    return both.join(done["queue"].where("fresh").select("unit_id"), "unit_id", "left_semi")


def _evidence(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """unit_id, name, kind, post_id, quote: free labels are quoted from the posts that hold them."""
    met = done["assignments"].where("kind = 'free'").join(done["unit_docs"].withColumnRenamed("id", "post_id"), "unit_id")
    held = met.select("doc_id", "name").distinct().join(texts(spark, d).select("doc_id", "text"), "doc_id")
    held = held.where(F.expr("contains(text, name)")).select("doc_id", "name")
    return met.join(held, ["doc_id", "name"]).select("unit_id", "name", "kind", "post_id", F.col("name").alias("quote"))


def _attempts(spark: SparkSession, d: str, done: dict) -> DataFrame:
    """unit_id, id, seq, attempt, outcome, error_class, at, matches, cost_usd: attempts of units."""
    e = done.get("events", table(spark, d, "events")).where("event_type = 'error'").withColumn("pid", _pid())
    own = done["members"].select(F.col("id"), "unit_id")
    k = F.col("event_id")
    outcome = F.when(k % 7 == 0, "dispatched").when(k % 11 == 0, "blocked").when(k % 5 == 0, "success").otherwise("transient_failure")
    error = F.when(k % 3 == 0, "timeout").when(k % 3 == 1, "rate_limit").otherwise("other")
    return e.join(own, e["pid"].cast("string") == own["id"]).select(
        "unit_id", "id", F.col("event_id").alias("seq"), (1 + F.floor(k / 3) % 6).cast("int").alias("attempt"), outcome.alias("outcome"),
        error.alias("error_class"), _iso("ts").alias("at"), (k % 13 != 0).alias("matches"), F.col("value").alias("cost_usd"),
    )


FOLDS = {
    "captures": _captures, "members": _members, "member_rows": _member_rows, "queue": _queue, "unit_docs": _unit_docs,
    "free_labels": _free_labels, "registry": _registry, "preset_labels": _preset_labels, "assignments": _assignments,
    "evidence": _evidence, "attempts": _attempts,
}


# ---- the tables of the generation --------------------------------------------------------------


def _read(name: str):
    def read(spark: SparkSession, d: str) -> DataFrame:
        return generation.tables(spark, d)[name]

    return read


current = _read("captures")
members, member_rows, queue, unit_docs = _read("members"), _read("member_rows"), _read("queue"), _read("unit_docs")
free_labels, registry, preset_labels = _read("free_labels"), _read("registry"), _read("preset_labels")
assignments, evidence, attempts = _read("assignments"), _read("evidence"), _read("attempts")


def eligible(spark: SparkSession, d: str) -> DataFrame:
    """Units whose result is current: done, with matching input and contract."""
    return queue_ops.eligible(queue(spark, d))


#: name, description of the preset labels.
TAXONOMY = [
    ("lang-de", "German"), ("lang-en", "English"), ("lang-es", "Spanish"), ("lang-fr", "French"),
    ("good", "Good prose"), ("toxic", "Toxic"), ("unused", "Never assigned"),
]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "name string, description string").coalesce(1)


SQL_VIEWS = rf"""
cap AS (
  SELECT cast(pid AS varchar) AS id, 'c' || cast(user_id % 3 AS varchar) AS contributed_by,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS captured_at, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS pooled_at,
    CASE WHEN pid % 5 <> 0 THEN '2024-01-' || lpad(cast(1 + pid % 28 AS varchar), 2, '0') || 'T00:00:00.000Z' END AS created_at,
    CASE WHEN pid % 17 <> 0 THEN 'a' || cast((pid // 3) % 50 AS varchar) END AS author_id,
    'user' || cast((pid // 3) % 50 AS varchar) AS author_username,
    CASE WHEN pid % 7 <> 0 THEN cast(pid // 6 AS varchar) END AS conversation_id,
    event_type = 'view' AS has_media, event_type = 'purchase' AS is_article, pid % 11 = 0 AS is_retweet,
    pid % 13 = 0 AS is_subscriber_only, pid % (SELECT count(*) FROM documents) AS doc_id, pid, event_id AS replay_pos, value,
    CASE WHEN pid % 9 < 2 THEN CASE WHEN pid % 9 = 0 THEN cast(pid - 1 AS varchar) ELSE 'r' || pid END END AS reply_to,
    CASE WHEN pid % 8 = 0 THEN cast(pid + 2 AS varchar) WHEN pid % 8 = 1 THEN cast(pid + 1 AS varchar) END AS quoted,
    list_sort(list_distinct(list_concat(CASE WHEN pid % 4 <> 3 THEN ['https://h/' || (pid % 5)] ELSE [] END,
      CASE WHEN pid % 6 < 3 THEN ['https://h/' || (pid % 3), 'https://a/"é"'] ELSE [] END))) AS urls,
    coalesce(CASE WHEN pid % 5 <> 0 THEN '2024-01-' || lpad(cast(1 + pid % 28 AS varchar), 2, '0') || 'T00:00:00.000Z' END,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')) AS sort_ts,
    coalesce(CASE WHEN pid % 7 <> 0 THEN cast(pid // 6 AS varchar) END, cast(pid AS varchar)) || ':user' || cast((pid // 3) % 50 AS varchar) AS unit_key
  FROM (SELECT *, event_id // 4 AS pid FROM events)),
cur AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY id, contributed_by ORDER BY captured_at DESC, replay_pos) AS rn FROM cap)
  WHERE rn = 1),
mem AS (
  SELECT id, unit_key AS unit_id, captured_at FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, replay_pos DESC) AS rn FROM cap)
  WHERE rn = 1),
mr AS (SELECT cur.*, mem.unit_id FROM cur JOIN mem USING (id)),
txt AS (SELECT doc_id, text, lang FROM documents),
queue AS (
  SELECT *, CASE WHEN activity < '{DONE_BEFORE}' THEN 'done' WHEN least_pid % 10 = 0 THEN 'pending' WHEN least_pid % 10 = 1 THEN 'running'
      WHEN least_pid % 10 = 2 THEN 'retrying' WHEN least_pid % 10 = 3 THEN 'blocked' ELSE 'done' END AS status,
    cast(least_pid % 4 AS integer) AS attempts, least_pid % 19 <> 0 AS fresh
  FROM (SELECT unit_id, max(captured_at) AS activity, min(captured_at) AS first_queued_at, min(pid) AS least_pid FROM mr GROUP BY unit_id)),
ud AS (SELECT DISTINCT unit_id, id, doc_id FROM mr),
fl AS (
  SELECT unit_id, name FROM (
    SELECT unit_id, name, row_number() OVER (PARTITION BY unit_id ORDER BY name) AS n FROM (
      SELECT DISTINCT unit_id, name FROM ud JOIN (
        SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]{{9,12}}'))) AS name FROM txt) USING (doc_id)))
  WHERE n <= 5),
reg AS (
  SELECT name, min(activity) AS first_observed_at,
    CASE WHEN length(name) <= 10 THEN 'approved' WHEN length(name) = 11 THEN 'candidate' ELSE 'rejected' END AS status
  FROM fl JOIN queue USING (unit_id) GROUP BY name),
tax(name, description) AS (VALUES {", ".join(f"('{n}', '{t}')" for n, t in TAXONOMY)}),
pl AS (
  SELECT DISTINCT unit_id, name FROM ud JOIN (
    SELECT doc_id, 'lang-' || lang AS name FROM txt WHERE lang IS NOT NULL
    UNION ALL SELECT doc_id, 'good' FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) USING (doc_id)),
asg AS (
  SELECT unit_id, name, kind FROM (SELECT *, 'preset' AS kind FROM pl UNION ALL SELECT *, 'free' AS kind FROM fl)
  WHERE unit_id IN (SELECT unit_id FROM queue WHERE fresh)),
ev AS (
  SELECT unit_id, name, kind, id AS post_id, name AS quote FROM asg JOIN ud USING (unit_id) JOIN txt USING (doc_id)
  WHERE kind = 'free' AND contains(text, name)),
elig AS (SELECT unit_id FROM queue WHERE status = 'done' AND fresh),
att AS (
  SELECT unit_id, event_id AS seq, cast(1 + (event_id // 3) % 6 AS integer) AS attempt,
    CASE WHEN event_id % 7 = 0 THEN 'dispatched' WHEN event_id % 11 = 0 THEN 'blocked' WHEN event_id % 5 = 0 THEN 'success' ELSE 'transient_failure' END AS outcome,
    CASE WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN 'rate_limit' ELSE 'other' END AS error_class,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, event_id % 13 <> 0 AS matches, value AS cost_usd
  FROM events JOIN mem ON mem.id = cast(event_id // 4 AS varchar) WHERE event_type = 'error')
"""


def sql(body: str, more: str = "") -> str:
    """Oracle SQL: the views, further ones, and a query over them."""
    return f"WITH {SQL_VIEWS.strip()}{', ' + more.strip() if more else ''}\n{body.strip()}"
