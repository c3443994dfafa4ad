"""Queries of configuration, recovery, checkpoints, compaction, the archive and pseudonyms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import paths, pseudonyms
from tidepool.operators import configs, recovery
from tidepool.operators import labels as lab
from tidepool.operators import queue as que
from tidepool.plans import adapter as ad
from tidepool.sources import archive

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None, views: bool = False, more: str = ""):
    def take(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = ad.sql(oracle, more) if views else oracle
        return f

    return take


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return ad.table(spark, d, "events").withColumn("e", F.col("event_id")).selectExpr(*columns)


# ---- orphan outputs: a file for 25 events -----------------------------------------------------------

CONTRACT = "c1"
PATHS = "CASE event_type WHEN 'view' THEN 'enrichment/rows.jsonl' WHEN 'click' THEN 'enrichment/attempts/a.jsonl' WHEN 'signup' THEN 'enrichment/registry/r.jsonl' WHEN 'purchase' THEN 'enrichment/receipts/r.jsonl' ELSE 'posts/p.jsonl' END"
LINE_SQL = f"""line AS (
  SELECT 's' || (event_id // 25) AS file, event_id // 25 AS f, {PATHS} AS path, 'u' || (event_id * 7 % 400) AS unit, 'n' || (event_id % 90) AS name,
    CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'transient_failure' END AS outcome, CASE WHEN event_id % 211 = 0 THEN 'other' ELSE 'h' || (event_id * 7 % 400) END AS hash,
    CASE WHEN event_id % 307 = 0 THEN 'c0' ELSE '{CONTRACT}' END AS contract, CASE WHEN event_id % 401 = 1 THEN 2 ELSE 1 END AS version FROM events),
orphan AS (SELECT * FROM line WHERE f % 3 <> 0 AND NOT (f % 3 = 1 AND f // 3 >= 5 AND f // 3 <= 20))"""


@query(
    "orphan_outputs",
    f"""WITH {LINE_SQL},
    ident AS (SELECT DISTINCT 'u' || (event_id * 7 % 400) AS unit, 'h' || (event_id * 7 % 400) AS hash FROM events WHERE event_id * 7 % 400 < 300),
    plan AS (SELECT DISTINCT 'n' || (event_id % 90) AS name FROM events WHERE event_id % 90 BETWEEN 20 AND 59),
    judged AS (
      SELECT file, CASE WHEN path LIKE 'enrichment/attempts/%' THEN 'attempt' WHEN path LIKE 'enrichment/registry/%' THEN 'registry'
        WHEN path LIKE 'enrichment/receipts/%' THEN 'receipt' ELSE 'queue' END AS kind, o.*, i.hash AS own, p.name AS planned
      FROM orphan AS o LEFT JOIN ident AS i ON i.unit = o.unit LEFT JOIN plan AS p ON p.name = o.name WHERE path LIKE 'enrichment/%'),
    bad AS (
      SELECT DISTINCT file, kind, CASE WHEN kind = 'registry' THEN 'decision of another contract' ELSE kind || ' differs from its unit' END AS fault FROM judged
      WHERE (kind = 'registry' AND contract <> '{CONTRACT}') OR (kind IN ('attempt', 'queue') AND own IS NOT NULL AND (hash <> own OR contract <> '{CONTRACT}' OR (kind = 'queue' AND version <> 1))))
    SELECT file, kind, NULL AS item, fault FROM bad
    UNION ALL SELECT DISTINCT file, kind, CASE kind WHEN 'registry' THEN name WHEN 'receipt' THEN 'receipt' ELSE unit END, NULL FROM judged
    WHERE file NOT IN (SELECT file FROM bad) AND CASE kind WHEN 'attempt' THEN own IS NOT NULL AND outcome <> 'success' WHEN 'queue' THEN own IS NOT NULL
      WHEN 'registry' THEN planned IS NOT NULL ELSE contract = '{CONTRACT}' END""",
)
def orphan_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs in files that no checkpoint reaches. Every third file is a source; the chain of the others
    breaks below the fifth link, and the frontier is the twentieth."""
    lines = _events(
        spark, d, "concat('s', e DIV 25) AS file", "e DIV 25 AS f", f"{PATHS} AS path", "concat('u', e * 7 % 400) AS unit_id", "concat('n', e % 90) AS name",
        "CASE WHEN e % 3 = 0 THEN 'success' ELSE 'transient_failure' END AS outcome", "CASE WHEN e % 211 = 0 THEN 'other' ELSE concat('h', e * 7 % 400) END AS input_hash",
        f"CASE WHEN e % 307 = 0 THEN 'c0' ELSE '{CONTRACT}' END AS contract_hash", "CASE WHEN e % 401 = 1 THEN 2 ELSE 1 END AS taxonomy_version",
    )
    files = lines.select("file", "f").distinct()
    links = files.where("f % 3 = 1").selectExpr(
        "0 AS run", "'queue' AS kind", "f DIV 3 AS sequence", "file", "CASE WHEN f DIV 3 = 5 THEN 'torn' ELSE sha2(cast(f DIV 3 - 1 AS string), 256) END AS before", "sha2(cast(f DIV 3 AS string), 256) AS sha"
    )
    frontier = links.where("sequence = 20").select("run", "kind", "sequence", "sha")
    frontier = frontier.unionByName(links.where("sequence < 20").groupBy("run", "kind").agg(F.max("sequence").alias("sequence"), F.max_by("sha", "sequence").alias("sha"))).orderBy(F.desc("sequence")).limit(1)
    left = recovery.orphans(files, files.where("f % 3 = 0"), recovery.reached(links, frontier))
    units = lines.select("unit_id", F.expr("concat('h', substr(unit_id, 2))").alias("input_hash")).where("cast(substr(unit_id, 2) AS int) < 300").distinct()
    names = lines.select("name", F.expr("cast(substr(name, 2) AS int)").alias("ordinal")).where("ordinal < 60").distinct()
    identities = units.withColumn("contract_hash", F.lit(CONTRACT)).withColumn("taxonomy_version", F.lit(1))
    return recovery.routed(lines.join(left, "file", "left_semi"), identities, names, CONTRACT, 20)


# ---- keys of segments ---------------------------------------------------------------------------------

KEY_CATEGORY = "CASE event_type WHEN 'view' THEN 'tweet' WHEN 'click' THEN 'attempt' WHEN 'signup' THEN 'config' ELSE 'mixed' END"


@query(
    "segment_keys",
    f"""WITH said AS (
      SELECT event_id AS e, event_id, {KEY_CATEGORY} AS category, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 17 = 0 THEN '2023/12/31' ELSE strftime(ts, '%Y/%m/%d') END AS day, md5(cast(event_id AS varchar)) AS m,
        CASE WHEN event_id % 23 = 0 THEN sha256('x') ELSE sha256(props) END AS digest FROM events)
    SELECT event_id, CASE WHEN e % 29 <> 0 THEN category END AS category, CASE WHEN e % 29 <> 0 THEN ms END AS created_ms,
      CASE WHEN e % 29 = 0 THEN 'form' WHEN e % 19 = 0 THEN 'transaction' WHEN e % 17 = 0 THEN 'date' WHEN e % 23 = 0 THEN 'digest' END AS fault FROM said""",
)
def segment_keys(spark: SparkSession, d: str) -> DataFrame:
    """What keys of segments say, and where they contradict themselves or the body."""
    rows = ad.table(spark, d, "events").withColumns({"m": F.md5(F.col("event_id").cast("string")), "e": F.col("event_id")})
    key = F.expr(
        f"concat('v1/segments/', {KEY_CATEGORY}, '/', CASE WHEN e % 17 = 0 THEN '2023/12/31' ELSE date_format(ts, 'yyyy/MM/dd') END, '/', unix_millis(cast(ts AS timestamp)), '-', substr(m, 1, 8), '-', "
        "substr(m, 9, 4), '-', CASE WHEN e % 19 = 0 THEN '9' ELSE '4' END, substr(m, 14, 3), '-8', substr(m, 18, 3), '-', substr(m, 21, 12), '-', "
        "sha2(CASE WHEN e % 23 = 0 THEN 'x' ELSE props END, 256), CASE WHEN e % 29 = 0 THEN '.json' ELSE '.json.gz' END)"
    )
    said = rows.select("event_id", "props", paths.segment_key(key).alias("said"))
    return said.select("event_id", "said.category", "said.created_ms", paths.segment_key_fault(F.col("said"), F.sha2("props", 256)).alias("fault"))


# ---- members of pools -----------------------------------------------------------------------------------

OP = "CASE e % 7 WHEN 0 THEN 'add_admin' WHEN 1 THEN 'remove_admin' WHEN 2 THEN 'remove_member' WHEN 3 THEN 'set_org' WHEN 4 THEN CASE WHEN e % 5 = 0 THEN 'remove_org' ELSE 'remove_admin' END ELSE 'add_member' END"


@query(
    "config_members",
    f"""WITH RECURSIVE msg AS (
      SELECT user_id // 20 AS pool, e AS seq, {OP} AS op, 'u' || (e * 13 % 8) AS who, 'o' || (e % 3) AS org, 's' || (e % 4) AS sub,
        row_number() OVER (PARTITION BY user_id // 20 ORDER BY e) AS n FROM (SELECT *, event_id AS e FROM events)),
    steps AS (
      SELECT DISTINCT pool, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS members, CAST([] AS VARCHAR[]) AS admins,
        CAST(NULL AS VARCHAR) AS org, CAST(NULL AS VARCHAR) AS sub, CAST(NULL AS VARCHAR) AS outcome FROM msg
      UNION ALL
      SELECT pool, n, seq, nm, na, no, ns, CASE WHEN refused THEN 'refused' WHEN nm = members AND na = admins AND no IS NOT DISTINCT FROM org AND ns IS NOT DISTINCT FROM sub THEN 'unchanged' ELSE 'changed' END
      FROM (
        SELECT *,
          CASE WHEN op IN ('add_member', 'add_admin') AND NOT boss THEN list_sort(list_distinct(list_append(members, who))) WHEN op = 'remove_member' AND NOT boss THEN list_filter(members, lambda x: x <> who) ELSE members END AS nm,
          CASE WHEN op = 'add_admin' AND NOT boss THEN list_sort(list_append(admins, who)) WHEN op = 'remove_admin' AND NOT refused THEN list_filter(admins, lambda x: x <> who) ELSE admins END AS na,
          CASE WHEN op = 'set_org' AND sub IS DISTINCT FROM new_sub THEN new_org WHEN op = 'remove_org' AND org = new_org THEN NULL ELSE org END AS no,
          CASE WHEN op = 'set_org' AND sub IS DISTINCT FROM new_sub THEN new_sub WHEN op = 'remove_org' AND org = new_org THEN NULL ELSE sub END AS ns
        FROM (
          SELECT *, (op = 'remove_member' AND boss) AS refused FROM (
            SELECT m.pool, m.n, m.seq, m.op, m.who, m.org AS new_org, m.sub AS new_sub, s.members, s.admins, s.org, s.sub, m.who = 'u0' OR list_contains(s.admins, m.who) AS boss
            FROM steps AS s JOIN msg AS m ON m.pool = s.pool AND m.n = s.n + 1) WHERE op <> 'remove_admin'
          UNION ALL
          SELECT *, who = 'u0' AS refused FROM (
            SELECT m.pool, m.n, m.seq, m.op, m.who, m.org AS new_org, m.sub AS new_sub, s.members, s.admins, s.org, s.sub, m.who = 'u0' OR list_contains(s.admins, m.who) AS boss
            FROM steps AS s JOIN msg AS m ON m.pool = s.pool AND m.n = s.n + 1) WHERE op = 'remove_admin')))
    SELECT pool, seq, outcome, array_to_string(members, ',') AS members, array_to_string(admins, ',') AS admins, org, sub FROM steps WHERE n > 0""",
)
def config_members(spark: SparkSession, d: str) -> DataFrame:
    """What each mutation does to the document of its pool; @u0 is a bootstrap admin."""
    mutations = _events(spark, d, "user_id DIV 20 AS pool", "e AS seq", f"{OP} AS op", "concat(' @U', e * 13 % 8) AS who", "concat('o', e % 3) AS org", "concat('s', e % 4) AS sub")
    out = configs.member_changes(mutations, ["u0"])
    return out.select("pool", "seq", "outcome", F.array_join("members", ",").alias("members"), F.array_join("admins", ",").alias("admins"), "org", "sub")


# ---- service accounts ---------------------------------------------------------------------------------

ACCOUNT_OP = "CASE WHEN event_type = 'signup' THEN 'issue' WHEN event_type = 'click' THEN 'rotate' WHEN event_type = 'purchase' AND e % 3 = 0 THEN 'revoke_key' WHEN event_type = 'error' AND e % 4 = 0 THEN 'revoke' ELSE 'ask' END"
TTL = 40_000_000_000


def account_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d, "user_id DIV 10 AS registry", "e % 3 AS slot", "e", "unix_micros(cast(ts AS timestamp)) AS us", f"{ACCOUNT_OP} AS op")
    over = "OVER (PARTITION BY registry, slot ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return rows.selectExpr(
        "registry", "e AS seq", "op", "us",
        f"CASE WHEN op = 'issue' THEN e ELSE last_value(CASE WHEN op = 'issue' THEN e END, true) {over} END AS account",
        f"CASE WHEN op IN ('issue', 'rotate') THEN e ELSE last_value(CASE WHEN op IN ('issue', 'rotate') THEN e END, true) {over} - CASE WHEN e % 13 = 0 THEN 1 ELSE 0 END END AS key",
        "concat('n', e % 60) AS name", "CASE WHEN e % 2 = 0 THEN array('read') ELSE array('read', 'write') END AS scopes", f"us + {TTL} AS expires",
    ).withColumn("token_hash", F.expr("concat('t', key)"))


@query(
    "service_account_calls",
    f"""WITH base AS (SELECT user_id // 10 AS registry, e % 3 AS slot, e, epoch_us(ts) AS us, {ACCOUNT_OP} AS op FROM (SELECT *, event_id AS e FROM events)),
    log AS (
      SELECT *, CASE WHEN op = 'issue' THEN e ELSE last_value(CASE WHEN op = 'issue' THEN e END IGNORE NULLS) OVER w END AS account,
        CASE WHEN op IN ('issue', 'rotate') THEN e ELSE last_value(CASE WHEN op IN ('issue', 'rotate') THEN e END IGNORE NULLS) OVER w - CASE WHEN e % 13 = 0 THEN 1 ELSE 0 END END AS key
      FROM base WINDOW w AS (PARTITION BY registry, slot ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    acc AS (
      SELECT i.registry, i.account, i.e AS issued, 'n' || (i.e % 60) AS name, i.e % 2 AS odd, (SELECT min(r.e) FROM log AS r WHERE r.op = 'revoke' AND r.registry = i.registry AND r.account = i.account) AS revoked
      FROM log AS i WHERE i.op = 'issue' AND NOT EXISTS (SELECT 1 FROM log AS j WHERE j.op = 'issue' AND j.registry = i.registry AND j.e < i.e AND j.e % 60 = i.e % 60)),
    hold AS (
      SELECT k.registry, k.account, k.key, k.e AS made, k.us + {TTL} AS expires, least((SELECT min(t.e) FROM log AS t WHERE t.op = 'revoke_key' AND t.registry = k.registry AND t.account = k.account AND t.key = k.key AND t.e > k.e
        AND t.e >= a.issued AND (a.revoked IS NULL OR t.e < a.revoked)), a.revoked) AS gone
      FROM log AS k JOIN acc AS a ON a.registry = k.registry AND a.account = k.account WHERE k.op IN ('issue', 'rotate') AND k.e >= a.issued AND (a.revoked IS NULL OR k.e < a.revoked)),
    judged AS (
      SELECT q.registry, q.e AS seq, a.name, CASE WHEN NOT coalesce(a.issued < q.e AND (a.revoked IS NULL OR a.revoked > q.e), false) THEN 'account' WHEN q.e % 5 = 0 AND odd = 0 THEN 'scope'
        WHEN NOT coalesce(h.made < q.e AND (h.gone IS NULL OR h.gone > q.e), false) THEN 'key' WHEN h.expires <= q.us THEN 'expired' WHEN q.e % 17 = 0 THEN 'token' ELSE 'ok' END AS verdict
      FROM log AS q LEFT JOIN acc AS a ON a.registry = q.registry AND a.account = q.account LEFT JOIN hold AS h ON h.registry = q.registry AND h.account = q.account AND h.key = q.key WHERE q.op = 'ask')
    SELECT registry, seq, CASE WHEN verdict = 'ok' THEN name END AS name, verdict FROM judged""",
)
def service_account_calls(spark: SparkSession, d: str) -> DataFrame:
    """Who a call is let in as, by the registry as it was at that moment."""
    log = account_log(spark, d)
    asks = log.where("op = 'ask'").selectExpr(
        "registry", "seq", "account", "key", "CASE WHEN seq % 17 = 0 THEN 'wrong' ELSE token_hash END AS token_hash", "CASE WHEN seq % 5 = 0 THEN 'write' ELSE 'read' END AS scope", "us AS at"
    )
    return configs.authorized(asks, log.where("op <> 'ask'"))


# ---- checkpoints ------------------------------------------------------------------------------------------

CHECK_SQL = """base AS (
  SELECT user_id // 3 AS run, event_id AS e, row_number() OVER (PARTITION BY user_id // 3 ORDER BY event_id) AS n,
    sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id // 3 ORDER BY event_id) AS c,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id // 3 ORDER BY event_id) AS names_done FROM events),
st AS (
  SELECT run, e, n AS sequence, CASE WHEN e % 1009 = 0 THEN 'q' ELSE 'p' END AS plan, least(c, 300) AS c, c + CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END AS done,
    CASE WHEN e % 233 = 0 THEN names_done - 2 ELSE names_done END AS next_name, CASE e % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'verified' WHEN 2 THEN 'published' ELSE 'building' END AS publication,
    e % 6 < 3 OR e % 331 = 5 AS has_database FROM base WHERE n < 290 AND e % 149 <> 0)"""


@query(
    "checkpoint_faults",
    f"""WITH {CHECK_SQL},
    prev AS (SELECT *, lag(sequence) OVER w AS ps, lag(plan) OVER w AS pp, lag(next_name) OVER w AS pn FROM st WINDOW w AS (PARTITION BY run ORDER BY sequence, e)),
    word AS (SELECT run, sequence, e, w, greatest(0, least(62, c - 62 * w)) AS full_, CASE WHEN e % 113 = 0 AND w = 0 THEN 1 ELSE 0 END AS cut FROM st, range(5) AS r(w)),
    cuts AS (SELECT run, sequence, sum(full_) - sum(CASE WHEN cut = 1 AND full_ > 0 THEN 1 ELSE 0 END) AS bits FROM word WHERE w >= 0 GROUP BY run, sequence),
    zero AS (SELECT run, sequence, e, least(full_, 62) AS full_, cut, lag(full_) OVER (PARTITION BY run ORDER BY sequence, e) AS pf, lag(cut) OVER (PARTITION BY run ORDER BY sequence, e) AS pc FROM word WHERE w = 0),
    fault AS (
      SELECT run, sequence, unnest(list_filter([CASE WHEN ps <> sequence - 1 THEN 'sequence' END, CASE WHEN pp <> plan THEN 'plan' END, CASE WHEN next_name > 70 OR next_name < pn THEN 'cursor' END,
        CASE WHEN (publication <> 'building') <> has_database THEN 'publication' END], lambda x: x IS NOT NULL)) AS fault FROM prev
      UNION ALL SELECT run, sequence, 'bitmap count' FROM st JOIN cuts USING (run, sequence) WHERE bits <> done
      UNION ALL SELECT run, sequence, 'completed ordinal is open again' FROM zero WHERE cut = 1 AND pc = 0 AND pf > 0
      UNION ALL SELECT run, sequence, 'completed ordinal is unresolved' FROM st WHERE e % 7 = 0 AND (e % 300 < c AND NOT (e % 113 = 0 AND e % 300 = 0))
      UNION ALL SELECT run, sequence, 'ordinal is unresolved twice' FROM st WHERE e % 7 = 0 AND e % 5 = 0)
    SELECT DISTINCT run, sequence, fault FROM fault""",
)
def checkpoint_faults(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints, one for each event of a run, that contradict themselves or the one before them."""
    ordered = "OVER (PARTITION BY user_id DIV 3 ORDER BY event_id)"
    base = _events(
        spark, d, "user_id DIV 3 AS run", "e", f"row_number() {ordered} AS n", f"sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) {ordered} AS c",
        f"sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {ordered} AS names_done",
    ).where("n < 290 and e % 149 <> 0")
    st = base.selectExpr(
        "run", "e", "cast(n AS long) AS sequence", "CASE WHEN e % 1009 = 0 THEN 'q' ELSE 'p' END AS plan", "300 AS total", "least(c, 300) AS c",
        "c + CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END AS done", "CASE WHEN e % 233 = 0 THEN names_done - 2 ELSE names_done END AS next_name", "70 AS names",
        "CASE e % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'verified' WHEN 2 THEN 'published' ELSE 'building' END AS publication", "e % 6 < 3 OR e % 331 = 5 AS has_database",
    )
    return recovery.checkpoint_faults(st, *_bitmap(st))


def _bitmap(st: DataFrame) -> tuple[DataFrame, DataFrame]:
    words = st.select("run", "sequence", "e", "c", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("word"))
    full = F.greatest(F.lit(0), F.least(F.lit(62), F.col("c") - 62 * F.col("word"))).cast("int")
    words = words.withColumn("full", full).selectExpr("run", "sequence", "cast(word AS long) AS word", "shiftleft(1L, full) - 1 - CASE WHEN e % 113 = 0 AND word = 0 AND full > 0 THEN 1 ELSE 0 END AS bits")
    held = st.where("e % 7 = 0").selectExpr("run", "sequence", "cast(e % 300 AS long) AS ordinal")
    return words, held.unionByName(st.where("e % 7 = 0 and e % 5 = 0").selectExpr("run", "sequence", "cast(e % 300 AS long) AS ordinal"))


# ---- compaction -----------------------------------------------------------------------------------------------

PLAN_SQL = """plan AS (SELECT DISTINCT name FROM reg WHERE status = 'candidate'), open AS (SELECT unit_id FROM queue WHERE status <> 'done'),
keep AS (SELECT unit_id FROM open UNION SELECT unit_id FROM asg WHERE kind = 'free' AND name IN (SELECT name FROM plan)),
kept_mem AS (SELECT * FROM mem WHERE unit_id IN (SELECT unit_id FROM keep))"""


def _compact(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    tables = {
        "members": ad.members(spark, d), "captures": ad.current(spark, d).select("id", "contributed_by"), "assignments": ad.assignments(spark, d),
        "results": ad.queue(spark, d).where("fresh").select("unit_id"), "evidence": ad.evidence(spark, d), "queue": ad.queue(spark, d),
    }
    names = ad.registry(spark, d).where("status = 'candidate'").select("name")
    return recovery.compacted(tables, ad.queue(spark, d).where("status <> 'done'").select("unit_id"), names)


@query(
    "compact_tables",
    """SELECT 'members' AS "table", count(*) AS "rows" FROM kept_mem
    UNION ALL SELECT 'captures', count(*) FROM cur WHERE id IN (SELECT id FROM kept_mem)
    UNION ALL SELECT 'results', count(*) FROM queue WHERE fresh AND unit_id IN (SELECT unit_id FROM keep)
    UNION ALL SELECT 'assignments', count(*) FROM asg WHERE unit_id IN (SELECT unit_id FROM keep) AND (kind <> 'free' OR name IN (SELECT name FROM plan))
    UNION ALL SELECT 'evidence', count(*) FROM ev WHERE unit_id IN (SELECT unit_id FROM keep) AND (kind <> 'free' OR name IN (SELECT name FROM plan))
    UNION ALL SELECT 'queue', count(*) FROM open""",
    views=True, more=PLAN_SQL,
)
def compact_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table in a compacted copy."""
    kept = _compact(spark, d)
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in kept.items()])


@query(
    "compact_assignments",
    "SELECT unit_id, name, kind FROM asg WHERE unit_id IN (SELECT unit_id FROM keep) AND (kind <> 'free' OR name IN (SELECT name FROM plan))",
    views=True, more=PLAN_SQL,
)
def compact_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a compacted copy keeps."""
    return _compact(spark, d)["assignments"].select("unit_id", "name", "kind")


# ---- quotes of candidates, leases -----------------------------------------------------------------------------

QUOTED_SQL = """qt AS (SELECT name, unit_id, post_id, quote, row_number() OVER (PARTITION BY name ORDER BY unit_id, post_id, quote) AS n FROM ev JOIN reg USING (name) WHERE reg.status = 'candidate')"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return ad.registry(spark, d).where("status = 'candidate'")


@query("candidate_quotes", "SELECT * FROM qt WHERE n <= 5", views=True, more=QUOTED_SQL)
def candidate_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Representative quotes of each candidate."""
    return lab.quotes(ad.evidence(spark, d), _candidates(spark, d), 5)


@query("review_evidence", "SELECT name, count(*) AS quotes, max(post_id) AS last FROM qt WHERE n <= 20 GROUP BY name", views=True, more=QUOTED_SQL)
def review_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How much of a candidate's evidence a review is given."""
    return lab.quotes(ad.evidence(spark, d), _candidates(spark, d), 20).groupBy("name").agg(F.count("*").alias("quotes"), F.max("post_id").alias("last"))


NOW_MS, LEASE_MS, PAGE = 1_706_400_000_000, 900_000, 20
LEASE_SQL = f"""lq AS (SELECT unit_id, activity, first_queued_at, attempts, status, CASE WHEN status = 'running' THEN 'w' || (least_pid % 3) END AS own,
  CASE WHEN status = 'running' AND least_pid % 4 <> 0 THEN epoch_ms(cast(replace(activity, 'Z', '') AS timestamp)) + (least_pid % 7) * 21600000 END AS until FROM queue),
rq AS (SELECT unit_id, activity, first_queued_at, CASE WHEN until < {NOW_MS} THEN CASE WHEN attempts > 0 THEN 'retrying' ELSE 'pending' END ELSE status END AS status,
  CASE WHEN until IS NULL OR until >= {NOW_MS} THEN own END AS own, CASE WHEN until >= {NOW_MS} THEN until END AS until FROM lq),
wait AS (SELECT * FROM rq WHERE status IN ('pending', 'retrying')),
n1 AS (SELECT unit_id FROM wait ORDER BY activity DESC, unit_id LIMIT {PAGE // 2}),
n2 AS (SELECT unit_id FROM wait WHERE unit_id NOT IN (SELECT unit_id FROM n1) ORDER BY first_queued_at, unit_id LIMIT {PAGE - PAGE // 2}),
mine AS (SELECT unit_id FROM n1 UNION SELECT unit_id FROM n2)"""


@query(
    "queue_leases",
    f"""SELECT unit_id, CASE WHEN m THEN 'running' ELSE status END AS status, CASE WHEN m THEN 'w9' ELSE own END AS lease_owner, CASE WHEN m THEN {NOW_MS + LEASE_MS} ELSE until END AS lease_expires
    FROM (SELECT *, unit_id IN (SELECT unit_id FROM mine) AS m FROM rq)""",
    views=True, more=LEASE_SQL,
)
def queue_leases(spark: SparkSession, d: str) -> DataFrame:
    """The queue after leases that have ended are taken back and a worker has claimed a page."""
    running = F.col("status") == "running"
    until = F.unix_millis(F.col("activity").cast("timestamp")) + F.col("least_pid") % 7 * 21_600_000
    q = ad.queue(spark, d).withColumns({
        "lease_owner": F.when(running, F.concat(F.lit("w"), (F.col("least_pid") % 3).cast("string"))), "lease_expires": F.when(running & (F.col("least_pid") % 4 != 0), until),
    })
    out = que.leased(que.recovered(q, NOW_MS), PAGE, "w9", NOW_MS, LEASE_MS)
    return out.select("unit_id", "status", "lease_owner", "lease_expires")


# ---- archive, pseudonyms --------------------------------------------------------------------------------------


@query(
    "archive_lines",
    """WITH post AS (SELECT 'f' || (user_id % 4) AS folder, event_id AS pos, CASE WHEN event_id % 41 <> 0 THEN 'p' || (event_id * 7 % 900) END AS id, event_type = 'purchase' AS article FROM events),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, id ORDER BY pos) AS n, row_number() OVER (PARTITION BY folder, id, article ORDER BY pos) AS m FROM post)
    SELECT folder, pos FROM ranked WHERE pos >= 3000 AND (id IS NULL OR n = 1 OR (article AND m = 1))""",
)
def archive_lines(spark: SparkSession, d: str) -> DataFrame:
    """What the second batch adds to the folders of an archive that has had the first."""
    posts = _events(spark, d, "concat('f', user_id % 4) AS folder", "e AS pos", "CASE WHEN e % 41 <> 0 THEN concat('p', e * 7 % 900) END AS id", "event_type = 'purchase' AS is_article")
    return archive.fresh(posts.where("pos >= 3000"), archive.keyed(posts.where("pos < 3000"))).select("folder", "pos")


@query(
    "pseudonymous_posts",
    f"""WITH doc AS (SELECT event_id AS e, cast(100000 + user_id AS varchar) AS u, cast(event_id // 4 + 1000000 AS varchar) AS p FROM events)
    SELECT e AS event_id, '{{"data":[{{"rest_id":"' || cast(('0x' || substr(sha256('{pseudonyms.SEED}:id:' || p), 1, 14))::BIGINT AS varchar) || '","core":{{"screen_name":"user_'
      || substr(sha256('{pseudonyms.SEED}:name:u' || u), 1, 8) || '","likes":' || (e % 100) || '}},"refs":["' || cast(('0x' || substr(sha256('{pseudonyms.SEED}:id:' || u), 1, 14))::BIGINT AS varchar) || '","short"]}}]}}' AS post FROM doc""",
)
def pseudonymous_posts(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents made of events, with pseudonyms."""
    user, post = F.expr("cast(100000 + user_id AS string)"), F.expr("cast(event_id DIV 4 + 1000000 AS string)")
    item = F.struct(
        post.alias("rest_id"), F.struct(F.concat(F.lit("U"), user).alias("screen_name"), (F.col("event_id") % 100).alias("likes")).alias("core"), F.array(user, F.lit("short")).alias("refs")
    )
    rows = ad.table(spark, d, "events").select("event_id", F.to_json(F.struct(F.array(item).alias("data"))).alias("json"))
    return rows.select("event_id", pseudonyms.pseudonymous(F.col("json")).alias("post"))
