"""Queries of the folds that go through a client's facts in order. What a client sends is derived
from `events`: USERS users make a client, and a clock that runs SLOWER times slower brings them closer
together than a lease. The SQL folds the same facts by recursion, one message of each client a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import flows, sequences
from tidepool.plans import adapter as ad

QUERIES: dict = {}
ORACLES: dict = {}
USERS, SLOWER = 3, 700


def query(name: str, oracle: str):
    def take(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return take


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = ad.table(spark, d, "events")
    return e.withColumn("client", F.floor(F.col("user_id") / USERS)).withColumn("e", F.col("event_id")).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


# ---- scrape runs ----------------------------------------------------------------------------------


def messages(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(
        "client", "e AS seq", f"ms DIV {SLOWER} AS at",
        "CASE WHEN e % 197 = 0 THEN 'cutover_begin' WHEN e % 197 < 30 AND e % 5 = 1 THEN 'cutover_end' WHEN event_type = 'click' THEN 'renew' "
        "WHEN event_type = 'view' THEN 'observe' WHEN event_type = 'purchase' THEN 'finish' WHEN event_type = 'error' AND e % 4 = 0 THEN 'tab_closed' ELSE 'begin' END AS kind",
        "concat('r', e % 6, '-', day(ts) DIV 3) AS run_id", "CASE WHEN e % 31 = 0 THEN '999' ELSE concat('10', e % 6) END AS list_id",
        "CASE WHEN (e DIV 6) % 9 = 0 THEN (e DIV 6) % 6 ELSE e % 6 END AS tab", "cast(day(ts) DIV 3 AS long) AS started",
        "CASE e % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'aborted' END AS ending",
    )


_RUN = {f: f"r.{f}" for f in sequences.RUN_FIELDS}


def _put(runs: str, where: str, **changes: str) -> str:
    """SQL of a list of runs in which those that a condition holds for are changed."""
    fields = ", ".join(f"'{k}': {v}" for k, v in (_RUN | changes).items())
    return f"list_transform({runs}, lambda r: CASE WHEN {where} THEN {{{fields}}} ELSE r END)"


_NEW = ", ".join(
    f"'{k}': {v}"
    for k, v in {
        "run_id": "run_id", "list_id": "list_id", "tab": "tab", "state": "'running'", "stop_reason": "CAST(NULL AS VARCHAR)", "started": "started",
        "lease": f"ms + {sequences.LEASE_MS}", "updated": "ms", "finished": "CAST(NULL AS BIGINT)",
    }.items()
)
_STRUCT = "STRUCT(run_id VARCHAR, list_id VARCHAR, tab BIGINT, state VARCHAR, stop_reason VARCHAR, started BIGINT, lease BIGINT, updated BIGINT, finished BIGINT)"
_EXPIRED = {"state": "'failed'", "stop_reason": "'lease-expired'", "updated": "ms", "finished": "ms"}
RUN_SQL = f"""WITH RECURSIVE msg AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY ms, seq) AS n FROM (
    SELECT user_id // {USERS} AS client, e AS seq, (epoch_us(ts) // 1000) // {SLOWER} AS ms,
      CASE WHEN e % 197 = 0 THEN 'cutover_begin' WHEN e % 197 < 30 AND e % 5 = 1 THEN 'cutover_end' WHEN event_type = 'click' THEN 'renew'
        WHEN event_type = 'view' THEN 'observe' WHEN event_type = 'purchase' THEN 'finish' WHEN event_type = 'error' AND e % 4 = 0 THEN 'tab_closed' ELSE 'begin' END AS kind,
      'r' || (e % 6) || '-' || (day(ts) // 3) AS run_id, CASE WHEN e % 31 = 0 THEN '999' ELSE '10' || (e % 6) END AS list_id,
      CASE WHEN (e // 6) % 9 = 0 THEN (e // 6) % 6 ELSE e % 6 END AS tab, day(ts) // 3 AS started,
      CASE e % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'aborted' END AS ending
    FROM (SELECT *, event_id AS e FROM events))),
steps AS (
  SELECT DISTINCT client, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS {_STRUCT}[]) AS runs, false AS cut, CAST(NULL AS VARCHAR) AS outcome FROM msg
  UNION ALL
  SELECT client, n, seq,
    CASE WHEN kind = 'begin' AND outcome IN ('began', 'resumed', 'renewed')
        THEN list_append({_put("list_filter(runs, lambda r: r.run_id <> run_id)", "r.state = 'running' AND r.lease <= ms", **_EXPIRED)}, {{{_NEW}}})
      WHEN kind = 'renew' AND outcome = 'renewed' THEN {_put("runs", "r.run_id = run_id", lease=f"ms + {sequences.LEASE_MS}", updated="ms")}
      WHEN kind = 'finish' AND outcome = 'finished' THEN {_put("runs", "r.run_id = run_id", state="ending", updated="ms", finished="ms")}
      WHEN kind = 'observe' AND outcome = 'observed' THEN {_put("runs", "r.state = 'running' AND r.tab = tab", updated="ms")}
      WHEN kind = 'observe' THEN {_put("runs", "r.state = 'running' AND r.tab = tab", **_EXPIRED)}
      WHEN kind = 'tab_closed' THEN {_put("runs", "r.state = 'running' AND r.tab = tab", state="'aborted'", stop_reason="'source-tab-closed'", updated="ms", finished="ms")}
      WHEN kind = 'cutover_begin' THEN {_put("runs", "r.state = 'running'", state="'failed'", updated="ms", finished="ms")}
      ELSE runs END,
    CASE kind WHEN 'cutover_begin' THEN true WHEN 'cutover_end' THEN false ELSE cut END, outcome
  FROM (
    SELECT *, CASE kind
      WHEN 'begin' THEN CASE WHEN cut THEN 'cutover-active' WHEN own IS NOT NULL AND (own.list_id <> list_id OR own.started <> started) THEN 'run-conflict'
        WHEN going AND own.tab <> tab THEN 'run-conflict'
        WHEN own IS NOT NULL AND NOT going AND own.state <> 'running' AND coalesce(own.stop_reason, '') NOT IN ('lease-expired', 'source-tab-closed') THEN 'run-terminal'
        WHEN NOT going AND len(list_filter(active, lambda r: r.tab = tab)) > 0 THEN 'source-tab-active'
        WHEN NOT going AND len(active) >= {sequences.MOST_RUNNING} THEN 'capacity-full'
        WHEN going THEN 'renewed' WHEN own IS NOT NULL THEN 'resumed' ELSE 'began' END
      WHEN 'renew' THEN CASE WHEN own IS NULL THEN 'unknown-run' WHEN own.state <> 'running' THEN 'run-terminal' WHEN own.tab <> tab THEN 'run-conflict' ELSE 'renewed' END
      WHEN 'finish' THEN CASE WHEN own IS NULL THEN 'unknown-run' WHEN own.state NOT IN ('running', ending) THEN 'run-terminal' ELSE 'finished' END
      WHEN 'observe' THEN CASE WHEN len(list_filter(active, lambda r: r.tab = tab)) > 0 THEN 'observed' ELSE 'unattached' END
      WHEN 'tab_closed' THEN 'closed-' || len(list_filter(runs, lambda r: r.state = 'running' AND r.tab = tab))
      WHEN 'cutover_begin' THEN 'closed-' || len(list_filter(runs, lambda r: r.state = 'running'))
      ELSE 'cutover-ended' END AS outcome
    FROM (
      SELECT *, coalesce(own.state = 'running' AND own.lease > ms, false) AS going FROM (
        SELECT m.*, s.runs, s.cut, list_filter(s.runs, lambda r: r.state = 'running' AND r.lease > m.ms) AS active,
          list_filter(s.runs, lambda r: r.run_id = m.run_id)[1] AS own
        FROM steps AS s JOIN msg AS m ON m.client = s.client AND m.n = s.n + 1))))"""


@query("scrape_run_outcomes", f"{RUN_SQL} SELECT client, seq, outcome FROM steps WHERE n > 0")
def scrape_run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each message about a run: begun, renewed, resumed, refused and why."""
    return sequences.run_changes(messages(spark, d)).where("outcome is not null").select("client", "seq", "outcome")


@query(
    "scrape_run_states",
    f"""{RUN_SQL} SELECT client, r.run_id, r.list_id, r.tab, r.state, r.stop_reason, r.started, r.lease, r.updated, r.finished FROM (
      SELECT client, unnest(runs) AS r FROM steps WHERE (client, n) IN (SELECT (client, max(n)) FROM msg GROUP BY client))""",
)
def scrape_run_states(spark: SparkSession, d: str) -> DataFrame:
    """Each run as its client's last message leaves it."""
    return sequences.run_states(sequences.run_changes(messages(spark, d)))


# ---- what a client remembers ----------------------------------------------------------------------

SEEN, BUFFERED = 40, 12


def sights(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(
        "client", "e DIV 400 AS batch", "e AS pos", "CASE WHEN event_type = 'signup' AND e % 7 = 0 THEN 'flush' ELSE 'post' END AS kind",
        "CASE WHEN e % 53 = 0 THEN '' ELSE concat('p', (e * 7) % 60) END AS id", "event_type = 'purchase' AS is_article", "e % 7 < 3 AS has_photo",
    )


@query(
    "client_memory",
    f"""WITH RECURSIVE row AS (
      SELECT user_id // {USERS} AS client, e // 400 AS batch, e AS pos, CASE WHEN event_type = 'signup' AND e % 7 = 0 THEN 'flush' ELSE 'post' END AS kind,
        CASE WHEN e % 53 <> 0 THEN 'p' || ((e * 7) % 60) END AS id, event_type = 'purchase' AS article, e % 7 < 3 AS photo
      FROM (SELECT *, event_id AS e FROM events)),
    msg AS (
      SELECT *, row_number() OVER (PARTITION BY client ORDER BY batch, pos) AS n FROM row
      UNION ALL SELECT client, NULL, NULL, 'end', NULL, false, false, count(*) + 1 FROM row GROUP BY client),
    steps AS (
      SELECT DISTINCT client, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batch, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS asked,
        CAST([] AS STRUCT(pos BIGINT, id VARCHAR, again BOOLEAN)[]) AS buf, CAST([] AS STRUCT(pos BIGINT, fate VARCHAR)[]) AS fates FROM row
      UNION ALL
      SELECT client, n, batch,
        CASE WHEN fate IS NULL OR fate = 'duplicate' OR id IS NULL THEN seen
          ELSE list_concat(list_concat(seen, CASE WHEN was THEN [] ELSE [id] END), CASE WHEN article AND NOT list_contains(seen, 'article:' || id) THEN ['article:' || id] ELSE [] END) END,
        CASE WHEN fate IN ('accepted', 'backfill') AND asks THEN list_append(asked, id) ELSE asked END,
        CASE WHEN kind = 'flush' THEN [] WHEN fate IN ('accepted', 'backfill') THEN list_append(buf, {{'pos': pos, 'id': id, 'again': fate = 'backfill'}}) ELSE buf END,
        list_concat(dropped, CASE WHEN kind = 'flush' THEN list_transform(buf, lambda b: {{'pos': b.pos, 'fate': 'flushed'}})
          WHEN fate IS NOT NULL THEN [{{'pos': pos, 'fate': fate}}] ELSE [] END)
      FROM (
        SELECT *, CASE WHEN kind = 'post' THEN CASE WHEN was AND (NOT article OR list_contains(seen, 'article:' || id)) AND NOT asks THEN 'duplicate'
          WHEN was AND NOT article THEN 'backfill' ELSE 'accepted' END END AS fate
        FROM (
          SELECT * REPLACE (list_filter(asked, lambda a: NOT list_contains(list_transform(gone, lambda b: b.id), a)) AS asked,
              list_filter(buf, lambda b: NOT list_contains(list_transform(list_concat(gone, older), lambda g: g.pos), b.pos)) AS buf),
            id IS NOT NULL AND list_contains(seen, id) AS was,
            id IS NOT NULL AND photo AND NOT list_contains(list_filter(asked, lambda a: NOT list_contains(list_transform(gone, lambda b: b.id), a)), id) AS asks,
            list_concat(list_transform(gone, lambda b: {{'pos': b.pos, 'fate': 'dropped-backfill'}}), list_transform(older, lambda b: {{'pos': b.pos, 'fate': 'dropped'}})) AS dropped
          FROM (
            SELECT *, list_slice(list_filter(buf, lambda b: NOT b.again), 1, over - len(gone)) AS older FROM (
              SELECT *, list_slice(list_filter(buf, lambda b: b.again), 1, over) AS gone FROM (
                SELECT m.*, CASE WHEN turn THEN list_slice(s.seen, greatest(1, len(s.seen) - {SEEN - 1}), len(s.seen)) ELSE s.seen END AS seen,
                  CASE WHEN turn THEN list_slice(s.asked, greatest(1, len(s.asked) - {SEEN - 1}), len(s.asked)) ELSE s.asked END AS asked, s.buf,
                  CASE WHEN turn THEN greatest(0, len(s.buf) - {BUFFERED}) ELSE 0 END AS over
                FROM (SELECT *, n + 1 AS due FROM steps) AS s JOIN msg AS m ON m.client = s.client AND m.n = s.due,
                  LATERAL (SELECT m.batch IS DISTINCT FROM s.batch AND s.n > 0 AS turn)))))))
    SELECT client, f.pos, f.fate FROM (SELECT client, unnest(fates) AS f FROM steps)""",
)
def client_memory(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each post that a client with a bounded memory sees."""
    return sequences.client_fates(sights(spark, d), backfill=True, most_seen=SEEN, most_buffered=BUFFERED)


# ---- staging log ------------------------------------------------------------------------------------


def staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, d)
    entries = e.where("event_type <> 'signup'").selectExpr("client", "e AS seq", "ms AS at", "e % 3 AS posts", "CASE WHEN e % 4 <> 0 THEN ms + (e % 7) * 3600000 + 1 END AS cleared")
    return entries, e.where("event_type = 'signup'").selectExpr("client", "e AS seq", "ms AS at", "e % 5 > 2 AS saved")


@query(
    "staging_recovery",
    f"""WITH e AS (
      SELECT user_id // {USERS} AS client, event_id AS seq, (epoch_us(ts) // 1000) AS ms, event_id % 3 AS posts,
        CASE WHEN event_id % 4 <> 0 THEN (epoch_us(ts) // 1000) + (event_id % 7) * 3600000 + 1 END AS cleared FROM events WHERE event_type <> 'signup'),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY client ORDER BY ms, seq) AS k FROM (
        SELECT user_id // {USERS} AS client, event_id AS seq, (epoch_us(ts) // 1000) AS ms, event_id % 5 > 2 AS saved FROM events WHERE event_type = 'signup')),
    met AS (
      SELECT e.client, e.seq, e.ms, e.posts, e.cleared, min(r.k) AS nx, min(r.k) FILTER (WHERE r.saved) AS sv, min(r.k) FILTER (WHERE r.ms > e.ms + {flows.STAGE_TTL_MS}) AS lt
      FROM e LEFT JOIN r ON r.client = e.client AND (r.ms > e.ms OR (r.ms = e.ms AND r.seq > e.seq)) GROUP BY ALL),
    fates AS (
      SELECT met.client, met.seq, met.ms,
        CASE WHEN met.cleared IS NOT NULL AND (nx IS NULL OR met.cleared <= r.ms) THEN 'handled' WHEN nx IS NULL THEN 'staged' WHEN nx = lt THEN 'expired'
          WHEN posts = 0 THEN 'empty' WHEN sv IS NULL AND lt IS NULL THEN 'staged' WHEN sv IS NULL OR lt <= sv THEN 'expired' ELSE 'recovered' END AS fate,
        nx, least(sv, lt) AS last
      FROM met LEFT JOIN r ON r.client = met.client AND r.k = met.nx)
    SELECT f.client, f.seq, f.fate, r.seq AS restart,
      CASE WHEN f.fate = 'recovered' THEN row_number() OVER (PARTITION BY f.client, r.seq, f.fate ORDER BY f.ms, f.seq) END AS place
    FROM fates AS f LEFT JOIN r ON r.client = f.client AND r.k = CASE f.fate WHEN 'empty' THEN nx WHEN 'expired' THEN last WHEN 'recovered' THEN last END""",
)
def staging_recovery(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each staged payload, and in which place a restart recovers it."""
    return flows.recovered(*staged(spark, d))


# ---- commits in dispatch order ------------------------------------------------------------------------


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    ordinal = "row_number() OVER (PARTITION BY client ORDER BY e) - 1"
    rows = _events(spark, d).selectExpr("client AS run", "e", f"cast({ordinal} AS long) AS ordinal", "(e + (e * 7919) % 2000) * 10000000 + e AS arrival")
    return rows.where("e % 997 <> 5").select("run", "ordinal", "arrival")


COMMIT_SQL = f"""WITH dealt AS (
  SELECT user_id // {USERS} AS run, event_id AS e, row_number() OVER (PARTITION BY user_id // {USERS} ORDER BY event_id) - 1 AS ordinal,
    (event_id + (event_id * 7919) % 2000) * 10000000 + event_id AS arrival FROM events),
gap AS (SELECT run, min(ordinal) AS first FROM dealt WHERE e % 997 = 5 GROUP BY run),
com AS (
  SELECT run, ordinal, arrival, CASE WHEN first IS NULL OR ordinal < first THEN max(arrival) OVER (PARTITION BY run ORDER BY ordinal) END AS released
  FROM dealt LEFT JOIN gap USING (run) WHERE e % 997 <> 5)"""


@query("ordered_commits", f"{COMMIT_SQL} SELECT run, ordinal, arrival, released FROM com")
def ordered_commits(spark: SparkSession, d: str) -> DataFrame:
    """With which arrival each outcome is committed, if outcomes are committed in dispatch order."""
    return flows.released(outcomes(spark, d))


@query(
    "commit_lanes",
    f"""{COMMIT_SQL}, waits AS (
      SELECT a.run, a.arrival, count(*) AS waiting FROM com AS a JOIN com AS b ON b.run = a.run AND b.arrival <= a.arrival AND (b.released IS NULL OR b.released >= a.arrival)
      GROUP BY a.run, a.arrival)
    SELECT run, count(*) AS arrived, count(released) AS committed, count(*) - count(released) AS stuck, max(waiting) AS peak
    FROM com JOIN waits USING (run, arrival) GROUP BY run""",
)
def commit_lanes(spark: SparkSession, d: str) -> DataFrame:
    """How full the reorder buffer of each run has been, and what is stuck behind a gap."""
    return flows.commit_lanes(flows.released(outcomes(spark, d)))


# ---- responses and requests ---------------------------------------------------------------------------


def network(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(
        "client", "e AS seq", "e % 2 AS tab", "concat('q', day(ts)) AS request",
        "CASE WHEN e % 61 = 0 THEN 'detached' WHEN event_type IN ('view', 'click', 'signup') THEN 'received' WHEN event_type = 'error' AND e % 2 = 0 THEN 'failed' ELSE 'finished' END AS kind",
        "CASE WHEN e % 5 <> 0 THEN concat('E', e % 3) END AS endpoint",
    )


@query(
    "response_bodies",
    f"""WITH net AS (
      SELECT user_id // {USERS} AS client, event_id AS seq, event_id % 2 AS tab, 'q' || day(ts) AS request,
        CASE WHEN event_id % 61 = 0 THEN 'detached' WHEN event_type IN ('view', 'click', 'signup') THEN 'received'
          WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'failed' ELSE 'finished' END AS kind,
        CASE WHEN event_id % 5 <> 0 THEN 'E' || (event_id % 3) END AS endpoint FROM events),
    own AS (SELECT * FROM net WHERE kind <> 'detached' AND (kind <> 'received' OR endpoint IS NOT NULL)),
    last AS (
      SELECT f.client, f.tab, f.request, f.seq AS finished, max(p.seq) AS before FROM own AS f
      JOIN own AS p ON p.client = f.client AND p.tab = f.tab AND p.request = f.request AND p.seq < f.seq WHERE f.kind = 'finished' GROUP BY ALL)
    SELECT l.client, l.tab, l.request, r.endpoint, r.seq AS received, l.finished FROM last AS l JOIN own AS r ON r.client = l.client AND r.seq = l.before AND r.kind = 'received'
    WHERE NOT EXISTS (SELECT 1 FROM net AS x WHERE x.kind = 'detached' AND x.client = l.client AND x.tab = l.tab AND x.seq > r.seq AND x.seq < l.finished)""",
)
def response_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose bodies are read, with the response that announced them."""
    return flows.paired(network(spark, d))
