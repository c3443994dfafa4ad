"""The labelling queue: depth, claims, replayed attempts, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ATTEMPTS = 5
STATUSES = ("pending", "running", "retrying", "done", "blocked")


def eligible(queue: DataFrame) -> DataFrame:
    return queue.where((F.col("status") == "done") & F.col("fresh")).select("unit_id")


def depth(queue: DataFrame) -> DataFrame:
    return queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def status_counts(queue: DataFrame) -> DataFrame:
    """Counts by status, the oldest unit that waits, the latest activity."""
    waiting = F.when(F.col("status").isin("pending", "running", "retrying"), F.col("first_queued_at"))
    return queue.agg(
        F.count("*").alias("units"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        F.min(waiting).alias("oldest_waiting"), F.max("activity").alias("latest_activity"),
    )


def complete_through(queue: DataFrame) -> DataFrame:
    """The latest activity of done units before that of any unit that isn't done; with all
    done the latest one; with none done null. Two scalars: the first is sent to the rows."""
    bar = queue.agg(F.min(F.when(F.col("status") != "done", F.col("activity"))).alias("bar"))
    done = queue.where("status = 'done'").select("activity")
    met = done.join(F.broadcast(bar), F.col("bar").isNull() | (F.col("activity") < F.col("bar")))
    return met.agg(F.max("activity").alias("complete_through"))


def claim(queue: DataFrame, size: int) -> DataFrame:
    """unit_id, position of a fair page: the newest half (one at least; none of a page of
    one), then the longest queued, then the newest that are left. Three top-k selections."""
    open_ = queue.where(F.col("status").isin("pending", "retrying")).select("unit_id", "activity", "first_queued_at")
    newest = [F.col("activity").desc(), F.col("unit_id")]
    n = 0 if size == 1 else max(1, size // 2)
    first = open_.orderBy(*newest).limit(n).withColumn("part", F.lit(0))
    rest = open_.join(F.broadcast(first.select("unit_id")), "unit_id", "left_anti")  # a page, so small
    old = rest.orderBy("first_queued_at", "unit_id").limit(size - n).withColumn("part", F.lit(1))
    both = first.unionByName(old)
    order = W.orderBy(
        "part", F.when(F.col("part") == 0, F.col("activity")).desc(), F.when(F.col("part") == 1, F.col("first_queued_at")), "unit_id"
    )
    return both.withColumn("position", F.row_number().over(order)).select("unit_id", "position")


def replay_attempts(queue: DataFrame, attempts: DataFrame) -> DataFrame:
    """unit_id, attempts, status after attempt events. Failures apply while their number
    grows; a dispatch without an outcome leaves the unit retrying, without counting."""
    w = W.partitionBy("unit_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    open_ = queue.where("status <> 'done'").select("unit_id", F.col("attempts").alias("before"), F.col("status").alias("was"))
    met = attempts.where("matches and outcome <> 'success'").join(open_, "unit_id")
    counted = F.when(F.col("outcome") != "dispatched", F.col("attempt"))
    reached = F.greatest(F.col("before"), F.coalesce(F.max(counted).over(w), F.lit(0)))
    applied = met.withColumn("reached", reached).where("outcome = 'dispatched' or attempt > reached")
    after = applied.groupBy("unit_id").agg(
        F.max(F.when(F.col("outcome") != "dispatched", F.col("attempt"))).alias("a"),
        F.max_by(F.struct("outcome", "attempt"), "seq").alias("last"),
    )
    status = (
        F.when(F.col("last.outcome") == "dispatched", "retrying")
        .when((F.col("last.attempt") >= MAX_ATTEMPTS) | (F.col("last.outcome") == "blocked"), "blocked")
        .when(F.col("last").isNotNull(), "retrying").otherwise(F.col("was"))
    )
    return open_.join(after, "unit_id", "left").select(
        "unit_id", F.coalesce("a", "before").alias("attempts"), status.alias("status")
    )


def recent_errors(attempts: DataFrame, window: int = 100) -> DataFrame:
    """Error classes of the newest failures."""
    failed = attempts.where("outcome in ('transient_failure', 'blocked')")
    newest = failed.orderBy(F.col("seq").desc()).limit(window)
    return newest.groupBy("error_class").agg(F.count("*").alias("n"), F.max("at").alias("latest"))


def backoff_ms(attempt: Column, error_class: Column) -> Column:
    """Wait after a failed attempt, without jitter: 30 s doubled up to 30 min; a day for
    repeated commit or output failures."""
    base = F.least(F.lit(1_800_000.0), 30_000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    stuck = error_class.isin("commit_failed", "invalid_output") & (attempt >= MAX_ATTEMPTS)
    return F.when(stuck, F.lit(86_400_000)).otherwise(base).cast("long")


def failed(units: DataFrame, at_once: Column) -> DataFrame:
    """units (unit_id, attempts) after a failure: one attempt more, blocked at MAX_ATTEMPTS or at once,
    else retrying; without a lease."""
    n = F.col("attempts") + 1
    status = F.when(at_once | (n >= MAX_ATTEMPTS), "blocked").otherwise("retrying")
    return units.select("unit_id", n.alias("attempts"), status.alias("status"), F.lit(None).cast("string").alias("lease_owner"))


def released(queue: DataFrame, which: Column) -> DataFrame:
    """The running units of a queue that `which` holds for, as they wait again: retrying if they were
    tried before, else pending."""
    status = F.when(F.col("attempts") > 0, "retrying").otherwise("pending")
    return queue.where("status = 'running'").where(which).select("unit_id", "attempts", status.alias("status"))


def recovered(queue: DataFrame, now_ms: int) -> DataFrame:
    """A queue (with lease_owner, lease_expires in ms) whose running units wait again where their lease
    ended before now; a unit that runs without a lease stays."""
    over = F.coalesce((F.col("status") == "running") & (F.col("lease_expires") < now_ms), F.lit(False))
    waits = F.when(F.col("attempts") > 0, "retrying").otherwise("pending")
    keep = lambda c: F.when(~over, F.col(c)).alias(c)
    return queue.withColumns({"status": F.when(over, waits).otherwise(F.col("status")), "lease_owner": keep("lease_owner"), "lease_expires": keep("lease_expires")})


def leased(queue: DataFrame, size: int, worker: str, now_ms: int, lease_ms: int) -> DataFrame:
    """A queue in which a worker runs the units of a fair page, each until its lease ends."""
    page = claim(queue, size).select(F.col("unit_id").alias("__claimed"))
    met = queue.join(F.broadcast(page), F.col("unit_id") == F.col("__claimed"), "left")  # a page
    now = lambda c, value: F.when(F.col("__claimed").isNotNull(), F.lit(value)).otherwise(F.col(c))
    return met.withColumns({"status": now("status", "running"), "lease_owner": now("lease_owner", worker), "lease_expires": now("lease_expires", now_ms + lease_ms)}).drop("__claimed")


def handed_back(queue: DataFrame, worker: str | None = None, units: list[str] | None = None) -> DataFrame:
    """A queue whose running units, of a worker or of a list if these are given, wait again."""
    which = F.col("status") == "running"
    if worker is not None:
        which &= F.coalesce(F.col("lease_owner") == worker, F.lit(False))
    if units:
        which &= F.col("unit_id").isin(units)
    waits = F.when(F.col("attempts") > 0, "retrying").otherwise("pending")
    gone = lambda c: F.when(~which, F.col(c))
    return queue.withColumns({"status": F.when(which, waits).otherwise(F.col("status")), "lease_owner": gone("lease_owner"), "lease_expires": gone("lease_expires")})


def receipt_rates(receipts: DataFrame) -> DataFrame:
    """Receipts with error_rate (of units and failures together) and discarded_per_unit; 0 of none."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    done = F.col("units") + F.col("failures")
    return receipts.withColumns({"error_rate": share(F.col("failures"), done), "discarded_per_unit": share(F.col("discarded"), F.col("units"))})
