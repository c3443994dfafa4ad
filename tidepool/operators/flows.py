"""Folds of ordered facts that windows express: recovery of a staging log, commits in dispatch order,
responses and their requests. All are kept by a client, a run or a request, so nothing is ordered
over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAGE_TTL_MS = 24 * 60 * 60 * 1000


def recovered(entries: DataFrame, restarts: DataFrame, ttl_ms: int = STAGE_TTL_MS) -> DataFrame:
    """client, seq, fate, restart, place of staged entries (client, seq, at, posts, cleared: when the
    normal way cleared it, or null) after restarts (client, seq, at, saved) of their clients.

    A restart goes through what its client has staged, in order of (at, seq): what is older than the
    time to live is dropped (`expired`), what holds no posts goes too (`empty`), the rest is
    `recovered` if the restart could save its state, and else stays for the next one. An entry that was
    cleared before any restart is `handled`; one that none has settled is `staged`. place numbers what a
    restart recovers. For each entry three moments are dealt into its client's restarts (when it was
    staged, and when its time is over), and a window hands each the next restart from behind."""
    moment = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.lit(True).alias("asks"))
    asks = entries.select(
        "client", F.col("seq").alias("entry"), F.explode(F.array(moment("staged", F.col("at")), moment("over", F.col("at") + ttl_ms))).alias("m"),
        F.col("seq").alias("own"),
    ).select("client", "entry", "m.kind", "m.at", F.when(F.col("m.kind") == "staged", F.col("own")).otherwise(F.lit((1 << 63) - 1)).alias("seq"))
    rows = asks.unionByName(restarts.select("client", F.lit("restart").alias("kind"), "at", "seq", "saved"), allowMissingColumns=True)
    behind = W.partitionBy("client").orderBy(F.col("at").desc(), F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    restart = F.struct("at", "seq")
    is_restart = F.col("kind") == "restart"
    rows = rows.select(
        "client", "entry", "kind", F.last(F.when(is_restart, restart), True).over(behind).alias("next"),
        F.last(F.when(is_restart & F.col("saved"), restart), True).over(behind).alias("saving"),
    ).where("entry is not null")
    of = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    met = rows.groupBy("client", "entry").agg(of("staged", "next").alias("next"), of("staged", "saving").alias("saving"), of("over", "next").alias("late"))
    out = entries.join(met.withColumnRenamed("entry", "seq"), ["client", "seq"])
    last = F.least("saving", "late")  # nulls are left out
    fate = (
        F.when(F.col("cleared").isNotNull() & (F.col("next").isNull() | (F.col("cleared") <= F.col("next.at"))), "handled")
        .when(F.col("next").isNull(), "staged")
        .when(F.col("next") == F.col("late"), "expired").when(F.col("posts") == 0, "empty")
        .when(last.isNull(), "staged").when(last == F.col("late"), "expired").otherwise("recovered")
    )
    settled = F.when(F.col("fate") == "empty", F.col("next.seq")).when(F.col("fate").isin("expired", "recovered"), last["seq"])
    out = out.withColumn("fate", fate).withColumn("restart", settled)
    place = F.row_number().over(W.partitionBy("client", "restart", "fate").orderBy("at", "seq"))
    return out.select("client", "seq", "fate", "restart", F.when(F.col("fate") == "recovered", place).alias("place"))


def released(outcomes: DataFrame) -> DataFrame:
    """run, ordinal, arrival, released of outcomes (run, ordinal from 0, arrival: distinct numbers of a
    run): an outcome is committed when all of its run with smaller ordinals have arrived, so at the
    latest arrival among them; one behind a gap has none. Of an ordinal that arrives again the first
    counts."""
    first = outcomes.groupBy("run", "ordinal").agg(F.min("arrival").alias("arrival"))
    ahead = W.partitionBy("run").orderBy("ordinal")
    whole = F.row_number().over(ahead) == F.col("ordinal") + 1  # all before it are there
    return first.select("run", "ordinal", "arrival", F.when(whole, F.max("arrival").over(ahead)).alias("released"))


def commit_lanes(rows: DataFrame) -> DataFrame:
    """run, arrived, committed, stuck, peak (the most that waited at once, behind a gap or for their
    turn) of rows of released()."""
    steps = rows.select("run", F.col("arrival").alias("at"), F.lit(1).alias("held")).unionByName(
        rows.where("released is not null").select("run", F.col("released").alias("at"), F.lit(-1).alias("held"))
    )
    waiting = F.sum("held").over(W.partitionBy("run").orderBy("at", F.col("held").desc()).rowsBetween(W.unboundedPreceding, 0))
    peaks = steps.withColumn("waiting", waiting).groupBy("run").agg(F.max("waiting").alias("peak"))
    sums = rows.groupBy("run").agg(F.count("*").alias("arrived"), F.count("released").alias("committed"), (F.count("*") - F.count("released")).alias("stuck"))
    return sums.join(peaks, "run")


def paired(events: DataFrame) -> DataFrame:
    """client, tab, request, endpoint, received, finished (numbers of the events) of network events
    (client, seq, tab, request, kind, endpoint): a body is read when a request finishes whose response
    was announced with a known endpoint, did not fail, and whose tab was not detached in between. A
    response that is announced again counts once, as last announced; one that has finished is gone."""
    known = events.where("kind <> 'received' or endpoint is not null")
    by_tab = W.partitionBy("client", "tab").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    known = known.withColumn("detached", F.max(F.when(F.col("kind") == "detached", F.col("seq"))).over(by_tab)).where("kind <> 'detached'")
    of_request = W.partitionBy("client", "tab", "request").orderBy("seq")
    before = F.lag(F.struct("kind", "seq", "endpoint")).over(of_request)
    pairs = known.withColumn("before", before).where("kind = 'finished' and before.kind = 'received' and (detached is null or detached < before.seq)")
    return pairs.select("client", "tab", "request", "before.endpoint", F.col("before.seq").alias("received"), F.col("seq").alias("finished"))
