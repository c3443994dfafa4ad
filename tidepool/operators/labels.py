"""Labels: counts over eligible units, details, co-occurrence, lifecycle decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELATED_LIMIT = 50
MAX_NODES, MAX_LINKS = 10_000, 100_000


class TooLarge(Exception):
    """A complete graph beyond the export limit."""


def preset_counts(assignments: DataFrame, eligible: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Eligible units of each preset label, zero for those without any."""
    own = assignments.where("kind = 'preset'").join(eligible, "unit_id", "left_semi")
    counts = own.groupBy("name").agg(F.countDistinct("unit_id").alias("n"))
    return taxonomy.join(counts, "name", "left").select("name", "description", F.coalesce("n", F.lit(0)).alias("units"))


def with_presets(units: DataFrame, assignments: DataFrame, names: list[str], every: bool = False) -> DataFrame:
    """Units with any of the preset labels, or with every one: then as many must be there as are named,
    so a list that names one twice holds for no unit."""
    if not names:
        return units
    own = assignments.where("kind = 'preset'").where(F.col("name").isin(names))
    found = own.groupBy("unit_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= (len(names) if every else 1))
    return units.join(found.select("unit_id"), "unit_id", "left_semi")


def approved_pairs(assignments: DataFrame, eligible: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct (unit_id, name) of approved free labels on eligible units."""
    own = assignments.where("kind = 'free'").select("unit_id", "name").distinct()
    return own.join(eligible, "unit_id", "left_semi").join(registry.where("status = 'approved'"), "name", "left_semi").select("unit_id", "name")


def free_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("name").agg(F.count("*").alias("units"))


def related(pairs: DataFrame, name: str | DataFrame, limit: int = RELATED_LIMIT) -> DataFrame:
    """Labels that share units with one label: a name, or a single row of a column `wanted`."""
    if isinstance(name, str):
        marked = pairs.withColumn("wanted", F.lit(name))
    else:
        marked = pairs.join(F.broadcast(name))  # one row
    own = marked.where("name = wanted").select("unit_id")
    others = marked.where("name <> wanted").join(own, "unit_id", "left_semi")
    return others.groupBy("name").agg(F.count("*").alias("shared")).orderBy(F.col("shared").desc(), "name").limit(limit)


def links(pairs: DataFrame) -> DataFrame:
    """source < target, weight: units that two labels share. A unit has a handful of labels
    at most, so the pairs of a unit are few; they are made within its row, without a join."""
    of_unit = pairs.groupBy("unit_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    pair = F.expr(
        "explode(flatten(transform(names, (a, i) -> transform(slice(names, i + 2, size(names)), b -> named_struct('source', a, 'target', b)))))"
    )
    return of_unit.select(pair.alias("l")).groupBy("l.source", "l.target").agg(F.count("*").alias("weight"))


def top_nodes(pairs: DataFrame, top: int) -> DataFrame:
    return free_counts(pairs).orderBy(F.col("units").desc(), "name").limit(top)


def top_links(pairs: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """Links among the top nodes (at most MAX_NODES names, so they are sent to the rows)."""
    names = F.broadcast(nodes.select("name").limit(MAX_NODES))
    return links(pairs.join(names, "name", "left_semi")).orderBy(F.col("weight").desc(), "source", "target").limit(4 * top)


def complete(df: DataFrame, most: int) -> DataFrame:
    """df, unless it has more rows than may be exported."""
    if df.limit(most + 1).count() > most:
        raise TooLarge(f"more than {most} rows")
    return df


def visible(assignments: DataFrame, evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """Assignments that may be shown, with their evidence: presets, and approved free labels."""
    said = evidence.groupBy("unit_id", "name", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("post_id")), ",").alias("post_ids"), F.count("*").alias("n_quotes")
    )
    status = registry.select("name", F.lit("free").alias("kind"), "status")
    met = assignments.join(said, ["unit_id", "name", "kind"], "left").join(status, ["name", "kind"], "left")
    shown = met.where((F.col("kind") == "preset") | (F.col("status") == "approved"))
    return shown.select("unit_id", "name", "kind", F.coalesce("post_ids", F.lit("")).alias("post_ids"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"))


def signals(assignments: DataFrame, evidence: DataFrame, posts: DataFrame) -> DataFrame:
    """name, units, authors, days, surfaces: what promotion looks at, for free labels. posts:
    unit_id, author_id, day. One aggregate for all names."""
    own = assignments.where("kind = 'free'").select("unit_id", "name")
    counts = own.join(posts, "unit_id").groupBy("name").agg(
        F.countDistinct("unit_id").alias("units"), F.countDistinct("author_id").alias("authors"), F.countDistinct("day").alias("days")
    )
    slug = F.regexp_replace(F.lower("quote"), "[^a-z0-9]+", "-")
    seen = evidence.groupBy("name").agg(F.bool_or(F.contains(slug, F.col("name"))).alias("surfaces"))
    return counts.join(seen, "name", "left").withColumn("surfaces", F.coalesce("surfaces", F.lit(False)))


def quotes(evidence: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """name, unit_id, post_id, quote, n: the first `most` quotes of each free label of `names`, by unit, post
    and quote. Each task keeps as many of a name before rows travel, so no name gathers all of its own."""
    own = evidence.where("kind = 'free'").join(names.select("name"), "name", "left_semi")
    n = F.row_number().over(W.partitionBy("name").orderBy("unit_id", "post_id", "quote"))
    return own.withColumn("n", n).where(F.col("n") <= most).select("name", "unit_id", "post_id", "quote", "n")


def age_days(now, first_observed_at):
    """Days, with their parts, since a name was first seen; never less than 0."""
    milliseconds = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (milliseconds(now) - milliseconds(first_observed_at)) / 86_400_000)


def decisions(candidates: DataFrame, stale_days: int = 30) -> DataFrame:
    """name, decision of candidates (units, authors, days, surfaces, age_days, hub, verdict):
    stale ones go; those that appear in their evidence need 5 units, 3 authors and 2 days;
    verified ones are approved; others with 15, 8 and 2 go by the review's verdict."""
    enough = lambda u, a, d: (F.col("units") >= u) & (F.col("authors") >= a) & (F.col("days") >= d)
    surfaced = F.when(enough(5, 3, 2), "surface-evidence-threshold").otherwise("reviewed-no-transition")
    reviewed = F.when(F.col("verdict"), "constrained-review-approved").when(~F.col("verdict"), "constrained-review-rejected")
    return candidates.select(
        "name",
        F.coalesce(
            F.when(F.col("age_days") >= stale_days, "stale-below-threshold").when(F.col("surfaces"), surfaced)
            .when(F.col("hub"), "verified-hub-reference").when(enough(15, 8, 2), reviewed),
            F.lit("reviewed-no-transition"),
        ).alias("decision"),
    )


_REPLAYED = "name string, status string, first_observed_at string, updated_at string, reason string"


def _folded(frame):
    """The chain of one contract, event by event."""
    import pandas as pd

    state: dict[str, list] = {}
    revision = 0
    for e in frame.sort_values("pos").itertuples():
        old = state.get(e.name)
        was = old[1] if old else None
        legal = e.status in ("candidate", "rejected") if was is None else was == "candidate" or (was == "approved" and e.status == "rejected")
        if e.revision != revision + 1 or not legal:
            continue
        revision = e.revision
        state[e.name] = [e.name, e.status, old[2] if old else e.at, e.at, e.reason]
    return pd.DataFrame(list(state.values()), columns=["name", "status", "first_observed_at", "updated_at", "reason"])


def replay_registry(events: DataFrame, contract: str) -> DataFrame:
    """name, status, first_observed_at, updated_at, reason after a chain of events
    (name, status, at, contract_hash, revision, reason, pos). In order of pos, an event applies if it
    has the next revision, the contract, and a legal transition: nothing to candidate or rejected,
    candidate to any, approved to rejected; one that doesn't, leaves the revision.

    Revisions are given out under a lock, so each has one event. Then the chain ends at the first one
    that is missing, comes before its predecessor or is not legal. Legality is judged by name; the end
    is one number; what is before it is folded by name, so no task holds the chain. Only where a fault
    gave several events one revision, which of them applies depends on all before, and one task folds
    the chain, with the same result."""
    own = events.where(F.col("contract_hash") == contract)
    if not own.groupBy("revision").count().where("count > 1").isEmpty():
        return own.groupBy("contract_hash").applyInPandas(_folded, _REPLAYED)
    chain = own.where("revision >= 1")
    was = F.lag("status").over(W.partitionBy("name").orderBy("revision"))
    legal = F.when(was.isNull(), F.col("status").isin("candidate", "rejected")).otherwise((was == "candidate") | ((was == "approved") & (F.col("status") == "rejected")))
    before = chain.select((F.col("revision") + 1).alias("revision"), F.col("pos").alias("before"))
    judged = chain.withColumn("legal", legal).join(before, "revision", "left")
    # a chain has its first gap before the first revision whose predecessor is missing
    ends = judged.where("not legal or before > pos or (before is null and revision > 1)").agg(F.coalesce(F.min("revision"), F.lit(1 << 62)).alias("end"))
    applied = judged.join(F.broadcast(ends)).where(F.col("revision") < F.col("end"))  # one row
    last = lambda c: F.max_by(c, "revision")
    return applied.groupBy("name").agg(
        last("status").alias("status"), F.min_by("at", "revision").alias("first_observed_at"), last("at").alias("updated_at"), last("reason").alias("reason")
    )
