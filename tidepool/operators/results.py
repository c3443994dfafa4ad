"""Results of labelling: replies, acceptance, the queue that facts fold to, events, costs, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators.order import numbered

MAX_FREE_LABELS = 5
_LABEL = "struct<name:string,evidence:array<struct<tweet_id:string,quote:string>>>"
REPLY = f"map<string,struct<preset_labels:array<{_LABEL}>,free_labels:array<{_LABEL}>>>"


def reply_units(content: Column) -> Column:
    """The units of a reply as a map; null if it is no reply: the text from the first brace to the last
    one must be an object of `units` alone, each with both lists of labels alone."""
    body = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.when(body != "", F.concat(F.lit("["), body, F.lit("]"))))  # in brackets, nothing may follow it
    units = F.try_variant_get(v, "$[0].units", REPLY)
    shapes = F.try_variant_get(v, "$[0].units", "map<string,map<string,variant>>")
    of_unit = lambda k, u: F.array_sort(F.map_keys(u)) == F.array(F.lit("free_labels"), F.lit("preset_labels"))
    strict = F.try_variant_get(v, "$[0]", "map<string,variant>")
    whole = (F.size(F.try_variant_get(v, "$", "array<variant>")) == 1) & (F.size(F.map_keys(strict)) == 1) & (F.size(F.map_filter(shapes, lambda k, u: ~of_unit(k, u))) == 0)
    few = F.size(F.map_filter(units, lambda k, u: u["preset_labels"].isNull() | u["free_labels"].isNull() | (F.size(u["free_labels"]) > MAX_FREE_LABELS))) == 0
    return F.when(whole & few, units)


def refreshed(units: DataFrame, known: DataFrame, results: DataFrame, contract: str) -> DataFrame:
    """unit_id, input_hash, status, attempts, first_queued_at, activity of units (unit_id, input_hash,
    activity) after they are registered again. known: the queue before (unit_id, input_hash,
    contract_hash, status, attempts, first_queued_at); results: current() ones. A unit with a current
    result is done; a new one waits; one whose input or contract changed starts anew; others stay as
    they are."""
    was = known.select("unit_id", *(F.col(c).alias(f"was_{c}") for c in ("input_hash", "contract_hash", "status", "attempts", "first_queued_at")))
    done = results.select("unit_id", F.lit(True).alias("has_result"))
    met = units.join(was, "unit_id", "left").join(done, "unit_id", "left")
    new = F.col("was_status").isNull()
    changed = (F.col("was_input_hash") != F.col("input_hash")) | (F.col("was_contract_hash") != contract)
    anew = new | changed
    return met.select(
        "unit_id", "input_hash",
        F.when(F.col("has_result"), "done").when(anew, "pending").otherwise(F.col("was_status")).alias("status"),
        F.when(F.col("has_result") | anew, 0).otherwise(F.col("was_attempts")).alias("attempts"),
        F.coalesce("was_first_queued_at", "activity").alias("first_queued_at"), "activity",
    )


def current(results: DataFrame, units: DataFrame, quotes: DataFrame, contract: str, taxonomy_version: int) -> DataFrame:
    """The result of each unit that counts. results: result_id, unit_id, post_ids, input_hash,
    contract_hash, taxonomy_version, enriched_at, pos. units: unit_id, input_hash, post_ids (sorted).
    quotes: result_id, verbatim (whether each quote stands in its post). A result counts if it is of
    this contract and taxonomy, covers just the unit's posts, has the hash of its input and quotes
    nothing that is not there; of several the newest counts, of equally new ones the first."""
    own = units.select("unit_id", F.col("input_hash").alias("now_hash"), F.col("post_ids").alias("now_ids"))
    false_ = quotes.where("not verbatim").select("result_id").distinct()
    ours = results.where((F.col("contract_hash") == contract) & (F.col("taxonomy_version") == taxonomy_version))
    met = ours.join(own, "unit_id").where((F.col("input_hash") == F.col("now_hash")) & (F.array_sort(F.array_distinct("post_ids")) == F.col("now_ids")))
    n = F.row_number().over(W.partitionBy("unit_id").orderBy(F.col("enriched_at").desc(), "pos"))
    return met.join(false_, "result_id", "left_anti").withColumn("n", n).where("n = 1").drop("n", "now_hash", "now_ids")


def accepted_presets(said: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """unit_id, kept (canonical names, sorted), discarded: of preset labels as said (unit_id, name, pos,
    verbatim) the first of each name that the taxonomy (a short list) has, in any case."""
    known = F.broadcast(taxonomy.select(F.lower("name").alias("key"), F.col("name").alias("canonical")))
    met = said.withColumn("key", F.lower(F.trim("name"))).join(known, "key", "left")
    good = F.col("canonical").isNotNull() & F.col("verbatim")
    return met.groupBy("unit_id").agg(
        F.array_sort(F.collect_set(F.when(good, F.col("canonical")))).alias("kept"),
        (F.count("*") - F.count_distinct(F.when(good, F.col("canonical")))).alias("discarded"),
    )


def accepted_free(said: DataFrame, presets: list[str], registry: DataFrame) -> DataFrame:
    """unit_id, kept (slugs, sorted), discarded: of free labels as said (unit_id, slug, ok, pos) the
    first five that the rules pass (ok), that are no preset, not rejected and not said before."""
    gone = registry.where("status = 'rejected'").select(F.col("name").alias("slug"), F.lit(True).alias("gone"))
    met = said.join(gone, "slug", "left").withColumn("good", F.col("ok") & F.col("gone").isNull() & ~F.col("slug").isin(presets))
    first = met.where("good").groupBy("unit_id", "slug").agg(F.min("pos").alias("pos"))
    n = F.row_number().over(W.partitionBy("unit_id").orderBy("pos"))
    kept = first.withColumn("n", n).where(F.col("n") <= MAX_FREE_LABELS).groupBy("unit_id").agg(F.array_sort(F.collect_set("slug")).alias("kept"))
    counts = met.groupBy("unit_id").agg(F.count("*").alias("n"))
    kept_or_none = F.coalesce("kept", F.array().cast("array<string>"))
    return counts.join(kept, "unit_id", "left").select("unit_id", kept_or_none.alias("kept"), (F.col("n") - F.size(kept_or_none)).alias("discarded"))


def registry_events(wanted: DataFrame, registry: DataFrame, at: str, contract: str, base: int) -> DataFrame:
    """name, status, at, contract_hash, registry_revision, reason, actor of the events that names (name,
    decision, reason, pos) lead to: a candidate for one that is not known, a promotion or rejection
    for a candidate. Revisions follow the base in order of pos."""
    known = registry.select("name", F.col("status").alias("known"))
    d, k = F.col("decision"), F.col("known")
    status = F.when((d == "observe") & k.isNull(), "candidate").when((k == "candidate") & d.isin("approve", "reject"), F.when(d == "approve", "approved").otherwise("rejected"))
    first = wanted.groupBy("name", "decision").agg(F.min_by("reason", "pos").alias("reason"), F.min("pos").alias("pos"))
    rows = first.join(known, "name", "left").withColumn("status", status).where("status is not null")
    reason = F.when(F.col("status") == "candidate", "first_observed").otherwise(F.col("reason"))
    return numbered(rows, ["pos", "name", "decision"], "registry_revision", base + 1).select(
        "name", "status", F.lit(at).alias("at"), F.lit(contract).alias("contract_hash"),
        "registry_revision", reason.alias("reason"), F.lit("worker").alias("actor"),
    )


def seeded(registry: DataFrame, names: list[str], at: str) -> DataFrame:
    """The registry with names rejected that it had not rejected itself."""
    spark = registry.sparkSession
    seeds = spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).withColumn("seed", F.lit(True))
    met = registry.join(seeds, "name", "full")
    take = F.col("seed").isNotNull() & (F.coalesce("status", F.lit("")) != "rejected")
    return met.select(
        "name", F.when(take, "rejected").otherwise(F.col("status")).alias("status"), F.coalesce("first_observed_at", F.lit(at)).alias("first_observed_at"),
        F.when(take, "seed:hard-rejected").alias("seed_reason"),
    )


def run_costs(calls: DataFrame, reservation: float | None) -> DataFrame:
    """run, calls, cost_usd (null: not measurable) of runs with a cost ceiling, from calls (run, ok,
    cost_usd): a call that failed is charged its reservation; one cost that is unknown makes the
    run's total unknown, whatever follows."""
    cost = F.when(F.col("ok"), F.col("cost_usd")).otherwise(F.lit(reservation).cast("double"))
    return calls.groupBy("run").agg(F.count("*").alias("calls"), F.when(~F.bool_or(cost.isNull()), F.sum(cost)).alias("cost_usd"))


def chain_faults(links: DataFrame, group: str, number: str = "sequence", own: str = "sha256", previous: str = "previous_sha256") -> DataFrame:
    """group, number, fault of the links of hash chains that do not follow the link before: gap (the
    numbers of a chain are 1, 2, ...), twice, or hash. A chain is checked by neighbours in order."""
    w = W.partitionBy(group).orderBy(number, own)
    before, digest = F.lag(number).over(w), F.lag(own).over(w)
    fault = (
        F.when(before == F.col(number), "twice").when(F.col(number) != F.coalesce(before, F.lit(0)) + 1, "gap")
        .when(~F.col(previous).eqNullSafe(digest), "hash")
    )
    return links.select(group, number, fault.alias("fault")).where("fault is not null")
