"""What an enrichment run checks before it goes on: outputs that no checkpoint knows, checkpoints
against their neighbours, and what a compacted copy of the pool needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- orphan outputs ------------------------------------------------------------------------


def reached(chain: DataFrame, frontiers: DataFrame) -> DataFrame:
    """run, kind, file of the outputs that a checkpoint's frontier (run, kind, sequence, sha) reaches: those of
    the chain (run, kind, sequence, file, before, sha) from the frontier back to its first broken link. A
    frontier whose own entry has another digest reaches nothing."""
    by_kind = W.partitionBy("run", "kind").orderBy("sequence")
    ends = frontiers.select("run", "kind", F.col("sequence").alias("end"), F.col("sha").alias("end_sha"))
    rows = chain.join(ends, ["run", "kind"]).where("sequence <= end")
    linked = (F.lag("sha").over(by_kind) == F.col("before")) & (F.lag("sequence").over(by_kind) == F.col("sequence") - 1)
    rows = rows.withColumn("start", ~F.coalesce(linked, F.lit(False)))
    whole = W.partitionBy("run", "kind")
    rows = rows.withColumn("first", F.max(F.when(F.col("start"), F.col("sequence"))).over(whole)).withColumn(
        "meets", F.max((F.col("sequence") == F.col("end")) & (F.col("sha") == F.col("end_sha"))).over(whole)
    )
    return rows.where("meets and sequence >= first").select("run", "kind", "file")


def orphans(files: DataFrame, known: DataFrame, reached: DataFrame) -> DataFrame:
    """Files of a listing that are neither sources of the run nor outputs that a checkpoint reaches."""
    return files.join(known.select("file"), "file", "left_anti").join(reached.select("file"), "file", "left_anti")


#: Output kinds by path; other paths below the first are results, all others nothing.
OUTPUTS = {"attempt": "enrichment/attempts/", "registry": "enrichment/registry/", "receipt": "enrichment/receipts/", "queue": "enrichment/"}


def output_kind(path: Column) -> Column:
    return F.coalesce(*(F.when(path.startswith(prefix), kind) for kind, prefix in OUTPUTS.items()))


def routed(lines: DataFrame, identities: DataFrame, names: DataFrame, contract_hash: str, next_ordinal: int = 0) -> DataFrame:
    """file, kind, item, fault of the appended lines (file, path, unit_id, name, outcome, input_hash,
    contract_hash, taxonomy_version) of orphan files, each item once. Successful units, attempts without
    success and decisions on names that the plan (name, ordinal) has not passed yet are outputs, as is a
    receipt of the contract; lines of units or names that the run does not have are left out. A line
    that contradicts the frozen identity of its unit (unit_id, input_hash, contract_hash,
    taxonomy_version), or the contract, is a fault, and its file gives nothing else."""
    rows = lines.withColumn("kind", output_kind(F.col("path"))).where("kind is not null")
    own = identities.select("unit_id", F.col("input_hash").alias("i"), F.col("contract_hash").alias("c"), F.col("taxonomy_version").alias("t"))
    left = names.where(F.col("ordinal") >= next_ordinal).select("name", F.lit(True).alias("open"))
    rows = rows.join(own, "unit_id", "left").join(left, "name", "left")
    kind, differs = F.col("kind"), (F.col("input_hash") != F.col("i")) | (F.col("contract_hash") != F.col("c"))
    is_unit = kind.isin("attempt", "queue") & F.col("i").isNotNull()
    fault = (
        F.when(is_unit & (differs | ((kind == "queue") & (F.col("taxonomy_version") != F.col("t")))), F.concat(kind, F.lit(" differs from its unit")))
        .when((kind == "registry") & (F.col("contract_hash") != contract_hash), "decision of another contract")
    )
    item = (
        F.when(is_unit & ((kind == "queue") | (F.col("outcome") != "success")), F.col("unit_id"))
        .when((kind == "registry") & F.col("open"), F.col("name"))
        .when((kind == "receipt") & (F.col("contract_hash") == contract_hash), F.lit("receipt"))
    )
    out = rows.select("file", "kind", item.alias("item"), fault.alias("fault")).where("item is not null or fault is not null")
    out = out.withColumn("item", F.when(F.col("fault").isNull(), F.col("item"))).distinct()
    faulty = out.where("fault is not null").select("file").distinct()
    return out.where("fault is null").join(faulty, "file", "left_anti").unionByName(out.where("fault is not null"))


# ---- checkpoints ---------------------------------------------------------------------------

#: Bits of a word of a completion bitmap.
WORD = 62
WITH_DATABASE = ("uploaded", "verified", "published")


def checkpoint_faults(states: DataFrame, words: DataFrame, unresolved: DataFrame) -> DataFrame:
    """run, sequence, fault of checkpoints that contradict themselves or the one before them.

    states: run, sequence, plan, total, done, next_name, names, publication, has_database. words: run,
    sequence, word, bits: the completion bitmap, WORD ordinals a row, so that no bitmap is one value.
    unresolved: run, sequence, ordinal of items that are retried or blocked."""
    by_run = W.partitionBy("run").orderBy("sequence")
    before = {f"was_{c}": F.lag(c).over(by_run) for c in ("sequence", "plan", "next_name")}
    was = lambda c: F.col(f"was_{c}")
    later = was("sequence").isNotNull()
    own = states.withColumns(before).select(
        "run", "sequence",
        F.explode(F.array_compact(F.array(
            F.when(later & (was("sequence") != F.col("sequence") - 1), "sequence"), F.when(later & (was("plan") != F.col("plan")), "plan"),
            F.when((F.col("next_name") > F.col("names")) | (later & (F.col("next_name") < was("next_name"))), "cursor"),
            F.when(F.col("publication").isin(*WITH_DATABASE) != F.col("has_database"), "publication"),
        ))).alias("fault"),
    )
    sums = words.groupBy("run", "sequence").agg(F.sum(F.bit_count("bits")).alias("set"), F.count("*").alias("n"), F.max("word").alias("last"))
    met = states.join(sums, ["run", "sequence"], "left")
    length = F.ceil(F.col("total") / WORD)
    bitmap = met.select(
        "run", "sequence",
        F.explode(F.array_compact(F.array(
            F.when((F.coalesce("n", F.lit(0)) != length) | (F.coalesce("last", F.lit(-1)) != length - 1), "bitmap length"),
            F.when(F.coalesce("set", F.lit(0)) != F.col("done"), "bitmap count"),
        ))).alias("fault"),
    )
    before = F.lag("bits").over(W.partitionBy("run", "word").orderBy("sequence"))
    lost = words.withColumn("gone", F.bitwise_not(F.col("bits")).bitwiseAND(before)).where("gone <> 0").select("run", "sequence", F.lit("completed ordinal is open again").alias("fault"))
    items = unresolved.groupBy("run", "sequence", "ordinal").agg(F.count("*").alias("n")).withColumn("word", F.floor(F.col("ordinal") / WORD))
    items = items.join(words, ["run", "sequence", "word"], "left")
    done = F.expr(f"coalesce(shiftright(bits, cast(ordinal % {WORD} AS int)) & 1, 0)")
    open_ = items.select("run", "sequence", F.explode(F.array_compact(F.array(F.when(done == 1, "completed ordinal is unresolved"), F.when(F.col("n") > 1, "ordinal is unresolved twice")))).alias("fault"))
    return reduce(DataFrame.unionByName, (own, bitmap, lost, open_)).distinct()


# ---- compaction ----------------------------------------------------------------------------


def compacted(tables: dict[str, DataFrame], open_units: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """members, captures, results, assignments, evidence, queue of a copy that holds what a run needs:
    units that are not done, and those with a free label of the plan. What depends on a unit, post or label
    that goes, goes with it."""
    assignments, names = tables["assignments"], names.select("name").distinct()
    planned = assignments.where("kind = 'free'").join(names, "name", "left_semi").select("unit_id")
    keep = open_units.select("unit_id").union(planned).distinct()
    held = lambda name, by=keep, on="unit_id": tables[name].join(by, on, "left_semi").select(tables[name].columns)
    labels = lambda name: held(name).where("kind <> 'free'").unionByName(held(name).where("kind = 'free'").join(names, "name", "left_semi").select(tables[name].columns))
    members = held("members")
    return {
        "members": members, "captures": held("captures", members.select("id"), "id"), "results": held("results"),
        "assignments": labels("assignments"), "evidence": labels("evidence"), "queue": held("queue", open_units.select("unit_id").distinct()),
    }


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows: rows of compacted() whose unit, post or label is not there; none in a whole copy."""
    members, assignments = tables["members"], tables["assignments"]
    gone = {
        "captures": tables["captures"].join(members, "id", "left_anti"), "results": tables["results"].join(members, "unit_id", "left_anti"),
        "assignments": assignments.join(members, "unit_id", "left_anti"), "evidence": tables["evidence"].join(assignments, ["unit_id", "name", "kind"], "left_anti"),
        "queue": tables["queue"].join(members, "unit_id", "left_anti"),
    }
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, rows in gone.items()]
    return reduce(DataFrame.unionByName, counts).where("rows > 0")
