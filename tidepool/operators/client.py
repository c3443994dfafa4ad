"""Folds that a capturing client makes: what it lets through, receipts, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators.order import numbered


def first_seen(captures: DataFrame, backfill: Column | None = None) -> DataFrame:
    """Captures (id, is_article, replay_pos) that pass: the first of each post; the first
    article of a post, even if it was seen before; with `backfill`, once more the first
    capture of a post that the condition holds for."""
    by_id = W.partitionBy("id").orderBy("replay_pos")
    rows = captures.withColumn("__n", F.row_number().over(by_id)).withColumn(
        "__m", F.row_number().over(W.partitionBy("id", "is_article").orderBy("replay_pos"))
    )
    passes = (F.col("__n") == 1) | (F.col("is_article") & (F.col("__m") == 1)) | F.col("id").isNull()
    if backfill is not None:
        before = F.coalesce(F.sum(backfill.cast("int")).over(by_id.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("__b", before)
        passes = passes | (backfill & (F.col("__b") == 0))
    return rows.where(passes).drop("__n", "__m", "__b")


def receipts(seen: DataFrame) -> DataFrame:
    """list_id, id, pos, sequence of the first sight (pos) of each post in each list. Numbers
    grow with pos over all lists, by list and id where it is the same."""
    first = seen.groupBy("list_id", "id").agg(F.min("pos").alias("pos"))
    return numbered(first, ["pos", "list_id", "id"], "sequence")


def observations(sights: DataFrame, known: DataFrame, baseline: int) -> DataFrame:
    """run_id, pos, id, cursor, known_before of the posts that runs (run_id, list_id) saw."""
    met = sights.join(known.select("list_id", "id", "sequence"), ["list_id", "id"])
    cursor = F.row_number().over(W.partitionBy("run_id").orderBy("pos"))
    return met.select("run_id", "pos", "id", cursor.alias("cursor"), (F.col("sequence") <= baseline).alias("known_before"))
