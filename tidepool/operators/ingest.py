"""Ingest of posts: JSON lines in, envelopes, attribution, daily files, imports of old files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import paths
from tidepool.operators.captures import reject_reason
from tidepool.operators.order import numbered

#: Posts of one envelope.
LEAST, MOST = 1, 1000
_POST = {
    "id": "$.id", "url": "$.url", "text": "$.text", "captured_at": "$.captured_at", "created_at": "$.created_at",
    "username": "$.author.username", "contributed_by": "$.contributed_by", "pooled_at": "$.pooled_at",
}


class BadSource(ValueError):
    """A source with a line that is no record."""


class BadEnvelope(ValueError):
    """An envelope of no posts, or of too many."""


def parsed(lines: DataFrame) -> DataFrame:
    """path, line_n, line with the fields of a post and `reason`: why the line is none (json: it can't
    be read). Blank lines are left out. A line is read once, as a variant."""
    rows = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    rows = rows.select("path", "line_n", "line", "v", *(F.try_variant_get("v", at, "string").alias(c) for c, at in _POST.items()))
    return rows.withColumn("reason", F.when(F.col("v").isNull(), "json").otherwise(reject_reason())).drop("v")


def posts(lines: DataFrame) -> DataFrame:
    """The posts of daily files; lines that are none are skipped. Who contributed a post is said by
    itself, else by its path; when it was pooled by itself, else by its capture."""
    by_path = F.split("path", "/").getItem(1)
    return parsed(lines).where("reason is null").drop("reason").withColumns({
        "contributed_by": F.coalesce(F.when(F.col("contributed_by") != "", F.col("contributed_by")), by_path, F.lit("unknown")),
        "pooled_at": F.coalesce("pooled_at", "captured_at"),
    })


def faults(lines: DataFrame) -> DataFrame:
    """path, line_n, reason of the lines that are no posts, counted from 1."""
    return parsed(lines).where("reason is not null").select("path", (F.col("line_n") + 1).alias("line_n"), "reason")


def check_source(lines: DataFrame) -> DataFrame:
    """lines, if all of them are posts; else BadSource names the first that is not."""
    bad = faults(lines).orderBy("path", "line_n").first()
    if bad:
        raise BadSource(f"{bad['reason']} in {bad['path']} at line {bad['line_n']}")
    return lines


def envelopes(posts_: DataFrame) -> DataFrame:
    """envelope, n, taken: the number of posts of each envelope (posts have `envelope`, `position`), and
    whether it is within the bounds. An envelope with an invalid post is taken; the post is not."""
    return posts_.groupBy("envelope").agg(F.count("*").alias("n")).withColumn("taken", F.col("n").between(LEAST, MOST))


def accepted(posts_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid posts of envelopes that are taken; and envelope, position, reason of what is rejected."""
    sizes = envelopes(posts_).where("taken").select("envelope")
    judged = posts_.withColumn("reason", reject_reason()).join(sizes, "envelope", "left_semi")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("envelope", "position", "reason")


def stamp(posts_: DataFrame, contributor: Column, at: Column) -> DataFrame:
    """Posts with attribution by the server, whatever the client says."""
    return posts_.withColumns({"contributed_by": contributor, "pooled_at": at})


def daily(posts_: DataFrame) -> DataFrame:
    """path, line of stamped posts (contributed_by, captured_at, line), for a segment log."""
    return posts_.select(paths.post_path(F.col("contributed_by"), F.col("captured_at")).alias("path"), "line")


def pinned(files: DataFrame) -> DataFrame:
    """path, digest, source_order, transaction_id, created_at of the files (path, content) of an import:
    ids and times follow from content and order of the paths, so that a second import writes the
    same."""
    placed = numbered(files.select("path", F.sha2("content", 256).alias("digest")), ["path", "digest"], "source_order", 0)
    key = F.sha2(F.concat_ws(":", "path", "digest"), 256)
    return placed.select(
        "path", "digest", "source_order", paths.deterministic_uuid(key).alias("transaction_id"), paths.deterministic_time(F.col("source_order")).alias("created_at")
    )
