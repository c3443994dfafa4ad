"""Units: all posts of one author in one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit_key() -> Column:
    """conversation_id, else the post's own id, and the lower-cased username."""
    own = F.coalesce(F.when(F.col("conversation_id") != "", F.col("conversation_id")), F.col("id"))
    return F.concat(own, F.lit(":"), F.lower("author_username"))


def members(projected: DataFrame) -> DataFrame:
    """id, unit_id, captured_at, replay_pos: the unit of each post by its latest copy; of equally late
    ones by the last that arrived. Map-side combinable, so hot posts don't travel."""
    return latest_unit(projected.withColumn("unit_id", unit_key()))


def latest_unit(rows: DataFrame) -> DataFrame:
    """members() of rows that name a unit each (id, unit_id, captured_at, replay_pos)."""
    order = F.struct("captured_at", "replay_pos")
    last = rows.groupBy("id").agg(F.max_by("unit_id", order).alias("unit_id"), F.max(order).alias("last"))
    return last.select("id", "unit_id", "last.captured_at", "last.replay_pos")


def flags(rows: DataFrame, authors: list[str] | None = None) -> DataFrame:
    """One pass for all whole-unit conditions: order key, latest activity, whether all
    members are by the authors (a missing id disqualifies), whether it is public original."""
    closed = F.bool_and(F.coalesce(F.col("author_id").isin(authors or []), F.lit(False)))
    return rows.groupBy("unit_id").agg(
        F.max("sort_ts").alias("sort_ts"), F.max("captured_at").alias("activity"), closed.alias("closed"),
        (~F.bool_or("is_subscriber_only") & F.bool_or(~F.col("is_retweet"))).alias("public_original"),
    )


def selected(rows: DataFrame, cutoff: str | None = None, public_original: bool = False, authors: list[str] | None = None) -> DataFrame:
    """unit_id of the units that a selection holds for: with no activity after the cutoff, public
    original, all by the authors. One aggregate, whatever is asked."""
    kept = flags(rows, authors)
    if cutoff is not None:
        kept = kept.where(F.col("activity") <= cutoff)
    if public_original:
        kept = kept.where("public_original")
    if authors:
        kept = kept.where("closed")
    return kept.select("unit_id")


UNIT_ORDER = ("sort_ts", "unit_id")


def posts(rows: DataFrame) -> DataFrame:
    """The freshest copy of each post of a unit; of equal ones by the first contributor."""
    w = W.partitionBy("unit_id", "id").orderBy(F.col("captured_at").desc(), "contributed_by")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def hydrate(rows: DataFrame, page: DataFrame) -> DataFrame:
    """Post ids of a page of units, oldest first, and their contributors. The page is a few
    hundred rows at most (its size is a checked parameter), so it is sent to the rows."""
    own = rows.join(F.broadcast(page.select("unit_id")), "unit_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sort_ts", "id"))), lambda x: x["id"])
    listed = posts(own).groupBy("unit_id").agg(F.array_join(ordered, ",").alias("posts"), F.count("*").alias("n_posts"))
    names = own.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("contributed_by")), ",").alias("contributors"))
    return page.join(listed, "unit_id").join(names, "unit_id")


def unit_text(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Texts of the posts of each unit, oldest first, joined by blank lines and cut off."""
    met = posts(rows).select("unit_id", "id", "sort_ts", "doc_id").join(texts.select("doc_id", "text"), "doc_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sort_ts", "id", "text"))), lambda x: x["text"])
    return met.groupBy("unit_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, length).alias("text"))


#: Columns that may name the post replied to, and the quoted one, in the order that they are asked.
REPLY_KEYS = ("in_reply_to_status_id", "in_reply_to_tweet_id", "reply_to_status_id")
QUOTE_KEYS = ("quoted_status_id", "quoted_tweet_id", "quote_status_id")


def first_given(rows: DataFrame, keys: tuple[str, ...]) -> Column:
    """The first of the columns (those that there are) that is neither null nor empty."""
    given = [F.when(F.col(k).cast("string") != "", F.col(k).cast("string")) for k in keys if k in rows.columns]
    return F.coalesce(*given) if given else F.lit(None).cast("string")


def expanded_urls(rows: DataFrame) -> Column:
    """The sorted set of all URLs that a post expands: its own list, and those of its entities."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), none) for c in ("expanded_urls", "entity_urls") if c in rows.columns]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*lists, none), lambda u: u != "")))


def semantic(rows: DataFrame) -> Column:
    """What of a post bears on its labels, as a struct whose fields are in order of name."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return F.struct(
        "author_id", F.lower("author_username").alias("author_username"), first_given(rows, ("conversation_id",)).alias("conversation_id"),
        expanded_urls(rows).alias("expanded_urls"), "id", flag("is_retweet"), flag("is_subscriber_only"),
        first_given(rows, QUOTE_KEYS).alias("quoted_status_id"), first_given(rows, REPLY_KEYS).alias("reply_to"), "text",
    )


def canonical_json(value: Column) -> Column:
    """JSON of structs whose fields are in order of name: nulls are left out, control characters are
    written with small hexadecimal digits."""
    out = F.to_json(value)
    small = out
    for digit in "ABCDEF":
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.when(out.rlike(r"\\u00[01][A-F]"), small).otherwise(out)


def input_hash(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """sha256 of the canonical JSON of a unit's members in order of id."""
    met = posts(rows).join(texts.select("doc_id", "text"), "doc_id")
    member = F.struct(F.col("id").alias("key"), semantic(met).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"])
    return met.groupBy("unit_id").agg(ordered.alias("members")).select(
        "unit_id", F.sha2(canonical_json(F.struct("members", "unit_id")), 256).alias("input_hash")
    )
