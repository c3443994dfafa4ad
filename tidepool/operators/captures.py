"""Captures of posts: validation, projection, freshest copies, the feed and its pages."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def reject_reason() -> Column:
    """Why a post (id, url, username, text, captured_at, created_at) is not valid; null if it
    is. The first fault in this order counts."""

    def stamp(c: str) -> Column:
        return F.col(c).rlike(ISO) & F.expr(f"try_cast({c} AS timestamp)").isNotNull()

    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(empty("id"), "id").when(empty("url"), "url").when(F.col("text").isNull(), "text")
        .when(F.col("captured_at").isNull() | ~stamp("captured_at"), "captured_at")
        .when(F.col("created_at").isNotNull() & ~stamp("created_at"), "created_at")
        .when(empty("username"), "username")
    )


def project(captures: DataFrame) -> DataFrame:
    """Columns of the projection: sort_ts, the lower-cased username, 0/1 flags as booleans."""
    return captures.withColumn("author_username", F.lower("username")).withColumn(
        "sort_ts", F.coalesce("created_at", "captured_at")
    )


def freshest(captures: DataFrame) -> DataFrame:
    """One row for each (id, contributed_by): the latest captured_at as text; of equal ones
    the first that arrived. Nothing but its keys decides, so the text is joined later."""
    w = W.partitionBy("id", "contributed_by").orderBy(F.col("captured_at").desc(), "replay_pos")
    return captures.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def classify(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """accepted: for each row of a batch, whether it is fresher than what is stored and the
    first of the batch's freshest copies of its key."""
    keys = ["id", "contributed_by"]
    w = W.partitionBy(*keys).orderBy(F.col("captured_at").desc(), "replay_pos")
    known = stored.select(*keys, F.col("captured_at").alias("__known"))
    ranked = batch.withColumn("__rn", F.row_number().over(w)).join(known, keys, "left")
    fresh = (F.col("__rn") == 1) & (F.col("__known").isNull() | (F.col("captured_at") > F.col("__known")))
    return ranked.withColumn("accepted", fresh).drop("__rn", "__known")


FEED_ORDER = ("sort_ts", "id", "contributed_by")


def before(cursor: tuple, columns: tuple) -> Column:
    """Rows after a cursor in descending order of columns, as nested comparisons that reach
    the scan."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, cursor))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def page(rows: DataFrame, columns: tuple, size: int, cursor: tuple | None = None) -> DataFrame:
    """The next `size` + 1 rows (one to look ahead) in descending order: a top-k, no full sort."""
    if cursor:
        rows = rows.where(before(cursor, columns))
    return rows.orderBy(*(F.col(c).desc() for c in columns)).limit(size + 1)


def encode_cursor(values: tuple) -> str:
    raw = json.dumps(list(values), separators=(",", ":"), ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str, length: int) -> tuple | None:
    """None for a cursor that isn't one: the feed then starts at its first page."""
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        return None
    good = isinstance(values, list) and len(values) == length and all(isinstance(v, str) for v in values)
    return tuple(values) if good else None


def deduplicated(rows: DataFrame) -> DataFrame:
    """One copy of each post of (filtered) rows, with the contributors of all of them."""
    w = W.partitionBy("id").orderBy(F.col("captured_at").desc(), "contributed_by")
    names = rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("contributed_by")), ",").alias("contributors"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").join(names, "id")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal(pattern: str, *columns: str) -> Column:
    """Substring match in any column, folding the case of A-Z alone; % and _ stay wildcards."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pattern)
    out = F.lit(False)
    for c in columns:
        out = out | ascii_lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{low}%")
    return out


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalized(c: Column) -> Column:
    """Tokens of a text, lower-cased, without accents, joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"[^\p{L}\p{N}]+", " "))


def phrase(query: str, *columns: str) -> Column:
    """Phrase match whose last token is a prefix, within one column. Queries that hold more
    than words and spaces are matched literally."""
    import re

    tokens = re.findall(r"[^\W]+", query, re.UNICODE)
    if not tokens or len(" ".join(tokens)) != len(query.strip()):
        return literal(query, *columns)
    wanted = F.concat(F.lit(" "), normalized(F.lit(query)))
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.concat(F.lit(" "), normalized(F.coalesce(F.col(c), F.lit("")))), wanted)
    return out


def contributors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contributed_by").agg(F.count("*").alias("posts"), F.max("pooled_at").alias("last_pooled_at"))
