"""Who may read the pool: names, and the grant that a person has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a name of a person or an organisation looks like.
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def normal_name(c: Column) -> Column:
    """Trimmed and in small letters; null if it is no name."""
    name = F.lower(F.trim(c))
    return F.when(name.rlike(NAME), name)


def grants(people: DataFrame, config: DataFrame, *keys: str) -> DataFrame:
    """keys, username, grant, org of people (username, orgs: their ids in order). config: kind (admin, member, org)
    and value, a short list that a pool's owner writes, so it is sent to the rows. An admin is an admin,
    else a listed member, else of the first of their organisations that has a grant."""
    listed = F.broadcast(config.agg(
        *(F.collect_set(F.when(F.col("kind") == k, F.lower(F.trim("value")))).alias(f"{k}s") for k in ("admin", "member")),
        F.collect_set(F.when(F.col("kind") == "org", F.trim("value"))).alias("granted"),
    ))
    met = people.withColumn("name", normal_name(F.col("username"))).join(listed)  # one row
    org = F.try_element_at(F.filter(F.transform("orgs", lambda o: F.trim(o)), lambda o: F.array_contains("granted", o)), F.lit(1))
    kind = F.when(F.array_contains("admins", F.col("name")), "admin").when(F.array_contains("members", F.col("name")), "member").when(org.isNotNull(), "member_org")
    return met.select(*keys, "username", F.when(F.col("name").isNotNull(), kind).alias("grant"), F.when(F.col("name").isNotNull() & (kind == "member_org"), org).alias("org"))
