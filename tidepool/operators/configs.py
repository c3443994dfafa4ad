"""Configuration as a fold of its mutations: members of pools, service accounts and what they may do."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.operators.sequences import in_order

# ---- members ---------------------------------------------------------------------------------

MUTATION = "pool long, seq long, op string, who string, org string, sub string"
CHANGED = "pool long, seq long, outcome string, members array<string>, admins array<string>, org string, sub string"


def username(name: Column) -> Column:
    """Lower-cased, without blanks around it and the sign before it."""
    return F.regexp_replace(F.lower(F.trim(name)), "^@+", "")


class Members:
    """The document of one pool. Bootstrap admins are admins whatever the document says; an admin is a
    member; a pool keeps one admin at least, and one organisation at most."""

    def __init__(self, pool, bootstrap: set[str]):
        self.pool, self.bootstrap = pool, bootstrap
        self.members, self.admins, self.org = set(), set(), (None, None)

    def end(self) -> Iterator[dict]:
        return iter(())

    def step(self, m: dict) -> Iterator[dict]:
        before = (set(self.members), set(self.admins), self.org)
        refused = bool(getattr(self, m["op"])(m["who"], m["org"], m["sub"]))
        same = before == (self.members, self.admins, self.org)
        yield {
            "pool": self.pool, "seq": m["seq"], "outcome": "refused" if refused else "unchanged" if same else "changed",
            "members": sorted(self.members), "admins": sorted(self.admins), "org": self.org[0], "sub": self.org[1],
        }

    def add_member(self, who, org, sub) -> None:
        if who not in self.admins | self.bootstrap:
            self.members.add(who)

    def remove_member(self, who, org, sub) -> bool:
        if who in self.admins | self.bootstrap:
            return True
        self.members.discard(who)
        return False

    def add_admin(self, who, org, sub) -> None:
        if who not in self.admins | self.bootstrap:
            self.admins.add(who)
            self.members.add(who)

    def remove_admin(self, who, org, sub) -> bool:
        if who in self.bootstrap or (who in self.admins and not (self.admins - {who}) | self.bootstrap):
            return True
        self.admins.discard(who)
        return False

    def set_org(self, who, org, sub) -> None:
        if self.org[1] != sub:
            self.org = (org, sub)

    def remove_org(self, who, org, sub) -> None:
        if self.org[0] == org:
            self.org = (None, None)


def member_changes(mutations: DataFrame, bootstrap: list[str]) -> DataFrame:
    """CHANGED: the outcome of each mutation (MUTATION) of a pool's document, in order of seq, and the
    document after it."""
    fixed = set(bootstrap)
    rows = mutations.withColumn("who", username(F.col("who")))
    return in_order(rows, ["pool"], ["seq"], lambda key: Members(key[0], fixed), CHANGED)


# ---- service accounts --------------------------------------------------------------------------


def accounts(log: DataFrame) -> DataFrame:
    """registry, account, name, scopes, issued, revoked (numbers of the mutations; null: active) of a log
    (registry, seq, op, account, name, scopes, key, token_hash, expires). A name is issued once, also if
    its account has been revoked since; so the first counts."""
    first = W.partitionBy("registry", "name").orderBy("seq")
    issued = log.where("op = 'issue'").withColumn("n", F.row_number().over(first)).where("n = 1")
    ends = log.where("op = 'revoke'").groupBy("registry", "account").agg(F.min("seq").alias("revoked"))
    return issued.select("registry", "account", "name", "scopes", F.col("seq").alias("issued")).join(ends, ["registry", "account"], "left").select(
        "registry", "account", "name", "scopes", "issued", "revoked"
    )


def keys(log: DataFrame) -> DataFrame:
    """registry, account, key, token_hash, expires, made, gone: an account's keys, from the mutation that
    made each to the one that took it away. Only active accounts get keys, or lose one."""
    own = accounts(log)
    during = (F.col("seq") >= F.col("issued")) & (F.col("revoked").isNull() | (F.col("seq") < F.col("revoked")))
    live = log.join(own.select("registry", "account", "issued", "revoked"), ["registry", "account"]).where(during)
    made = live.where("op in ('issue', 'rotate')").select("registry", "account", "key", "token_hash", "expires", F.col("seq").alias("made"), "revoked")
    taken = live.where("op = 'revoke_key'").select("registry", "account", "key", F.col("seq").alias("taken"))
    met = made.join(taken, ["registry", "account", "key"], "left").where("taken is null or taken > made")
    first = met.groupBy("registry", "account", "key", "token_hash", "expires", "made", "revoked").agg(F.min("taken").alias("taken"))
    never = made.join(first.select("registry", "account", "key", "made"), ["registry", "account", "key", "made"], "left_anti").withColumn("taken", F.lit(None).cast("long"))
    return first.unionByName(never).select("registry", "account", "key", "token_hash", "expires", "made", F.least("taken", "revoked").alias("gone"))


def authorized(requests: DataFrame, log: DataFrame) -> DataFrame:
    """registry, seq, name, verdict of requests (registry, seq, account, key, token_hash, scope, at), each
    judged by the mutations before it: ok, or the first thing that is missing: account (unknown or
    revoked), scope, key (unknown or taken away), expired, token."""
    own = accounts(log).withColumnsRenamed({"issued": "__issued", "revoked": "__revoked"})
    held = keys(log).select("registry", "account", "key", F.col("token_hash").alias("__hash"), "expires", "made", "gone")
    rows = requests.join(own, ["registry", "account"], "left").join(held, ["registry", "account", "key"], "left")
    at = F.col("seq")
    active = (F.col("__issued") < at) & (F.col("__revoked").isNull() | (F.col("__revoked") > at))
    there = (F.col("made") < at) & (F.col("gone").isNull() | (F.col("gone") > at))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    verdict = (
        F.when(no(active), "account").when(no(F.array_contains("scopes", F.col("scope"))), "scope").when(no(there), "key")
        .when(F.col("expires") <= F.col("at"), "expired").when(no(F.col("token_hash") == F.col("__hash")), "token").otherwise("ok")
    )
    return rows.select("registry", "seq", F.when(verdict == "ok", F.col("name")).alias("name"), verdict.alias("verdict"))
