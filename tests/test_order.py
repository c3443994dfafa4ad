"""Numbers over several ranges: offsets and places must come from one dealing of the rows."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import client
from tidepool.operators import ingest as ing
from tidepool.operators import labels as lab
from tidepool.operators import results as res
from tidepool.plans import adapter as ad
from tidepool.plans import queries

N = 40_000


@pytest.fixture
def many_ranges(spark):
    """Ranges are many and merged by size, as in large tables."""
    put = {
        "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    was = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def mixed(spark):
    return spark.range(N, numPartitions=5).withColumn("id", F.col("id") * 7919 % N)


def test_receipts_over_ranges(many_ranges):
    seen = mixed(many_ranges).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("list_id"))
    got = client.receipts(seen).collect()
    assert len(got) == N and all(r["sequence"] == r["pos"] + 1 for r in got)


def test_observations_over_ranges(many_ranges):
    seen = mixed(many_ranges).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("list_id"))
    got = client.observations(seen.withColumn("run_id", F.col("list_id")), client.receipts(seen), 500).collect()
    assert len(got) == N and all(r["known_before"] == (r["pos"] < 500) for r in got)


def test_registry_replay_over_ranges(many_ranges, monkeypatch):
    names = mixed(many_ranges).select(F.format_string("n%05d", "id").alias("name"), F.lit("candidate").alias("status"), F.sha2(F.col("id").cast("string"), 256).alias("first_observed_at"))
    monkeypatch.setattr(ad, "registry", lambda spark, d: names)
    got = queries.registry_replay(many_ranges, "").collect()
    assert sorted(r["name"] for r in got) == [f"n{i:05d}" for i in range(N * 9 // 10 - 1)]


def test_replayed_chain_ends_at_its_first_gap(spark):
    chain = spark.range(1, 10).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("candidate").alias("status"), F.col("id").alias("revision"), F.col("id").alias("pos"))
    chain = chain.withColumns({"at": F.lit("t"), "contract_hash": F.lit("k"), "reason": F.lit("")})
    assert lab.replay_registry(chain, "k").count() == 9
    assert lab.replay_registry(chain.where("revision <> 4"), "k").count() == 3
    assert lab.replay_registry(chain.where("revision > 1"), "k").isEmpty()


def test_registry_stamps_over_ranges(many_ranges):
    wanted = mixed(many_ranges).select(F.format_string("n%05d", "id").alias("name"), F.lit("observe").alias("decision"), F.lit("").alias("reason"), F.floor(F.col("id") / 10).alias("pos"))
    none = many_ranges.createDataFrame([], "name string, status string")
    got = res.registry_events(wanted, none, "t", "k", 10).collect()
    assert len(got) == N and all(r["registry_revision"] == 11 + int(r["name"][1:]) for r in got)


def test_pinned_over_ranges(many_ranges):
    files = mixed(many_ranges).select(F.format_string("p%05d", "id").alias("path"), F.col("id").cast("string").alias("content"))
    got = ing.pinned(files).collect()
    assert len(got) == N and all(r["source_order"] == int(r["path"][1:]) for r in got)
