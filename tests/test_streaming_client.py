from pyspark.sql import functions as F

from tidepool.operators import client as batch
from tidepool.streaming.client import let_through

SCHEMA = "id string, is_article boolean, has_photo boolean, replay_pos long"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i * 7 % 9), i % 4 == 0, i % 3 == 0, i) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    every = spark.createDataFrame(rows, SCHEMA)
    for backfill in (False, True):
        stream = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in").drop("part")
        name = f"through_{backfill}".lower()
        q = let_through(stream, "replay_pos", backfill).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = sorted(r["replay_pos"] for r in spark.table(name).collect())
        want = sorted(r["replay_pos"] for r in batch.first_seen(every, F.col("has_photo") if backfill else None).collect())
        assert got == want
