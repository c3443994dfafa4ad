"""Incremental ingest: new segments fold into the current captures as they arrive.

A batch rewrites only the buckets of keys that it touches: current captures lie in BUCKETS folders
by a hash of their key, each with the number of the batch that wrote it in its name. The manifest
of a generation says which folder of each bucket counts, so readers never see half a batch, and a
batch that runs again after a failure writes the same folders and changes nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.operators import captures as cap
from tidepool.sources.segments import Stale, _fs, manifest, publish

KEYS = ["id", "contributed_by"]
BUCKETS = 64


def upsert(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Stored captures with a batch folded in: a strictly fresher copy replaces the old one,
    a stale one is ignored; among equals the stored one, then the first of the batch, stays."""
    every = batch if stored is None else stored.unionByName(batch)
    return cap.freshest(every).drop("rn")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def captures(spark: SparkSession, root: str) -> DataFrame | None:
    """The current captures of the newest manifest; None before the first batch."""
    now = manifest(spark, root)
    if not now or not now.get("folders"):
        return None
    return spark.read.schema(now["schema"]).parquet(*(f"{root}/buckets/{f}" for f in sorted(now["folders"].values())))


def fold_batches(root: str, buckets: int = BUCKETS):
    """A foreachBatch function that folds a batch in and publishes a manifest. The batch's number is
    the generation's revision, so a batch that runs again after a failure changes nothing."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = manifest(spark, root)
        if now and int(now["revision"]) >= number:
            return
        folders = dict(now["folders"]) if now else {}
        rows = batch.withColumn("bucket", _bucket(buckets))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # `buckets` rows at most
        old = [f"{root}/buckets/{folders[str(b)]}" for b in touched if str(b) in folders]
        stored = spark.read.schema(now["schema"]).parquet(*old) if old else None
        out = upsert(stored, batch).withColumn("bucket", _bucket(buckets))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("bucket").schema)
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/buckets/{number:012d}")
        gone = [folders[str(b)] for b in touched if str(b) in folders]
        folders |= {str(b): f"{number:012d}/bucket={b}" for b in touched}
        publish({}, root, str(number), now["generation"] if now else None, spark, {"folders": folders, "schema": schema})
        for f in gone:
            fs, path = _fs(spark, f"{root}/buckets/{f}")
            fs.delete(path, True)

    return fold


def start(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Tail a folder of Parquet files of captures; each trigger takes what is there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(fold_batches(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["KEYS", "Stale", "captures", "fold_batches", "start", "upsert"]
