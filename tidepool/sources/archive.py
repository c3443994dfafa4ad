"""A local archive: JSON lines by folder and day, to which batches append what a folder does not have.

A batch lies in a folder of its own below each day, named by its number, so one that runs again after
a failure writes the same files anew, and what it wrote before does not count as seen. Which rows are
new is decided by a join with the keys of what the folder holds, whatever its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.sources.segments import _fs

KEYS = "folder string, key string"


def keyed(rows: DataFrame) -> DataFrame:
    """folder, key: what makes rows (folder, id, is_article) seen: their id, and for articles one more."""
    article = F.when(F.col("is_article"), F.concat(F.lit("article:"), F.col("id")))
    return rows.where("id <> ''").select("folder", F.explode(F.array_compact(F.array(F.col("id"), article))).alias("key")).distinct()


def fresh(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of a batch (folder, pos, id, is_article, and more) that its folder does not have: the first
    of each id, the first article of an id, and all rows without an id. seen: folder, key."""
    own, article = F.coalesce(F.col("id"), F.lit("")), F.coalesce(F.col("is_article"), F.lit(False))
    by_id = W.partitionBy("folder", "id").orderBy("pos")
    rows = batch.withColumn("__n", F.row_number().over(by_id)).withColumn("__m", F.row_number().over(W.partitionBy("folder", "id", article).orderBy("pos")))
    first = rows.where((own == "") | (F.col("__n") == 1) | (article & (F.col("__m") == 1)))
    plain = seen.where("key not like 'article:%'").select(F.col("folder").alias("__f"), F.col("key").alias("__k")).distinct()
    articles = seen.where("key like 'article:%'").select(F.col("folder").alias("__g"), F.col("key").alias("__a")).distinct()
    met = first.join(plain, (F.col("folder") == F.col("__f")) & (F.col("id") == F.col("__k")), "left")
    met = met.join(articles, (F.col("folder") == F.col("__g")) & (F.concat(F.lit("article:"), F.col("id")) == F.col("__a")), "left")
    return met.where((own == "") | F.col("__k").isNull() | (article & F.col("__a").isNull())).select(batch.columns)


def stored_keys(spark: SparkSession, root: str, but: int | None = None) -> DataFrame:
    """folder, key of the archive; a line that is no JSON object counts for nothing. but: a batch that is
    left out."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return spark.createDataFrame([], KEYS)
    lines = spark.read.schema("value string, folder string, day string, batch long").option("basePath", root).text(root)
    if but is not None:
        lines = lines.where(F.col("batch") != but)
    post = F.try_parse_json("value")
    rows = lines.select("folder", F.try_variant_get(post, "$.id", "string").alias("id"), F.coalesce(F.try_variant_get(post, "$.is_article", "boolean"), F.lit(False)).alias("is_article"))
    return keyed(rows)


def append(spark: SparkSession, root: str, batch: DataFrame, number: int) -> DataFrame:
    """Append what is fresh of a batch (folder, day, pos, id, is_article, line) and give folder, written,
    duplicates. Lines stay in order of pos within a day of a folder."""
    new = fresh(batch, stored_keys(spark, root, but=number))
    fs, path = _fs(spark, root)
    if fs.exists(path):  # what an earlier try of this batch has written
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/folder=*/day=*/batch={number}")) or []:
            fs.delete(status.getPath(), True)
    rows = new.withColumn("batch", F.lit(number)).repartition("folder", "day").sortWithinPartitions("folder", "day", "pos")
    rows.select("folder", "day", "batch", F.col("line").alias("value")).write.mode("append").partitionBy("folder", "day", "batch").text(root)
    written = spark.read.schema("value string, folder string, day string, batch long").option("basePath", root).text(root)
    written = written.where(F.col("batch") == number).groupBy("folder").agg(F.count("*").alias("written"))
    counts = batch.groupBy("folder").agg(F.count("*").alias("n")).join(written, "folder", "left")
    return counts.select("folder", F.coalesce("written", F.lit(0)).alias("written"), (F.col("n") - F.coalesce("written", F.lit(0))).alias("duplicates"))
