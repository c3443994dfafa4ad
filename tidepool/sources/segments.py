"""The segment log: immutable, checksummed JSON segments, snapshots of them, and Parquet
generations of the state that they fold to."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = "schema_version int, transaction_id string, created_at string, operations array<struct<path:string,mode:string,lines:array<string>,content:string>>"
#: Lines of one segment at most, and parts that the lines of a path are dealt to.
LINES, CUTS = 5000, 8
#: What the kind of a record is, by the path it is appended to.
KINDS = {
    "post": r"^posts/", "enrichment": r"^enrichment/", "attempt": r"^attempts/", "registry": r"^registry/",
    "receipt": r"^receipts/", "config": r"^config/",
}


def kind_of(path: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in KINDS.items():
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def append(records: DataFrame, log: str, created_at: str, transaction: str | None = None) -> str:
    """Write records (path, line) as one transaction, in folders by category and day, and read it back.

    The lines of a path are cut into segments of LINES at most, in order of line, so no row gathers
    more, whatever a path or a category holds. A segment is named by the digest of its content: what is written
    twice is one file's content with one name. A transaction that exists already must hold just
    the same segments. Returns the transaction."""
    transaction = transaction or str(uuid.uuid4())
    spark = records.sparkSession
    day = datetime.fromisoformat(created_at.replace("Z", "+00:00")).astimezone(timezone.utc).strftime("%Y-%m-%d")
    w = W.partitionBy("path", "cut").orderBy("line")
    n = F.row_number().over(w) - 1
    # a hot path is dealt over cuts by a hash of its lines before it is numbered
    dealt = records.select("path", "line", F.pmod(F.xxhash64("line"), F.lit(CUTS)).cast("int").alias("cut")).withColumn("part", F.floor(n / LINES))
    grouped = dealt.groupBy("path", "cut", "part").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    op = F.struct("path", F.lit("append").alias("mode"), "lines", F.lit(None).cast("string").alias("content"))
    rows = grouped.select(kind_of(F.col("path")).alias("category"), F.array(op).alias("operations"))
    rows = rows.withColumn("segment", F.sha2(F.to_json("operations"), 256))
    out = rows.select(
        "category", F.lit(day).alias("day"), F.lit(transaction).alias("txn"), "segment", F.lit(1).alias("schema_version"),
        F.lit(transaction).alias("transaction_id"), F.lit(created_at).alias("created_at"), "operations",
    )
    digest = lambda df: df.agg(F.count("*").cast("string"), F.coalesce(F.sum(F.conv(F.substring("segment", 1, 14), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    written = lambda: segments(spark, log).where((F.col("txn") == transaction) & (F.col("day") == day))
    fs, p = _fs(spark, f"{log}/segments")
    if fs.exists(p) and not written().isEmpty():
        if digest(written()) != digest(out):
            raise Conflict(f"transaction {transaction} holds something else")
        return transaction
    out.write.mode("append").partitionBy("category", "day", "txn").option("compression", "gzip").json(f"{log}/segments")
    if digest(written()) != digest(out):
        raise OSError(f"transaction {transaction} can't be read back")
    return transaction


def next_time(now: str, last: str | None) -> str:
    """The time of a new transaction: now, or a millisecond after the last one if that is later."""
    if last is None:
        return now
    read = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")).astimezone(timezone.utc)
    at = max(read(now), read(last) + timedelta(milliseconds=1))
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def category(found: DataFrame) -> DataFrame:
    """file, category of segments: the kind of their paths, or `mixed`."""
    kinds = F.array_distinct(F.transform("operations", lambda o: kind_of(o["path"])))
    return found.select("file", F.when(F.size(kinds) == 1, kinds.getItem(0)).otherwise("mixed").alias("category"))


def latest_receipt(found: DataFrame) -> DataFrame:
    """The receipt (path, line) that finished last. Only segments that may hold one are read."""
    some = found.where(F.col("category").isin("receipt", "mixed"))
    lines = records(some).where("kind = 'receipt'")
    at = F.try_variant_get(F.try_parse_json("line"), "$.finished_at", "string")
    return lines.agg(F.max_by(F.struct("path", "line"), F.struct(at, "created_at", "transaction_id", "position")).alias("r")).select("r.*").where("line is not null")


def stats(found: DataFrame) -> DataFrame:
    """kind, files, lines, latest (the newest created_at) of what segments hold."""
    lines = records(found)
    return lines.groupBy("kind").agg(F.countDistinct("file").alias("files"), F.count("*").alias("lines"), F.max("created_at").alias("latest"))


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Segments that are not among those seen (segment: their digest): applying them again, or two
    copies of one, changes nothing."""
    return found.dropDuplicates(["segment"]).join(seen.select("segment"), "segment", "left_anti")


def segments(spark: SparkSession, log: str) -> DataFrame:
    """All segments, with the file each is in; category and day are pruned by path."""
    return spark.read.schema(SEGMENT + ", segment string, category string, day string, txn string").json(f"{log}/segments").select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
    )


def records(found: DataFrame) -> DataFrame:
    """created_at, transaction_id, file, path, kind, position, line: in replay order if
    sorted by the first three and the position."""
    each = found.select("created_at", "transaction_id", "file", F.posexplode("operations").alias("op_n", "op"))
    lines = each.select("created_at", "transaction_id", "file", "op.path", "op_n", F.posexplode("op.lines").alias("line_n", "line"))
    return lines.select(
        "created_at", "transaction_id", "file", "path", kind_of(F.col("path")).alias("kind"),
        (F.col("op_n").cast("long") * (1 << 32) + F.col("line_n")).alias("position"), "line",
    )


def config(found: DataFrame, path: str) -> DataFrame:
    """The content that the last writer gave a path."""
    op = found.select("created_at", "transaction_id", "file", F.explode("operations").alias("op")).where(F.col("op.path") == path)
    return op.agg(F.max_by(F.col("op.content"), F.struct("created_at", "transaction_id", "file")).alias("content"))


def snapshot(found: DataFrame) -> DataFrame:
    """file, size, digest of every file of segments: of the digests of its rows, which one task wrote."""
    body = F.sha2(F.to_json(F.struct("schema_version", "transaction_id", "created_at", "operations")), 256)
    each = found.select("file", "size", body.alias("digest"))
    return each.groupBy("file", "size").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ","), 256).alias("digest"))


def revision(snap: DataFrame) -> str:
    """A digest of a snapshot that doesn't depend on its order: sums of halves of the files'
    digests, so no list of all files is gathered."""
    whole = F.sha2(F.concat_ws(":", "file", "size", "digest"), 256)
    halves = [F.coalesce(F.sum(F.conv(F.substring(whole, a, 14), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for a in (1, 15, 29, 43)]
    row = snap.agg(F.count("*").cast("string"), *halves).first()
    import hashlib

    return hashlib.sha256(":".join(row).encode()).hexdigest()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, change: added, removed or rewritten files between two snapshots. A log only
    grows, so anything but added is a fault."""
    met = old.select("file", F.col("digest").alias("was")).join(new.select("file", F.col("digest").alias("is")), "file", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "rewritten")
    return met.withColumn("change", change).where("change is not null").select("file", "change")


class Conflict(Exception):
    """A transaction of one name with other content."""


class Stale(Exception):
    """The manifest is not the one that an update was made from."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest of generations under root."""
    fs, p = _fs(spark, f"{root}/manifests")
    if not fs.exists(p):
        return None
    numbers = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")]
    if not numbers:
        return None
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/manifests/{max(numbers):012d}.json").collect())
    return json.loads(text)


def publish(
    tables: dict, root: str, revision_: str, expected: str | None, spark: SparkSession | None = None, more: dict | None = None
) -> dict:
    """Write a generation of tables, then its manifest, if the manifest is still the expected
    generation (None: there is none). A table is a DataFrame, or a function of the tables written
    before it (then the session is given), so that none is derived twice. The manifest's file is
    created, never replaced, so of two writers one fails. more: further entries of the manifest."""
    spark = spark or next(iter(tables.values())).sparkSession
    now = manifest(spark, root)
    if (now["generation"] if now else None) != expected:
        raise Stale(f"expected {expected}")
    generation, counts, done = uuid.uuid4().hex, {}, {}
    for name, table in tables.items():
        df = table(done) if callable(table) and not isinstance(table, DataFrame) else table
        path = f"{root}/generations/{generation}/{name}"
        df.write.parquet(path)
        done[name] = spark.read.schema(df.schema).parquet(path)
        counts[name] = done[name].count()
    made = {"generation": generation, "number": (now["number"] if now else 0) + 1, "revision": revision_, "previous": expected, "counts": counts}
    made |= more or {}
    fs, p = _fs(spark, f"{root}/manifests/{made['number']:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise Stale("another writer was first") from e
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    return made


def restore(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest generation; their counts must be those of the manifest."""
    now = manifest(spark, root)
    if not now:
        return {}
    out = {}
    for name, n in now["counts"].items():
        out[name] = spark.read.parquet(f"{root}/generations/{now['generation']}/{name}")
        if out[name].count() != n:
            raise ValueError(f"{name} has not the rows that its manifest says")
    return out


DAY_MS = 24 * 60 * 60 * 1000


def prune(spark: SparkSession, root: str, keep: int = 4, age_ms: int = DAY_MS) -> list[str]:
    """Delete generations but those of the newest `keep` manifests, with the layers that they are made
    of, and those that were written within age_ms, which another session may be about to publish;
    their names."""
    fs, p = _fs(spark, f"{root}/manifests")
    numbers = sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    held = set()
    for n in numbers[-keep:]:
        made = json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/manifests/{n:012d}.json").collect()))
        held |= {made["generation"], *made.get("layers", [])}
    fs, p = _fs(spark, f"{root}/generations")
    before = time.time() * 1000 - age_ms
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in held and s.getModificationTime() <= before]
    for g in gone:
        fs.delete(g, True)
    return [g.getName() for g in gone]
