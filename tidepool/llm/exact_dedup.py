"""Exact deduplication with a log-structured merge index of text digests.

Each task fills a memtable (digest -> smallest id, largest id, rows). A full memtable is
flushed as a run sorted by digest; compaction merges all runs by digest, so what is shuffled
is at most one entry per distinct text of a memtable, whatever the size of a group of copies.
The entries that several rows share are the level that rows look up. A Bloom filter of it, of a
fixed number of bytes, stands before the level: a row whose digest the filter does not hold is
known to be single and never reads the level nor sends its text. (Where a level outgrows the
filter, more rows pass it; results are the same.) A hit counts only after byte verification
against the text of its group's reference row.

:class:`MergeIndex` keeps runs between batches: sorted files with a filter for each part, which
lookups ask before they open the part; compaction merges the live runs and retires them.

Nulls: a null text counts as the empty text; null ids are kept and rank below all others.
Repeated rows (same id and text) are rows of their own in group_size, and all of them stay or
go together in exact_duplicates(); deduplicate() leaves one of them. Rows that share an id but
not the text are judged by their texts. Empty tables give empty results. Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import LOWER_AZ, documents, materialize, met_and_others, scratch, text_bytes

#: Entries that a memtable holds before it is flushed.
MEMTABLE_ENTRIES = 100_000
RUN_SCHEMA = "digest binary, min_id long, max_id long, n long"


#: Most bytes of the filter before a level: about 1 % of other digests pass it at 6,700,000 entries.
FILTER_BYTES = 8 << 20
#: Folders of a stored run, by the first byte of the digest; its filters are by the first two.
BUCKETS = 64


def _places(digests: list[bytes], bits: int, k: int = 5) -> np.ndarray:
    """k places in a filter for each digest."""
    halves = np.frombuffer(b"".join(d[:16] for d in digests), dtype="<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        steps = np.arange(k, dtype=np.uint64)[None, :] * (halves[:, 1:] | np.uint64(1))
        return ((halves[:, :1] + steps) % np.uint64(bits)).astype(np.int64)


def bloom(digests: list[bytes], size: int | None = None) -> np.ndarray:
    """The Bloom filter of digests: size bytes, or ten bits for each."""
    out = np.zeros(size or max(8, (len(digests) * 10 + 7) // 8), dtype=np.uint8)
    if digests:
        places = _places(digests, len(out) * 8).ravel()
        np.bitwise_or.at(out, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return out


def maybe_in(filter_: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Whether each digest may be in the filter; never False for one that is."""
    if not digests:
        return np.zeros(0, bool)
    places = _places(digests, len(filter_) * 8)
    return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def _one(bits: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])


def level_filter(level: DataFrame, most: int = FILTER_BYTES) -> np.ndarray:
    """The filter of a level, of ten bits an entry and `most` bytes at most: tasks fill filters,
    which are put together, so the driver gets eight at most."""
    size = min(most, level.count() * 10 // 8 + 8)

    def fill(batches: Iterator) -> Iterator:
        out = np.zeros(size, np.uint8)
        for batch in batches:
            out |= bloom(batch.column(0).to_pylist(), size)
        yield _one(out)

    def merge(batches: Iterator) -> Iterator:
        out = np.zeros(size, np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                out |= np.frombuffer(x, np.uint8)
        yield _one(out)

    parts = level.select("digest").coalesce(64).mapInArrow(fill, "bits binary").repartition(8).mapInArrow(merge, "bits binary")
    out = np.zeros(size, np.uint8)
    for r in parts.collect():
        out |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(LOWER_AZ)).digest()


def _flush(memtable: dict):
    import pyarrow as pa

    keys = sorted(memtable)
    cells = [memtable[k] for k in keys]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), *(pa.array([c[i] for c in cells], pa.int64()) for i in range(3))],
        ["digest", "min_id", "max_id", "n"],
    )


def _runs(batches: Iterator) -> Iterator:
    memtable: dict[bytes, list] = {}
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            cell = memtable.get(d := _digest(text))
            if cell is None:
                memtable[d] = [key, key, 1]
                if len(memtable) >= MEMTABLE_ENTRIES:
                    yield _flush(memtable)
                    memtable = {}
            else:
                cell[2] += 1
                if key is not None:
                    cell[0] = key if cell[0] is None else min(cell[0], key)
                    cell[1] = key if cell[1] is None else max(cell[1], key)
    if memtable:
        yield _flush(memtable)


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Memtables of docs, flushed: rows of RUN_SCHEMA, sorted by digest within each run."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_runs, RUN_SCHEMA)


def compact(runs: DataFrame) -> DataFrame:
    """Merge sorted runs into one level: an entry per digest."""
    return runs.groupBy("digest").agg(
        F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n")
    )


def _first_bytes(n: int):
    """The first n bytes of a column digest as a number."""
    return F.conv(F.hex(F.substring("digest", 1, n)), 16, 10).cast("int")


class MergeIndex:
    """An index that outlives a batch. Runs are Parquet files below one folder of the shared file
    system, partitioned by the first bits of the digest, sorted; beside each stand its filters, one
    for each two first bytes of digests. The newest file of `live` names the runs that count, so a lost
    job leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def live(self) -> list[str]:
        files, path = self._folder("live")
        if not files.exists(path):
            return []
        newest = max((f.getPath().getName() for f in files.listStatus(path)), key=lambda n: int(n.split("-")[0]))
        return sorted(r["run"] for r in self.spark.read.json(f"{self.path}/live/{newest}").collect())

    def _publish(self, runs: list[str]) -> None:
        files, path = self._folder("live")
        number = max((int(f.getPath().getName().split("-")[0]) for f in files.listStatus(path)), default=0) if files.exists(path) else 0
        names = self.spark.createDataFrame([(r,) for r in runs], "run string").coalesce(1)
        names.write.json(f"{self.path}/live/{number + 1}-runs")

    def _write(self, level: DataFrame, run: str) -> None:
        if run in self.live():
            raise ValueError(f"there is a run {run}")
        bucket = (_first_bytes(1) % BUCKETS).alias("bucket")
        rows = level.select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "digest")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/runs/{run}")
        self._filters_of(run).write.mode("overwrite").parquet(f"{self.path}/filters/{run}")

    def _filters_of(self, run: str) -> DataFrame:
        """cell, bits: a filter for the entries that share their first two bytes."""

        def of(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held: list[bytes] = []
            current = None

            def made():
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bloom(held).tobytes()], pa.binary())], ["cell", "bits"])

            for batch in batches:
                for cell, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if held and cell != current:
                        yield made()
                        held = []
                    current = cell
                    held.append(d)
            if held:
                yield made()

        rows = self._run(run).select(_first_bytes(2).alias("cell"), "digest")
        return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(of, "cell int, bits binary")

    def flush(self, docs: DataFrame, run: str, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the texts of docs as a run."""
        self._write(compact(sorted_runs(docs, id_col, text_col)), run)
        self._publish([*self.live(), run])

    def _run(self, run: str) -> DataFrame:
        return self.spark.read.schema(f"{RUN_SCHEMA}, bucket int").parquet(f"{self.path}/runs/{run}")

    def level(self) -> DataFrame:
        """All live runs, merged: an entry per digest."""
        rows = self.spark.createDataFrame([], f"{RUN_SCHEMA}, bucket int")
        for run in self.live():
            rows = rows.unionByName(self._run(run))
        return compact(rows.drop("bucket"))

    def compacted(self, run: str) -> None:
        """Merge the live runs into one and retire them."""
        old = self.live()
        self._write(self.level(), run)
        self._publish([run])
        for name in old:
            for kind in ("runs", "filters"):
                files, path = self._folder(f"{kind}/{name}")
                files.delete(path, True)

    def candidates(self, docs: DataFrame, run: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """digest, bucket of the distinct texts of docs that the filters of a run let through. A
        filter meets the digests of its cell in one task, ahead of them."""

        def ask(batches: Iterator) -> Iterator:
            import pyarrow as pa

            current, bits = None, None
            for batch in batches:
                keep = []
                for cell, own, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if own is not None:
                        current, bits = cell, np.frombuffer(own, np.uint8)
                        keep.append(False)
                    else:
                        keep.append(cell == current and bool(maybe_in(bits, [d])[0]))
                yield batch.select(["digest"]).filter(pa.array(keep, pa.bool_()))

        filters = self.spark.read.schema("cell int, bits binary").parquet(f"{self.path}/filters/{run}")
        asked = compact(sorted_runs(docs, id_col, text_col)).select(_first_bytes(2).alias("cell"), F.lit(None).cast("binary").alias("bits"), "digest")
        both = filters.withColumn("digest", F.lit(None).cast("binary")).unionByName(asked)
        dealt = both.repartition("cell").sortWithinPartitions("cell", F.col("digest").asc_nulls_first())
        return dealt.mapInArrow(ask, "digest binary").withColumn("bucket", _first_bytes(1) % BUCKETS)

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The entries of the index that texts of docs have: digest, min_id, max_id, n. Of a run
        only what its filters let through is joined; buckets without any are not read."""
        found = self.spark.createDataFrame([], RUN_SCHEMA)
        for run in self.live():
            asked = materialize(self.candidates(docs, run, id_col, text_col), "lsm-asked")
            buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
            rows = self._run(run).where(F.col("bucket").isin(buckets)) if buckets else self._run(run).where("false")
            found = found.unionByName(rows.join(asked.select("digest"), "digest", "left_semi").drop("bucket"))
        return compact(found)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """id, keep_id, group_size, kept, digest (sha256 of the normalised text), mark (sha256 of the
    text itself, hex) of every row.

    keep: 'smallest' or 'largest' id of a group stays. Only rows of groups with two or more
    rows are hits; the filter lets their bytes travel once, keyed by digest, and they are compared
    with those of the row that stays. Rows whose bytes differ at an equal digest would form groups
    of their own by bytes; for SHA-256 no such texts are known, so the job fails if it meets any.
    """
    level = materialize(compact(sorted_runs(docs, id_col, text_col)), "lsm-level")
    keeper = F.col("min_id" if keep == "smallest" else "max_id")
    hits = level.where("n > 1").select("digest", keeper.alias("keep_id"), "n")
    shared = docs.sparkSession.sparkContext.broadcast(level_filter(hits))

    def passed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lowered = [t.translate(LOWER_AZ) for t in text_bytes(batch.column(1))]
            digests = [hashlib.sha256(t).digest() for t in lowered]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            columns = (batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(lowered, pa.binary()))
            whole = pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], ["id", "mark", "digest", "body"])
            yield whole.filter(pa.array(maybe_in(shared.value, digests)))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.sha2(text, 256).alias("mark"))
    keyed = rows.mapInArrow(passed, "id long, mark string, digest binary, body binary")
    single = level.where("n = 1").select(
        F.col("min_id").alias("id"), F.col("min_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest", F.lit(None).cast("string").alias("mark"),
    )
    # The reference rows are found by digest and id, which spreads a large group over tasks.
    # The join of all copies with them then stands alone, so a skewed digest is split at run time.
    wanted = hits.withColumnRenamed("digest", "d")
    reference = keyed.join(wanted, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("keep_id")))
    reference = reference.dropDuplicates(["digest", "id"]).select("digest", "keep_id", "n", F.col("body").alias("reference"))
    reference = materialize(reference, "lsm-reference")
    checked = keyed.join(reference, "digest").select(
        "id", "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "mark",
        F.when(F.col("body") == F.col("reference"), True)
        .otherwise(F.raise_error(F.lit("texts differ at an equal digest")).cast("boolean"))
        .alias("verified"),
    )
    return checked.where("verified").drop("verified").unionByName(single)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts one row.
    Rows are known by id and text together, so one that shares its id with a copy stays. Of texts
    that differ in the case of A-Z alone under one id, the one with the least digest stays; of
    repeated rows any."""
    # written as it is found, so that the join with a very frequent text stands alone and is split
    with scratch() as hold:
        found = exact_duplicates(docs, id_col, text_col, keep).where("group_size > 1").select("id", "mark", "digest", "kept")
        found = hold(materialize(found, "lsm-found"))
    kept = found.where("kept")
    stays = kept.groupBy("digest").agg(F.min("mark").alias("mark"), F.max("id").alias("id"), F.count("*").alias("n"))
    beside = kept.join(stays, ["digest", "mark"], "left_anti")
    named = (F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    # as a table, whose size the planner knows: a small one is sent to the rows, which then stay in place;
    # with a large one only the rows meet that a filter of its ids lets pass
    gone = materialize(found.where("not kept").unionByName(beside).select(*named), "lsm-gone")
    mark = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)

    twice = stays.where("n > 1").select(*named)
    several = not twice.isEmpty()
    named_rows = gone.unionByName(twice) if several else gone
    asked, others = met_and_others(docs, docs[id_col], named_rows.select("gone_id"))

    def join(marks: DataFrame, how: str) -> DataFrame:
        return asked.join(marks, docs[id_col].cast("long").eqNullSafe(marks["gone_id"]) & (mark == marks["gone_mark"]), how)

    rest = others.unionByName(join(named_rows, "left_anti"))
    if not several:
        return rest
    # repeated rows of a text that stays: one of them is taken beside the rest
    name = "mark" + "_" * max(map(len, docs.columns))
    one = join(twice, "left_semi").withColumn(name, mark).dropDuplicates([id_col, name]).drop(name)
    return rest.unionByName(one)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir), keep="largest")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
