"""What the operators of this subpackage share: rows in, work folder, folds, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.shipping import ensure_importable

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Word separators of the contracts: space and \x09-\x0D.
WORD_BYTES = rb"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder shared by all executors (spark.checkpoint.dir). Only where the session names
    none and runs in one process, as in tests, a temporary folder is made and set; a cluster
    without one is an error, since executors would not see each other's files."""
    where = spark.conf.get(CHECKPOINT_KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost
    executors cost nothing that is already written, and columns are pruned on rereading."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if held := _SCRATCH.get():
        held[-1].append(out)
    return out


#: Lists of tables, one for each scratch() that is open in this thread.
_SCRATCH: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that materialize() writes within, but for those given to the function that
    this yields. For steps whose results no longer read what they were made from."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _SCRATCH.get()
    _SCRATCH.set((*outer, own))

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _SCRATCH.set(outer)
        for table in own:
            if not any(table is k for k in kept):
                release(table)
        if outer:
            outer[-1].extend(kept)


def release(table: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits of a filter of keys at most; it is sent to the rows.
FILTER_WORDS = 1 << 18


def met_and_others(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (long, or null) may be in the one column of `keys`, with all that are, and the
    rows whose key is not there. A Bloom filter of the keys decides, so that a join with a table that
    is too large to be sent moves few rows besides those that it meets. A key is four bits of one word;
    beyond FILTER_WORDS more rows pass."""
    words = min(FILTER_WORDS, 1 << (keys.count() // 4).bit_length())

    def placed(k: Column) -> tuple[Column, Column]:
        h = F.xxhash64(k)
        bits = (F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(4))
        return F.pmod(F.shiftright(h, 24), F.lit(words)), reduce(Column.bitwiseOR, bits)

    at, bits = placed(keys[keys.columns[0]].cast("long"))
    held = keys.select(at.alias("filter_word"), bits.alias("bits")).groupBy("filter_word").agg(F.bit_or("bits").alias("filter_bits"))
    at, bits = placed(key.cast("long"))
    on = (at == held["filter_word"]) & (held["filter_bits"].bitwiseAND(bits) == bits)
    return rows.join(F.broadcast(held), on, "left_semi"), rows.join(F.broadcast(held), on, "left_anti")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def held_out(column: str, modulus: int, remainder: int) -> Column:
    return fold(column, modulus) == remainder


def text_bytes(column) -> list[bytes]:
    """UTF-8 of a string column of an Arrow batch; null counts as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def binary_batch(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and the n+1 offsets of its rows (null: empty)."""
    rows = text_bytes(batch.column(name))
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return np.frombuffer(b"".join(rows), dtype=np.uint8), offsets


def chunks(batches, max_bytes: int = 2 << 20, text: str = "text"):
    """Slices of Arrow batches whose texts hold about max_bytes, so that what NumPy keeps
    beside a slice is bounded; one very long text is a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
        group = (np.cumsum(sizes) // max_bytes).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of a span that are hashed in blocks of eight for all spans at once; longer ones one by one.
_BLOCKS = 64
_FEWER = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slice_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of half-open spans of bytes: block by block, each mixed before the next is
    added, so that no pattern of a text cancels out as it may in a polynomial modulo 2**64."""
    import xxhash

    length = ends - starts
    out = np.full(len(starts), mix(np.array([salt + 1], np.uint64))[0], dtype=np.uint64)
    if not len(starts):
        return out
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[:-8] = buffer
    words = np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    some: np.ndarray | slice = slice(None)
    with np.errstate(over="ignore"):
        for at in range(0, _BLOCKS, 8):
            if at:
                some = np.flatnonzero((length > at) & (length <= _BLOCKS))
                if not len(some):
                    continue
            left = np.minimum(length[some] - at, 8)
            out[some] = mix(out[some] * np.uint64(0x9E3779B97F4A7C15) ^ (words[starts[some] + at] & _FEWER[left]))
        out = mix(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    long = np.flatnonzero(length > _BLOCKS)
    if len(long):
        raw, digest = buffer.tobytes(), xxhash.xxh3_64_intdigest
        out[long] = [digest(raw[a:b], salt) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the sequences that are those of a followed by those of b."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b + np.uint64(0xA0761D6478BD642F)))


def sequence_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of `width` neighbours of an array of hashes, by doubling."""
    if len(items) < width:
        return np.zeros(0, np.uint64)
    n, out, have, step, power = len(items) - width + 1, None, 0, 1, items
    while step <= width:
        if width & step:
            part = power[have : have + n]
            out = part if out is None else joined(out, part)
            have += step
        if 2 * step <= width:
            power = joined(power[:-step], power[step:])
        step *= 2
    return out


def word_bounds(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows of a buffer, and the n+1 bounds of each
    row's words within them. A word never crosses from one row to the next."""
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[buffer]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    return slice_hashes(buffer, starts, ends, salt)
