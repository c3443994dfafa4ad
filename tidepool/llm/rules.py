"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams, one of trusted target texts
(rows labelled as of good quality), one of the raw corpus (all rows). A text's verdict is the
mean ratio of its n-grams (length-normalised) against a fixed threshold, the same for every
text. The raw counts cover every row, the trusted ones every row that is labelled so.

Base statistics take words as runs of bytes that are no white space (space, \\x09-\\x0D). Null
text counts as empty: no words, base_failed. Whole texts count. Repeated rows, and equal texts
anywhere, get equal results to the last bit; a mean that equals the threshold is kept. A text's
repeated windows are found by two hashes of their words. Without trusted rows the ratio is 0 for
every text and base rules alone decide. Null ids are never trusted. Empty tables give empty
results. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import (
    binary_batch, chunks, documents, labels, mix, sequence_hashes, word_bounds, word_hashes,
)

#: Bytes of an n-gram, and hash buckets.
WIDTH, BUCKETS = 4, 1 << 16
#: Added to each bucket's count in both multinomials.
SMOOTHING = 1.0
#: A text is kept if its mean log ratio is at least this.
THRESHOLD = 0.0
#: Base rules.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"


def buckets(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of a buffer, and the n+1 bounds of each row's n-grams."""
    n = len(buffer) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    code = np.zeros(n, np.uint32)
    for i in range(WIDTH):
        code |= buffer[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - WIDTH + 1) : end] = False
    return code[inside], np.r_[0, np.cumsum(np.maximum(0, np.diff(offsets) - WIDTH + 1))]


def corpus_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all rows and of trusted ones by bucket. trusted: ids, as many as there are. Both
    sides are dealt by id whatever their size, so that shuffled bytes grow with the input."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches):
            found, bounds = buckets(*binary_batch(batch, "text"))
            raw += np.bincount(found, minlength=BUCKETS)
            use = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
            good += np.bincount(found[use], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("trusted")).distinct().hint("shuffle_hash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(ids, F.col("id") == F.col("trusted"), "left").select("text", F.col("trusted").isNotNull().alias("good"))
    sums = rows.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good"))
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b, r, g in sums.collect():  # at most BUCKETS rows
        raw[b], good[b] = r, g
    return raw, good


#: Ratios are summed as whole numbers of 2**-UNIT, so that equal texts get equal bits anywhere.
UNIT = 32


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw)."""
    if not good.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return share(good) - share(raw)


def statistics(buffer: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(offsets) - 1
    starts, ends, bounds = word_bounds(buffer, offsets)
    sums = lambda mark: np.diff(np.r_[0, np.cumsum(mark)][offsets])
    blank = np.isin(buffer, np.frombuffer(_BLANK, np.uint8))
    out = {
        "n_words": np.diff(bounds),
        "word_chars": sums(~blank & ((buffer & 0xC0) != 0x80)),
        "n_symbols": sums(_SYMBOL[buffer]),
    }
    raw, duplicates = buffer.tobytes(), np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(_BLANK)]
        duplicates[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = duplicates
    of = np.repeat(np.arange(n), np.diff(bounds))
    first = np.flatnonzero(np.arange(len(of)) + REPEAT_WINDOW <= np.repeat(bounds[1:], np.diff(bounds)))
    covered = np.zeros(len(of) + 1, np.int64)
    if len(first):
        keys = sequence_hashes(word_hashes(buffer, starts, ends), REPEAT_WINDOW)[first]
        order = np.lexsort((keys, of[first]))
        k, r = keys[order], of[first][order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        if same.any():  # another hash of the words themselves confirms it
            other = sequence_hashes(word_hashes(buffer, starts, ends, 3), REPEAT_WINDOW)[first][order]
            same &= other[1:] == other[:-1]
        twice = first[order[np.r_[False, same] | np.r_[same, False]]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.diff(np.r_[0, np.cumsum(np.cumsum(covered)[:-1] > 0)][bounds])
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def apply_rules(
    docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """id, the statistics, base_failed, log_ratio (mean over the text's n-grams; 0 if it has
    none) and kept of every row. ratio has BUCKETS numbers, whatever the input."""
    weights = np.rint(ratio * (1 << UNIT)).astype(np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            buffer, offsets = binary_batch(batch, "text")
            found = statistics(buffer, offsets)
            grams, bounds = buckets(buffer, offsets)
            total = np.diff(np.r_[0, np.cumsum(weights[grams])][bounds])
            mean = total / np.maximum(1, np.diff(bounds)) / (1 << UNIT)
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in COLUMNS), pa.array(failed),
                    pa.array(mean), pa.array(~failed & (mean >= threshold)),
                ],
                ["id", *COLUMNS, "base_failed", "log_ratio", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"{c} long" for c in COLUMNS)
    return rows.mapInArrow(run, f"id long, {counts}, base_failed boolean, log_ratio double, kept boolean")


def trusted_rows(marks: DataFrame) -> DataFrame:
    """All ids that are labelled as of good quality."""
    return marks.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratio = log_ratio(*corpus_counts(docs, trusted_rows(labels(spark, sf_dir))))
    return apply_rules(docs, ratio).withColumnRenamed("id", "doc_id").select(
        "doc_id", *COLUMNS, "base_failed", "kept", "log_ratio"
    )
