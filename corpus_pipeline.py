"""A corpus pipeline of training-data operators: quality, exact copies, near copies, secrets,
packing. Each stage takes all that its predecessor kept; all but the last return documents.

Every stage gives an empty table for an empty one, keeps columns that it does not know, whatever
their names, and reads whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import exact_dedup, packing, quality, secrets, simhash
from tidepool.llm.common import documents, labels, materialize, release
from tidepool.shipping import ensure_importable

#: Rows of an Arrow batch at most: with whole texts, Spark's 10,000 are tens of MB, which the JVM and
#: each Python worker hold several times over.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def _begin(spark: SparkSession) -> None:
    """What each stage does first. A smaller bound of the session's own stays."""
    ensure_importable(spark)
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the positive-unlabelled classifier accepts. A null text is judged as the empty
    text, equal texts are judged alike, a score at the threshold is accepted. Without trusted
    labels all rows stay."""
    _begin(spark)
    return quality.accept(docs, quality.train(docs, labels(spark, sf_dir)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (but for the case of A-Z): that of the least id. Null
    and empty texts are one group; a null id ranks below all others; of repeated rows one stays;
    a row that shares its id with a copy, but not the text, stays."""
    _begin(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts (five-word shingles, similarity 0.8 or more). Texts
    without words resemble none; a text of fewer than five words is one shingle; repeated rows
    stay or go together; rows without an id, and rows that share one, are told apart by texts."""
    _begin(spark)
    return simhash.drop_similar(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of secrets, also of encoded ones; n_chars follows. Null texts stay
    null, equal texts change alike, overlapping spans get one mark."""
    _begin(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of texts, placed in sequences. A null text is the separator alone; repeated rows are
    packed as often as they occur; pieces of equal size go in the order of the sorted rows."""
    import public_tokenizers

    _begin(spark)
    return packing.packed_columns(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: SQL can't express the classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, last = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"), before
        if last is not None:
            release(last)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
