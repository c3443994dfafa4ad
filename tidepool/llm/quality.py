"""Quality classifier by positive-unlabelled learning.

A model over surface features of a text minimises the non-negative unbiased risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the logistic loss.
Positives are trusted rows (quality 1); the unlabelled ones are all texts of the training fold,
whatever their labels. Features never see the id, the source, the language or the label.

The model is linear in fixed functions of the features, and the bound at zero has a smooth bend,
so Newton steps minimise the risk: a step is one pass over the features of every row of the fold,
of which each task sends one gradient and one matrix, and is halved while it does not lessen the
risk. The trusted rows are joined as ids; at most about POSITIVE_ROWS of them (a documented bound
on labelled rows), chosen by a hash.

The class prior is estimated from positives and unlabelled rows alone: a first model is fitted on
half of the positives with PRIOR_GUESS; the prior is its least share of unlabelled rows per share
of the other positives above any score, both with the margin that their numbers ask for. Labels
of 0 are never read.

Null and empty texts get the score of the empty text. Repeated rows, and equal texts, get equal
scores. A score that equals the threshold is accepted. Labels that are repeated count once, by
the larger value; null labels and null ids teach nothing. Without positives every row scores 0.5
and none is rejected. Empty tables give empty results. Extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import (
    binary_batch, chunks, documents, held_out, labels, materialize, scratch, slice_hashes, word_bounds, word_hashes,
)

POSITIVE_ROWS = 20_000
THRESHOLD = 0.7
RIDGES = 100
#: Weight of the squared parameters; Newton steps at most; least gain of a step.
RIDGE, STEPS, TOLERANCE = 0.03, 10, 1e-4
#: The bound of the negative part, max(0, x), is BEND * log(1 + exp(x / BEND)), which is smooth.
BEND = 0.01
#: Prior and steps of the model that the prior is estimated with; bins of its scores.
PRIOR_GUESS, PRIOR_STEPS, BINS = 0.5, 4, 400
#: Arrays of sums that reach the driver at once.
MERGED = 8

_MARKS = b"#*$%&|<>{}[]()=+_/\\~^@!?.,;:'\"-"
_CLASSES = np.full(256, 0, dtype=np.int64)
for _i, _m in enumerate(_MARKS):
    _CLASSES[_m] = 6 + _i
_CLASSES[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASSES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASSES[list(b"0123456789")] = 3
_CLASSES[[32, 9, 11, 12, 13]] = 4
_CLASSES[10] = 5
_CLASSES[128:] = 6 + len(_MARKS)
_KINDS = 7 + len(_MARKS)
FEATURES = _KINDS + 8


def _repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in each row, and how often the most frequent one occurs."""
    with np.errstate(over="ignore"):
        keys = hashes ^ ((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((keys, rows)) if len(keys) else np.zeros(0, np.int64)
    k, r = keys[order], rows[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(k)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[first], counts)
    return np.bincount(r[first], minlength=n), top


def features(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text of a buffer."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(rows * _KINDS + _CLASSES[buffer], minlength=n * _KINDS).reshape(n, _KINDS)
    size = np.maximum(1, np.diff(offsets))[:, None]
    starts, ends, bounds = word_bounds(buffer, offsets)
    hashes = word_hashes(buffer, starts, ends)
    of = np.repeat(np.arange(n), np.diff(bounds))
    words = np.maximum(1, np.diff(bounds))
    distinct, top = _repeats(of, hashes, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    breaks = np.union1d(np.flatnonzero(buffer == 10) + 1, offsets[:-1])
    breaks = breaks[breaks < len(buffer)]
    line_ends = np.r_[breaks[1:], len(buffer)]
    line_rows = np.searchsorted(offsets, breaks, side="right") - 1
    full = line_ends - breaks > 2
    lines = slice_hashes(buffer, breaks[full], line_ends[full], 2)
    line_distinct, _ = _repeats(line_rows[full], lines, n)
    line_count = np.maximum(1, np.bincount(line_rows[full], minlength=n))
    extra = np.stack(
        [
            np.log1p(np.diff(bounds)), np.bincount(of, weights=ends - starts, minlength=n) / words / 8,
            distinct / words, np.sqrt(top / words), np.sqrt(np.bincount(of[same], minlength=n) / words),
            1 - line_distinct / line_count, np.log1p(line_count), (words >= 20).astype(float),
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(counts / size), extra], axis=1).astype(np.float32)


class Model:
    """A linear function of the standardised features, their squares and fixed random ridges."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None):
        rng = np.random.default_rng(7)
        self.mean, self.scale = mean, scale
        self.ridges = rng.normal(0, FEATURES**-0.5, (FEATURES, RIDGES)), rng.uniform(-1, 1, RIDGES)
        self.weights = np.zeros(1 + 2 * FEATURES + RIDGES) if weights is None else weights

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64)
        direction, shift = self.ridges
        # einsum works row by row, so a text's numbers do not depend on the rows beside it
        ridges = np.tanh(np.einsum("ij,jk->ik", z, direction) + shift)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 6, ridges], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.expand(x), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_sums(model: Model, x: np.ndarray) -> np.ndarray:
    """Of unlabelled rows: their number, the sum of the loss as negatives, its gradient and its
    second derivatives, as one array."""
    f = model.expand(x)
    z = f @ model.weights
    p = _sigmoid(z)
    return np.concatenate([[len(x), np.logaddexp(0, z).sum()], p @ f, ((f * (p * (1 - p))[:, None]).T @ f).ravel()])


def minimise(sums, first: Model, positive: np.ndarray, prior: float, steps: int) -> Model:
    """Newton steps on the risk. sums: the function of a model that adds risk_sums() over all
    unlabelled rows; positive: the features of the positives."""
    expanded = first.expand(positive)
    d = expanded.shape[1]
    ridge = np.full(d, RIDGE)
    ridge[0] = 0

    def parts(model):
        """The risk, its gradient and second derivatives."""
        s = sums(model)
        n, f = s[0], expanded @ model.weights
        q = _sigmoid(f)
        negative = s[1] / n - prior * np.logaddexp(0, f).mean()
        total = prior * np.logaddexp(0, -f).mean() + BEND * np.logaddexp(0, negative / BEND) + 0.5 * ridge @ model.weights**2
        part = _sigmoid(np.array(negative / BEND))
        down = s[2 : 2 + d] / n - prior * q @ expanded / len(q)
        own = prior * (expanded * (q * (1 - q))[:, None]).T @ expanded / len(q)
        curve = part * s[2 + d :].reshape(d, d) / n + (1 - part) * own + part * (1 - part) / BEND * np.outer(down, down)
        return total, prior * (q - 1) @ expanded / len(q) + part * down, curve

    model = first
    total, slope, curve = parts(model)
    for _ in range(steps):
        gradient = slope + ridge * model.weights
        move = np.linalg.solve(curve + np.diag(ridge) + 1e-9 * np.eye(d), gradient)
        share, better = 1.0, None
        while better is None and share > 1 / 32:
            tried = Model(model.mean, model.scale, model.weights - share * move)
            after = parts(tried)
            if after[0] < total:
                better = tried
            share /= 2
        if better is None:
            return model
        gain, model = total - after[0], better
        total, slope, curve = after
        if gain < TOLERANCE:
            return model
    return model


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """From histograms of scores: of all cuts the least bound on the share of positives among the
    unlabelled rows, each share with the deviation that its number of rows allows."""
    u, p = unlabelled[::-1].cumsum(), positive[::-1].cumsum()
    n, m = max(1, u[-1]), max(1, p[-1])
    slack = np.sqrt(np.log(40) / 2 / n) + np.sqrt(np.log(40) / 2 / m)
    ratio = (u / n + slack) / np.maximum(p / m, 1e-9)
    best = int(np.argmin(np.where(p / m > slack, ratio, np.inf)))
    return float(np.clip(u[best] / n / max(p[best] / m, 1e-9), 0.01, 0.99))


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            x = features(*binary_batch(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x])], ["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, x binary")


def _sampled(df: DataFrame, key: str, total: int, bound: int) -> DataFrame:
    """About bound of total rows, the same ones each time: those with the smallest hashes. key:
    distinct values."""
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << 30)) < int(bound / total * (1 << 30)))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, FEATURES)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum of part(features) over all batches of a column x. A task sends one array."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                total += part(_matrix(batch.column(0).slice(i, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    each = rows.select("x").mapInArrow(run, "sums binary")
    if each.rdd.getNumPartitions() > MERGED:  # so that few arrays reach the driver
        each = each.repartition(MERGED).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in each.collect()), np.zeros(width))


def train(
    docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    positives: int = POSITIVE_ROWS, prior: float | None = None,
) -> Model | None:
    """Fit on the training fold (crc32 of the id mod 4 is not 2). prior: given, or estimated."""
    with scratch():
        return _trained(docs, marks, id_col, text_col, positives, prior)


def _trained(
    docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, positives: int, prior: float | None
) -> Model | None:
    good = marks.where(~held_out("doc_id", 4, 2) & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    good = good.select(F.col("doc_id").cast("long").alias("trusted")).distinct()
    trusted = F.broadcast(_sampled(good, "trusted", good.count(), positives))
    fold = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out("id", 4, 2))
    rows = _featured(fold, "id", "text").join(trusted, F.col("id") == F.col("trusted"), "left")
    rows = materialize(rows.select("x", F.col("trusted").isNotNull().alias("good")), "quality-features")
    p = _matrix(rows.where("good").select("x").toArrow()["x"].combine_chunks())  # about POSITIVE_ROWS rows
    if not len(p):
        return None
    p = p[np.lexsort(p.T)]  # sums in one order, whatever that of the files
    of_x = lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=float), (x.astype(float) ** 2).sum(axis=0)])
    moments = _summed(rows, of_x, 1 + 2 * FEATURES)
    mean = moments[1 : 1 + FEATURES] / moments[0]
    scale = np.sqrt(np.maximum(0, moments[1 + FEATURES :] / moments[0] - mean**2)) + 1e-3
    first = Model(mean, scale)
    width = 2 + len(first.weights) + len(first.weights) ** 2
    sums = lambda model: _summed(rows, lambda x: risk_sums(model, x), width)
    if prior is None:
        first = minimise(sums, first, p[::2], PRIOR_GUESS, PRIOR_STEPS)
        count = lambda x: np.histogram(first.score(x), BINS, (0, 1))[0].astype(float)
        prior = estimated_prior(_summed(rows, count, BINS), count(p[1::2] if len(p) > 1 else p))
    return minimise(sums, first, p, prior, STEPS)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            x = features(*binary_batch(batch, "text"))
            s = model.score(x).astype(float) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def accept(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, text=text_col):
            yield batch.filter(pa.array(model.score(features(*binary_batch(batch, text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema) if model else docs


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
