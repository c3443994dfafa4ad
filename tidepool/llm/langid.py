"""Language identification by nearest centroid.

Texts become TF-IDF vectors over hashed byte n-grams (two and three bytes of the lower-cased
text, everything but letters taken as one space), of length 1. Each language has several
centroids, found by spherical k-means; a text gets the language of the centroid with the
largest cosine. A text whose distance to it exceeds that of nearly all training texts of the
language is flagged as rejected.

Document frequencies are counted over all training rows. The centroids are fitted on a bounded
sample: about ROWS_PER_LANGUAGE rows of each language, chosen by a hash of id and text. The model
has CENTROIDS vectors of BUCKETS numbers for each language, which is what reaches the driver.

Null texts and texts without a letter get ``und`` and score 0; rows with a null
language teach nothing (an empty one is a language); with nothing learned every row is ``und``. Whole texts count, however
long. Ties go to the language that sorts first. Repeated rows get equal results. Empty tables
give empty results. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import chunks, documents, held_out

BUCKETS = 1 << 13
ROWS_PER_LANGUAGE = 1000
CENTROIDS = 4
#: Share of a language's training texts that lie beyond its rejection distance.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
_LATIN = re.compile("[A-Za-z]")
#: Rows that are one dense block while vectors are made.
_BLOCK = 256
_ASCII = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LATIN.search(text)) or any(c.isalpha() for c in text))


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    rows = [t.lower().encode("utf-8", "surrogatepass").translate(_ASCII) for t in texts]
    n = len(rows)
    size = np.array([len(r) for r in rows], dtype=np.int64)
    if not size.sum():
        return np.zeros((n, BUCKETS), np.float32)
    b = np.frombuffer(b"".join(rows), dtype=np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(n, dtype=np.int64), size) * BUCKETS
    out = np.zeros(n * BUCKETS, np.int64)
    two = b[:-1] | b[1:] << np.uint32(8)
    for width, code in ((2, two), (3, two[:-1] | b[2:] << np.uint32(16))):
        if not len(code):
            continue
        keep = (of[: len(code)] == of[width - 1 :][: len(code)]) & ~((b[: len(code)] == 32) & (b[width - 1 :][: len(code)] == 32))
        bucket = (code * np.uint32(0x9E3779B1) + np.uint32(width)) >> np.uint32(19)
        out += np.bincount(of[: len(code)][keep] + bucket[keep], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1))[:, None]


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids of unit rows: the first is the row nearest to the mean, each further
    one the row farthest from those before."""
    at = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[at[0]]
    while len(at) < min(k, len(x)) and nearest.min() < 1 - 1e-6:
        at.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[at[-1]])
    c = x[at].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (of == i).any():
                c[i] = x[of == i].mean(axis=0)
        c /= np.maximum(1e-9, np.linalg.norm(c, axis=1))[:, None]
    return c


class Model:
    """idf, centroids, the language of each, and each one's least accepted cosine."""

    def __init__(self, idf, centroids, languages, least):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        near = vectors(texts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        return [(self.languages[b], float(min(1.0, max(0.0, near[i, b]))), bool(near[i, b] < self.least[b])) for i, b in enumerate(best)]


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many of all rows hold each bucket, and the number of rows with a letter. Tasks sum
    what they see; BUCKETS + 1 sums reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in chunks(batches):
            texts = [t for t in batch.column(0).to_pylist() if has_letter(t)]
            for i in range(0, len(texts), _BLOCK):
                df[:BUCKETS] += (counts(texts[i : i + _BLOCK]) > 0).sum(axis=0)
            n += len(texts)
        df[BUCKETS] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["bucket", "n"])

    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE, centroids: int = CENTROIDS,
) -> Model | None:
    """Learn from the rows of docs that have a language."""
    known = _rows(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    df, n = document_frequencies(known, "text")
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # by id and text, each once, so that neither repeated rows nor one id of many rows make a sample large; the
    # share is of as many as differ, so that a row that is repeated often leaves room for all others
    differing = F.approx_count_distinct(F.xxhash64("id", "text"), 0.02)
    shares = known.groupBy("lang").agg((F.lit(float(rows_per_language)) / F.greatest(differing, F.lit(1))).alias("share"))
    # a row for each language, of which the model that is sent anyway has 128 KB
    picked = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    picked = picked.select("id", "text", "lang").distinct()

    def learn(frame):
        import pandas as pd

        frame = frame.sort_values(["id", "text"])
        texts = [t for t in frame["text"] if isinstance(t, str) and has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "least": [], "centroid": []})
        x = np.concatenate([vectors(texts[i : i + _BLOCK], idf) for i in range(0, len(texts), _BLOCK)])
        c = spherical_means(x, centroids)
        near = x @ c.T
        own = near.argmax(axis=1)
        least = [float(np.quantile(near[own == i, i], REJECTED_SHARE)) if (own == i).any() else 1.0 for i in range(len(c))]
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "least": least, "centroid": [r.tobytes() for r in c]})

    found = picked.groupBy("lang").applyInPandas(learn, "lang string, least double, centroid binary").collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["centroid"])))
    matrix = np.stack([np.frombuffer(bytes(r["centroid"]), dtype=np.float32) for r in found])
    return Model(idf, matrix, [r["lang"] for r in found], [r["least"] for r in found])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (cosine, 0 to 1) and rejected of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            found: list = [(UNKNOWN, 0.0, True)] * len(texts)
            use = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for a in range(0, len(use), _BLOCK):
                part = use[a : a + _BLOCK]
                for i, f in zip(part, model.predict([texts[i] for i in part])):
                    found[i] = f
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[k] for f in found], kinds[k]) for k in range(3))],
                ["id", "lang_pred", "score", "rejected"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    return identify(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected"
    )
