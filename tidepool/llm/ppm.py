"""Language-model scoring: prediction by partial matching over bytes, and a word baseline.

The model is a trie of byte contexts of up to ORDER bytes with the counts of the bytes that
follow. A byte that its context has not seen is coded by an escape (method C: an escape counts
as often as there are distinct bytes in the context) and then in the next shorter context,
where the bytes already ruled out are excluded; below the empty context all bytes left are
equally likely. A text ends with a symbol of its own (0xFF, which UTF-8 never holds; the same
byte stands before its start), so the probabilities of all texts sum to 1. The score is the
log10 probability of the lower-cased text, the code length of a pretrained model; the
probability of a byte depends on the ORDER bytes before it alone, so that known n-grams are
looked up and only unknown ones go through the escapes.

Every training text is counted, whole, and every context is a node of the trie, which is a table
keyed by context. The probabilities of the most frequent n-grams (at most FREQUENT_GRAMS) are sent
to the tasks as a cache; the other n-grams of a text are joined: those that were seen with their
probability, the rest with the nodes of their contexts, from the longest to the shortest. The
frequent words (at most FREQUENT_WORDS) are sent to the tasks, all others are joined by word. What
is sent does not change results.

Null texts count as empty: one end token, and the model's probability of the empty text. With
no training text, N and V are 0 and the model is uniform over bytes. Repeated rows are scored
each for itself, also with one id. Whole texts are scored. Empty tables give empty results. Extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import LOWER_AZ, WORD_BYTES, chunks, documents, held_out, materialize, text_bytes

ORDER = 5
FREQUENT_GRAMS = 1 << 20
FREQUENT_WORDS = 1 << 17
#: Words that a task counts before it hands its sums on.
HELD_WORDS = 200_000
END = 0xFF
_WORDS = re.compile(WORD_BYTES)
_MASKS = [(1 << 8 * (k + 1)) - 1 for k in range(8)]


def gram_codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end, the context and the byte as one number (the
    byte lowest); and the n+1 bounds of the texts."""
    pad = bytes([END]) * order
    raw = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.r_[0, np.cumsum(size)]
    code = np.zeros(len(raw) - order, np.uint64)
    for i in range(order + 1):
        code = code << np.uint64(8) | raw[i : len(raw) - order + i]
    keep = np.ones(len(code), bool)  # all but those that begin in one text and end in the next's padding
    for j, at in enumerate((bounds[1:-1] + order * np.arange(len(texts) - 1)).tolist()):
        keep[at : at + order] = False
    return code[keep], bounds


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(of, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def corpus_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """word (binary), gram (long), n: counts of all words (the empty word: ends of texts)
    and of all n-grams of the lower-cased texts. A row has a word or a gram."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(words, grams, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["word", "gram", "n"]
            )

        def counted(words):
            keys = list(words)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield out(part, [None] * len(part), [words[k] for k in part])

        words: Counter = Counter()
        grams: list = []
        for batch in chunks(batches):
            texts = [t.translate(LOWER_AZ) for t in text_bytes(batch.column(0))]
            for t in texts:
                words.update(_WORDS.findall(t))
            words[b""] += len(texts)
            grams.append(np.unique(gram_codes(texts, order)[0], return_counts=True))
            if len(grams) >= 8:
                grams = [_merge(grams)]
            if len(words) >= HELD_WORDS:
                yield from counted(words)
                words = Counter()
        yield from counted(words)
        if grams:
            keys, n = _merge(grams)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000].astype(np.int64)
                yield out([None] * len(part), part, n[i : i + 50_000])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count in a geometric scale (four steps to the double) that at most `most`
    rows reach. A few hundred sums reach the driver."""
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).count().collect()
    total = 0
    for step, n in sorted(steps, reverse=True):
        total += n
        if total > most:
            return math.floor(2 ** ((step + 1) / 4)) + 1
    return 1


def trie_nodes(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """length, context (long), total, counts (map: byte -> times): a node for every context of up
    to `order` bytes of the n-grams of corpus_counts(). A node has 256 bytes at most. The counts
    of a length are summed from those of the next longer one."""
    grams = counts.where("gram is not null").select("gram", "n")
    levels = [grams]
    for k in range(order - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit(_MASKS[k])).alias("gram")
        levels.append(levels[-1].groupBy(shorter).agg(F.sum("n").alias("n")))
    every = None
    for k, level in zip(range(order, -1, -1), levels):
        own = level.select(F.lit(k).alias("length"), F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
        every = own if every is None else every.unionByName(own)
    following = F.map_from_entries(F.collect_list(F.struct("byte", "n")))
    return every.groupBy("length", "context").agg(F.sum("n").alias("total"), following.alias("counts"))


def known_grams(nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, value (log10 probability of its byte) of the n-grams with the longest context."""
    top = nodes.where(F.col("length") == order)
    each = top.select("context", F.size("counts").alias("d"), "total", F.explode("counts").alias("byte", "n"))
    gram = F.shiftleft("context", 8).bitwiseOR(F.col("byte").cast("long"))
    return each.select(gram.alias("gram"), "n", F.log10(F.col("n") / (F.col("total") + F.col("d"))).alias("value"))


def escaped(grams: DataFrame, nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, value: log10 probability of the byte of each n-gram (distinct ones of a column gram)
    by escapes from the longest context to the empty one, with exclusion. A length is one join
    with the nodes of that length; an n-gram that is coded meets none any more."""
    state = grams.select("gram", F.lit(0.0).alias("value"), F.lit(True).alias("open"), F.array().cast("array<int>").alias("ruled_out"))
    for k in range(order, -1, -1):
        own = nodes.where(F.col("length") == k).select(F.col("context").alias("own"), "total", "counts")
        if k < 2:  # 257 contexts at most
            own = F.broadcast(own)
        context = F.shiftright("gram", 8).bitwiseAND(F.lit(_MASKS[k - 1] if k else 0))
        # one that is coded gets a key of its own, below all contexts
        key = F.when(F.col("open"), context).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("gram"), 1))
        met = state.withColumn("key", key).join(own, F.col("key") == F.col("own"), "left")
        known, n = F.col("own").isNotNull(), F.try_element_at("counts", F.col("gram").bitwiseAND(F.lit(255)).cast("int"))
        covered = F.aggregate("ruled_out", F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.try_element_at("counts", b), F.lit(0)))
        left = met.select(
            "gram", "value", "open", "ruled_out", "counts", known.alias("known"), n.alias("n"),
            (F.col("total") - covered).alias("t"), (F.size("counts") - F.size("ruled_out")).alias("d"),
        )
        weight = F.coalesce("n", F.col("d").cast("long"))  # without a byte left, the escape is certain
        step = F.when(F.col("known") & (weight > 0), F.log10(weight / (F.col("t") + F.col("d")))).otherwise(0.0)
        state = left.select(
            "gram", (F.col("value") + step).alias("value"), (F.col("open") & ~(F.col("known") & F.col("n").isNotNull())).alias("open"),
            F.when(F.col("known"), F.map_keys("counts")).otherwise(F.col("ruled_out")).alias("ruled_out"),
        )
    return state.select("gram", F.when(F.col("open"), F.col("value") - F.log10(F.lit(256) - F.size("ruled_out"))).otherwise(F.col("value")).alias("value"))


class Cache:
    """log10 probabilities of frequent n-grams in a table of slots; of two n-grams in one slot the
    more frequent one stays, the other is looked up like a rare one."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(grams) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, (1 << 64) - 1, np.uint64), np.zeros(1 << self.bits)
        order = np.lexsort((grams, n))
        at = self._slot(grams[order])
        self.keys[at], self.values[at] = grams[order], values[order]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where unknown), and which are known."""
        at = self._slot(grams)
        known = self.keys[at] == grams
        return np.where(known, self.values[at], 0.0), known


_ROWS = "uid long, id long, word binary, gram long, n long, n_tokens long, n_known long, base double, score double"


def score(
    docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    order: int = ORDER, most_words: int = FREQUENT_WORDS, most_grams: int = FREQUENT_GRAMS,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row of docs under the
    counts of a training corpus (a written table: it is read more than once). Results do not
    depend on most_words and most_grams, which bound what is sent to the tasks."""
    spark = docs.sparkSession
    words = counts.where("word is not null").select("word", "n")
    v, n = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = n + v + 1
    least = least_count(words, most_words)
    kept = words.where(F.col("n") >= least).toArrow()
    frequent = {w: math.log10((c + 1) / floor) for w, c in zip(kept["word"].to_pylist(), kept["n"].to_pylist())}
    end = words.where(F.length("word") == 0).first()
    end_known, end_log = bool(end), math.log10(((end["n"] if end else 0) + 1) / floor)
    nodes = materialize(trie_nodes(counts, order), "ppm-nodes", ("length",))
    grams = known_grams(nodes, order)
    kept = grams.where(F.col("n") >= least_count(grams, most_grams)).toArrow()
    cache = Cache(*(kept[c].to_numpy().astype(t) for c, t in (("gram", np.uint64), ("n", np.int64), ("value", float))))
    del kept
    shared = spark.sparkContext.broadcast((frequent, cache))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        known, cached = shared.value
        get = known.get
        uid = TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["uid", "id", "word", "gram", "n", "n_tokens", "n_known", "base", "score"]

        def out(**columns):
            size = len(columns["uid"])
            zero = lambda k: pa.nulls(size, k) if k == pa.binary() else pa.array(np.zeros(size, k.to_pandas_dtype()))
            fill = {c: pa.nulls(size, pa.int64()) for c in ("id", "gram")}
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c], k) if c in columns else fill.get(c, zero(k)) for c, k in zip(names, kinds)], names
            )

        for batch in chunks(batches):
            texts = [t.translate(LOWER_AZ) for t in text_bytes(batch.column(1))]
            codes, bounds = gram_codes(texts, order)
            values, found = cached.find(codes)
            scores = np.add.reduceat(values, bounds[:-1])
            missed = np.flatnonzero(~found)
            if len(missed):  # each n-gram once for a text
                at = np.searchsorted(bounds, missed, side="right") - 1
                by = np.lexsort((codes[missed], at))
                at, own = at[by], codes[missed][by]
                first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
                yield out(uid=uid + at[first], gram=own[first].astype(np.int64), n=np.diff(np.r_[first, len(own)]))
            rows: list[list] = [[], [], []]
            bases, knowns, totals = [], [], []
            for i, text in enumerate(texts):
                tokens = _WORDS.findall(text)
                base, seen = end_log, int(end_known)
                for w, k in Counter(tokens).items():
                    value = get(w)
                    if value is None:
                        for column, x in zip(rows, (uid + i, w, k)):
                            column.append(x)
                    else:
                        base += k * value
                        seen += k
                bases.append(base)
                knowns.append(seen)
                totals.append(len(tokens) + 1)
            yield out(uid=rows[0], word=rows[1], n=rows[2])
            # a key of its own, which no word has, deals this row to some task of the join
            ids = np.arange(uid, uid + len(texts))
            yield out(uid=ids, id=batch.column(0), word=[b" %d" % u for u in ids], n_tokens=totals, n_known=knowns, base=bases, score=scores)
            uid += len(texts)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _ROWS)
    rows = materialize(rows, "ppm-rows")
    rare = words.where((F.col("n") < least) & (F.length("word") > 0)).withColumnRenamed("n", "c")
    of_words = rows.where("word is not null").join(rare, "word", "left")
    rare_base = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(floor)))
    zero = F.lit(0).cast("long")
    of_words = of_words.select(
        "uid", "id", "n_tokens", (F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + rare_base).alias("base"), "score",
    )
    wanted = rows.where("gram is not null").select("uid", "gram", "n")
    met = materialize(wanted.join(grams.select("gram", "value"), "gram", "left"), "ppm-met")
    unseen = materialize(escaped(met.where("value is null").select("gram").distinct(), nodes, order), "ppm-unseen")
    seen = met.where("value is not null").select("uid", "n", "value")
    seen = seen.unionByName(met.where("value is null").drop("value").join(unseen, "gram").select("uid", "n", "value"))
    of_grams = seen.select(
        "uid", F.lit(None).cast("long").alias("id"), zero.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("base"),
        (F.col("n") * F.col("value")).alias("score"),
    )
    return (
        of_words.unionByName(of_grams)
        .groupBy("uid")
        .agg(
            F.max("id").alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"), F.sum("score").alias("score"),
        )
        .select("id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counts = materialize(corpus_counts(docs.where(~held_out("doc_id", 7, 2))), "ppm-counts")
    return score(docs, counts).select(
        F.col("id").alias("doc_id"), held_out("id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )
