import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepool.llm import ppm
from tidepool.llm.common import held_out, materialize


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_model(texts, order):
    trie = defaultdict(Counter)
    for t in texts:
        s = b"\xff" * order + lower(t).encode() + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                trie[s[i - k : i]][s[i]] += 1
    return trie


def brute_score(trie, text, order):
    s, total = b"\xff" * order + lower(text).encode() + b"\xff", 0.0
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            left = {b: n for b, n in trie.get(s[i - k : i], {}).items() if b not in excluded}
            if s[i] in left:
                total += math.log10(left[s[i]] / (sum(left.values()) + len(left)))
                break
            if left:
                total += math.log10(len(left) / (sum(left.values()) + len(left)))
                excluded |= left.keys()
        else:
            total -= math.log10(256 - len(excluded))
    return total


def brute_base(train, text):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    own = words(text)
    return len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)


def check(spark, docs, train, most_words, most_grams):
    counts = materialize(ppm.corpus_counts(train), "t")
    got = ppm.score(docs, counts, most_words=most_words, most_grams=most_grams).collect()
    texts, known = {r["doc_id"]: r["text"] for r in docs.collect()}, [r["text"] for r in train.collect()]
    trie = brute_model(known, ppm.ORDER)
    assert len(got) == docs.count()
    for r in got:
        n, k, total, base = brute_base(known, texts[r["id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(brute_score(trie, texts[r["id"]], ppm.ORDER), rel=1e-6)


@pytest.mark.parametrize("most_words, most_grams", [(1 << 18, 1 << 20), (3, 3), (1 << 18, 1000)])
def test_equals_brute_force(spark, odd, empty, most_words, most_grams):
    check(spark, odd, odd.where("doc_id % 2 = 1"), most_words, most_grams)
    check(spark, odd, empty, most_words, most_grams)
    check(spark, empty, odd, most_words, most_grams)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    check(spark, docs, docs.where(~held_out("doc_id", 7, 2)), 50, 500)


def test_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame([("abracadabra",), ("abc",), ("",)], "text string")
    nodes = materialize(ppm.trie_nodes(ppm.corpus_counts(frame, order=2), 2), "nodes")
    for context in (b"ab", b"zz", b"\xff\xff", b"ra", b"ca"):
        every = spark.createDataFrame([(context[0] << 16 | context[1] << 8 | b,) for b in range(256)], "gram long")
        got = ppm.escaped(every, nodes, 2).collect()
        assert len(got) == 256 and sum(10 ** r["value"] for r in got) == pytest.approx(1)
        known = {r["gram"]: r["value"] for r in ppm.known_grams(nodes, 2).collect()}
        assert all(known.get(r["gram"], r["value"]) == pytest.approx(r["value"]) for r in got)


def test_cache_never_answers_for_another_gram():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 1 << 48, 500, dtype=np.uint64))
    cache = ppm.Cache(grams, np.arange(len(grams)), grams.astype(float))
    asked = np.concatenate([grams, rng.integers(0, 1 << 48, 500, dtype=np.uint64)])
    values, known = cache.find(asked)
    assert known[: len(grams)].mean() > 0.7 and (values[known] == asked[known].astype(float)).all() and not values[~known].any()


def test_clashing_columns(spark, odd):
    wide = odd.selectExpr("*", *(f"1 AS {c}" for c in ["id", "uid", "word", "gram", "n", "value", "score", "base", "open"]))
    counts = materialize(ppm.corpus_counts(wide), "t")
    a, b = (sorted(map(str, ppm.score(d, counts).collect())) for d in (odd, wide))
    assert a == b


def test_least_count(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [5] * 20 + [100] * 3], "n long")
    assert ppm.least_count(counts, 100) == 1
    for most in (30, 5, 2):
        assert counts.where(f"n >= {ppm.least_count(counts, most)}").count() <= most


def test_beats_the_baseline_on_held_out_texts(spark):
    rows = ppm.op4_lm_score(spark, "/root/testdata/sf0.1").toPandas()
    own = rows[rows.held_out]
    print(own.score.sum(), own.base_score.sum(), own.n_tokens.sum())
    assert own.score.sum() > own.base_score.sum()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert len(rows) == docs.count() and rows.held_out.sum() == docs.where(held_out("doc_id", 7, 2)).count()
