import hashlib
import random
import re
from collections import Counter

import pytest

from tidepool.llm import substrings


def brute(texts, window):
    """texts: a list; words kept and their number for each."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(frame, **options):
    rows = frame.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows], options.get("window", substrings.WINDOW))))
    got = Counter((r["id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substrings.remaining_words(frame, **options).collect())
    assert got == want


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 35)))
    for r in substrings.op8_substrings(spark, "/root/testdata/sf0.01").collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("shard_runs", [2000, 3])
def test_random_overlaps(spark, shard_runs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    texts = []
    for i in range(150):
        words = []
        while len(words) < rng.randrange(0, 120):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            words += p[a:b] if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(8))]
        texts.append((i, rng.choice((" ", "\n", "  ")).join(words)))
    texts += [(500, "x " * 60), (501, "x y " * 30), (502, "x " * 8), (500, "x " * 60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    check(frame, window=9, anchor_words=3, shard_runs=shard_runs)


def thue_morse(length, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(length))


def test_words_and_runs_with_patterns_do_not_collide(spark):
    """A word and its complement collide in any polynomial hash modulo 2**64."""
    rest = [f"w{i}" for i in range(34)]
    texts = [" ".join([*rest[:10], thue_morse(2048, *x), *rest[10:]]) for x in (("a", "i"), ("i", "a"))]
    texts += [" ".join(thue_morse(4096, *x)) for x in (("c", "d"), ("e", "f"))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["id"]: r["n_removed"] for r in substrings.remaining_words(frame).collect()}
    assert rows[0] == rows[1] == 0
    check(frame)
    check(frame, shard_runs=2)


def test_columns_with_clashing_names(spark, odd):
    names = ["id", "body", "z", "at", "n", "kind", "anchor", "places", "words", "hash", "other", "span"]
    wide = odd.selectExpr("*", *(f"'x' AS {c}" for c in names))
    assert sorted(map(tuple, substrings.remaining_words(wide).collect()), key=str) == sorted(map(tuple, substrings.remaining_words(odd).collect()), key=str)


def test_edge_cases(spark, odd, empty):
    check(odd)
    check(odd, window=2, anchor_words=1)
    assert substrings.remaining_words(empty).count() == 0


def test_references(spark):
    long = [f"a{i}" for i in range(60)]
    frame = spark.createDataFrame([(1, "x " + " ".join(long[10:50]) + " y"), (2, " ".join(long[:34])), (3, None)], "doc_id long, text string")
    got = {r["id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in substrings.remove_references(frame, [" ".join(long)]).collect()}
    assert got == {1: (40, "x y"), 2: (0, " ".join(long[:34])), 3: (0, "")}


def test_automaton_counts_occurrences():
    rng = random.Random(0)
    sequences = [[rng.choice("ab") for _ in range(rng.randrange(1, 14))] for _ in range(30)]
    automaton = substrings.SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    total = automaton.occurrences()
    for window in (1, 3, 5):
        seen = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
        for s in sequences:
            want = [i for i in range(len(s) - window + 1) if seen[tuple(s[i : i + window])] > 1]
            assert automaton.repeated(s, window, total) == want
