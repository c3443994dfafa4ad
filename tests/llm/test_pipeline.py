import random

import numpy as np

import corpus_pipeline
from tidepool.llm import secrets, simhash

MID = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def brute_groups(texts, similarity):
    sets = {i: shingles(t) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if jaccard(sets[a], sets[b]) >= similarity:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_similar_documents(spark, odd, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    texts, n = {}, 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[n] = " ".join(own)
            n += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {i: i for i in texts} | {r["id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    want = brute_groups(texts, 0.8)
    assert got == want
    assert simhash.drop_similar(odd).count() == odd.count() - 4
    assert simhash.drop_similar(empty).count() == 0


def test_every_similar_pair_is_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 20)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    common = [rng.choice(words) for _ in range(40)]  # a passage that a third of the texts hold
    texts = {}
    for edits in (2, 3, 4, 5):  # families whose members lie about the wanted similarity
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[len(texts)] = " ".join(own)
    for _ in range(120):
        texts[len(texts)] = " ".join(common + [rng.choice(words) for _ in range(rng.randrange(5, 60))])
    want = brute_groups(texts, 0.8)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rounds in (2, 0):
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        got = {i: i for i in texts} | {r["id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
        assert got == want


def test_shard_tree_equals_a_scan():
    rng = random.Random(4)
    values = [rng.getrandbits(128) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for v in values for _ in range(4)]
    tree = simhash.ShardTree()
    for i, v in enumerate(values):
        tree.add(v, (i,))
    for radius in (0, 2, 4, 60):
        for v in values[:40]:
            want = {i for i, w in enumerate(values) if (v ^ w).bit_count() <= radius}
            assert set(tree.search(v, radius, lambda r, d: True, False)) == want
            (near,) = tree.search(v, radius, lambda r, d: values[r[0]] != v, True) or (None,)
            others = [(v ^ w).bit_count() for w in values if w != v and (v ^ w).bit_count() <= radius]
            assert (near is None) == (not others) and (near is None or (v ^ values[near]).bit_count() == min(others))


def test_fingerprints_are_no_farther_apart_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(100):
        both = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.r_[both, rng.integers(0, 2**63, 40, dtype=np.uint64)], np.r_[both[20:], rng.integers(0, 2**63, 30, dtype=np.uint64)]
        for size in (simhash.SHORT, simhash.PARITY):
            x, y = (int.from_bytes(simhash.parity(s, size), "little") for s in (a, b))
            assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


def test_near_rows_are_dropped_by_id_and_text(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:50], "other", *base[51:]])
    rows = [(1, " ".join(base), "a"), (2, near, "b"), (2, "a text of its own that is like no other one here", "c"), (None, near + " end", "d"),
            (3, None, "e"), (3, "", "f"), (None, "one more text that nothing else resembles at all", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    out = simhash.drop_similar(frame)
    assert out.columns == frame.columns
    assert {"c", "e", "f", "g"} <= {r["id"] for r in out.collect()} and out.count() == 5


def test_near_with_clashing_columns(spark, odd):
    names = ["id", "text_", "__gone", "gone_id", "shared_id", "mark", "number", "own_id", "m", "n", "key", "root", "component_id", "fingerprint"]
    wide = odd.selectExpr("*", *(f"'x' AS {c}" for c in names))
    out = simhash.drop_similar(wide)
    assert out.columns == wide.columns and out.count() == simhash.drop_similar(odd).count()
    for d in (wide, odd):
        assert simhash.near_duplicates(d).count() == odd.count()


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{MID}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, MID)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            good = [i for i, q in marks.items() if q == 1]
            assert sum(i in now for i in good) >= 0.99 * len(good)
            bad = [i for i, q in marks.items() if q == 0]
            assert sum(i in now for i in bad) <= 0.1 * len(bad)
        if name == "exact_dedup":
            lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            least = {}
            for i, t in sorted(before.items()):
                least.setdefault(lower(t or ""), i)
            assert now.keys() == set(least.values())
        if name == "near_dedup":
            groups = brute_groups(before, 0.8)
            roots = {i for i in before if groups[i] == i}
            assert roots <= now.keys()
            assert now.keys() == roots
        if name == "secrets":
            assert now.keys() == before.keys()
            for i, t in before.items():
                assert now[i] == secrets.redacted(t)
        before = now


def test_run(spark):
    out = corpus_pipeline.run(spark, MID).toPandas()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and len(out)
    used = out.groupby("sequence_id").length.sum()
    assert (used <= 2048).all()
