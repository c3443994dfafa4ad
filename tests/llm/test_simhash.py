import random
import re

import pytest
import xxhash

from tidepool.llm import simhash

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """prints: {node: value}; the least node that links reach."""
    root = {n: n for n in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(prints)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t, 3) for i, t in docs.items()}
    groups = brute_components(prints, 2)
    rows = simhash.op6_simhash(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == groups[r["doc_id"]]


def test_edge_cases(spark, odd, empty):
    got = {r["id"]: r for r in simhash.near_duplicates(odd, shingle_words=3).collect()}
    for r in odd.where("doc_id is not null").collect():
        assert got[r["doc_id"]]["fingerprint"] & (2**64 - 1) == brute_fingerprint(r["text"], 3)
    assert {got[i]["component_id"] for i in (1, 2, 3, 4)} == {1}
    assert got[13]["component_id"] == -3 and got[-3]["component_id"] == -3
    assert simhash.near_duplicates(empty).count() == 0


def near(rng, n):
    """Random values, chains of values one or two bits apart, and dense balls."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(30):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            out.add(v)
    v = rng.getrandbits(64)
    out |= {v ^ 1 << a ^ 1 << b for a in range(14) for b in range(a)}
    return sorted(out)


@pytest.mark.parametrize("shard", [20_000, 8])
def test_links_lose_no_component(spark, shard):
    values = near(random.Random(5), 300)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    stars = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 2, shard)).collect()}
    want = brute_components(dict(zip(values, values)), 2)
    by_root, by_want = {}, {}
    for v, s in zip(values, signed):
        by_root.setdefault(stars.get(s, s), set()).add(v)
        by_want.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_a_hot_band_is_split_before_it_is_held(spark):
    """40,000 fingerprints that share a band: no shard holds more than the bound, and those within
    the radius still meet in one."""
    rng = random.Random(9)
    base = [rng.getrandbits(43) << 21 for _ in range(20_000)]  # the lowest band is equal in all
    values = sorted({v ^ d for v in base for d in (0, 1 << rng.randrange(21, 64) | 1 << rng.randrange(21, 64))})
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long")
    rows = simhash.shards(frame, 2, 1000).toPandas()
    groups = rows.groupby(["cut", "value"]).fingerprint
    assert len(values) > 35_000 and groups.size().max() <= 1000
    by_value = rows.groupby("fingerprint").apply(lambda g: set(zip(g.cut, g.value)), include_groups=False).to_dict()
    known = set(by_value)
    for v in rng.sample(sorted(known), 50):
        for w in (v ^ (1 << a) ^ (1 << b) for a in range(21, 63, 6) for b in range(21, 63, 5)):
            if w in known and w != v:
                assert by_value[v] & by_value[w]


def test_the_finest_cut_bounds_a_shard():
    parts = simhash.CUTS[-1]
    widths = sorted(bin(ones).count("1") for _, ones in simhash._bands(parts))
    assert 2 ** sum(widths[-simhash.RADIUS :]) <= 16


def test_bk_tree():
    rng = random.Random(1)
    values = near(rng, 200)
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        for radius in (0, 2, 5):
            assert sorted(tree.within(v, radius)) == [x for x in values if (x ^ v).bit_count() <= radius]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}
