import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tidepool.llm import votes

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def naive_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    eight = lambda h: h.to_bytes(8, "little")
    pairs = {xxhash.xxh64_intdigest(eight(b), xxhash.xxh64_intdigest(eight(a), 42)) for a, b in zip(hashes, hashes[1:])}
    terms = [(h, votes.WORD) for h in set(hashes)] + [(h, votes.PAIR) for h in pairs]
    out = []
    for number in (0, 1):
        value = 0
        for bit in range(64):
            vote = 0
            for h, weight in terms:
                h = xxhash.xxh64_intdigest(eight(h), 42) if number else h
                vote += weight if h >> bit & 1 else -weight
            value |= (vote > 0) << bit
        out.append(signed(value))
    return tuple(out)


def naive(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        out.append((k, i, len(text), hashlib.sha256(changed.encode()).hexdigest(), *naive_print(text), *naive_print(changed)))
    return out


@pytest.mark.parametrize("parts", [None, 1, 5, 40])
def test_odd_rows(spark, odd, parts):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()] + [(None, "another null"), (13, "same id"), (200, "x"), (300, "HELLO world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("next", F.lit("clash")).withColumn("_w", F.lit(2))
    got = sorted(tuple(r) for r in votes.compared(docs, parts=parts).collect())
    assert got == naive(rows)


def test_query_over_the_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    wanted = naive(rows)
    got = {r.doc_id: r for r in votes.op13_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    apart = lambda x, y: sum(((p ^ q) & MASK).bit_count() for p, q in zip(x, y))
    better = 0
    for k, (_, i, n, digest, a, b, c, d) in enumerate(wanted):
        r, following = got[i], wanted[(k + 1) % len(wanted)]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.fingerprint == f"{a & MASK:016x}{b & MASK:016x}" and r.edited_fingerprint == f"{c & MASK:016x}{d & MASK:016x}"
        assert r.near_edited == 1 - apart((a, b), (c, d)) / 128 and r.near_next == 1 - apart((a, b), following[4:6]) / 128
        near = sum(apart((a, b), w[4:6]) <= votes.RADIUS for w in wanted) - 1
        assert r.n_near == (near if i % votes.ASKED == 0 else None)
        better += r.near_edited > r.near_next
    assert better >= 0.97 * len(wanted)


@pytest.mark.parametrize("radius, lead", [(3, 1), (3, 2), (6, 2), (0, 1)])
def test_block_tables_find_all(spark, radius, lead):
    draw = random.Random(radius * 10 + lead)
    prints = {(signed(draw.getrandbits(64)), signed(draw.getrandbits(64))) for _ in range(40)} | {(0, 0), (-1, -1)}
    for a, b in list(prints):
        for _ in range(4):
            whole = (a & MASK) | (b & MASK) << 64
            for bit in draw.sample(range(128), draw.randint(1, radius + 2)):
                whole ^= 1 << bit
            prints.add((signed(whole & MASK), signed(whole >> 64)))
    table = spark.createDataFrame(sorted(prints), "a long, b long")
    got = [tuple(r) for r in votes.within(table, table, radius, lead).collect()]
    wanted = {}
    for x, y in combinations(sorted(prints), 2):
        d = ((x[0] ^ y[0]) & MASK).bit_count() + ((x[1] ^ y[1]) & MASK).bit_count()
        if d <= radius:
            wanted[(*x, *y)] = wanted[(*y, *x)] = d
    wanted |= {(*x, *x): 0 for x in prints}
    assert len(got) == len(wanted) and {r[:4]: r[4] for r in got} == wanted


def test_empty_and_single(spark, empty):
    assert votes.compared(empty).count() == 0
    one = spark.createDataFrame([(7, "alone in here")], "doc_id long, text string")
    assert [tuple(r) for r in votes.compared(one).collect()] == naive([(7, "alone in here")])
