"""SimHash near-duplicates with BK-trees.

A fingerprint has 64 bits: bit i is 1 if more than half of a text's word shingles (repeats
included) have bit i set in their XXH64. Fingerprints within RADIUS bits of each other are
linked; a component is what links reach.

Equal fingerprints are one node. Links between different ones are found in BK-trees, whose
children are keyed by their Hamming distance to the parent: a search follows only edges within
the radius. One tree over all fingerprints would grow with the corpus, so the trees are
sharded: fingerprints are cut into RADIUS + 1 bands, those that differ in at most RADIUS bits
agree on a band, and each value of a band has its tree. Shards are counted before they are made:
fingerprints of one with more than SHARD of them are cut into more bands, any two of which may
differ, until no shard can be larger; with the finest cut, shards hold 16 fingerprints at most.
A shard does not report its pairs: it joins what it links and reports one edge per fingerprint,
from it to a representative, which keeps every component whole. Components are then found by
alternating large-star and small-star rounds on the edges, written to the shared folder after
each round.

Null texts count as empty; texts without words have fingerprint zero and link like any other.
A text of fewer words than a shingle has its whole word sequence as its one shingle. Whole
texts count. Repeated rows share a fingerprint and a component. Null ids are never a
component's id unless all its ids are null. Fingerprints that are linked in several ways are in one
component all the same. Empty tables give empty results; extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import LOWER_AZ, WORD_BYTES, chunks, documents, materialize, met_and_others, mix, release, scratch, text_bytes

SHINGLE_WORDS = 5
BITS = 64
RADIUS = 2
SEED = 42
#: Fingerprints of one band value that one tree may hold.
SHARD = 20_000
_WORDS = re.compile(WORD_BYTES)


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Of a text in UTF-8; A-Z are lower-cased first."""
    import xxhash

    words = _WORDS.findall(text.translate(LOWER_AZ))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return digest(line, SEED)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    first, last = starts[: len(words) - shingle_words + 1].tolist(), (starts[shingle_words:] - 1).tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # so long texts need no more memory
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """id, fingerprint (long: the 64 bits as a signed number) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, shingle_words) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, fingerprint long")


class BkTree:
    """A node is a list: value, {distance: child}."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, work = [], [self.root] if self.root else []
        while work:
            node = work.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[0])
            for k, child in node[1].items():
                if -radius <= k - d <= radius:
                    work.append(child)
        return found


def shard_edges(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, representative) of the linked values of a shard, by one BK-tree: each value
    asks the tree of those before it, and joins what it finds."""
    tree, parent = BkTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for other in tree.within(v, radius):
            a, b = find(v), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, r) for v in parent if (r := find(v)) != v]


def _bands(parts: int) -> list[tuple[int, int]]:
    """(shift, mask) of the bits that each of `parts` bands holds."""
    cuts = [round(BITS * i / parts) for i in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


#: Numbers of bands of the cuts, coarse to fine. Values of a shard agree on all but RADIUS bands.
CUTS = (12, 32)


def _masks(radius: int, parts: int) -> list[int]:
    """The bits of each choice of parts - radius bands, as signed numbers."""
    from itertools import combinations

    return [sum(ones << shift for shift, ones in chosen) for chosen in combinations(_bands(parts), parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(distinct: DataFrame, radius: int, parts: int) -> DataFrame:
    """cut, value, fingerprint: a row for each choice of bands."""
    each = (
        F.struct(F.lit(parts << 16 | i).alias("cut"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for i, m in enumerate(_masks(radius, parts))
    )
    return distinct.select(F.explode(F.array(*each)).alias("k"), "fingerprint").select("k.cut", "k.value", "fingerprint")


def shards(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """cut, value, fingerprint: shards (cut, value) of which those within the radius share one.
    A shard with more than `most` fingerprints is made of finer cuts instead."""
    out, rest = None, distinct
    for parts in (radius + 1, *CUTS):
        keyed = _keyed(rest, radius, parts)
        if parts == CUTS[-1]:
            return keyed if out is None else out.unionByName(keyed)
        sizes = keyed.groupBy("cut", "value").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > most).select("cut", "value"), "simhash-large")
        if large.isEmpty():
            return keyed if out is None else out.unionByName(keyed)
        small = keyed.join(large, ["cut", "value"], "left_anti")
        out = small if out is None else out.unionByName(small)
        rest = materialize(keyed.join(large, ["cut", "value"], "left_semi").select("fingerprint").distinct(), "simhash-rest")
    return out


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: edges among the distinct fingerprints of a column `fingerprint` that join all
    those within the radius. Rows are dealt to tasks by shard and sorted, so a task holds one
    shard at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, current = [], None
        for batch in batches:
            edges = []
            for cut, value, f in zip(*(c.to_pylist() for c in batch.columns)):
                if (cut, value) != current:
                    edges += shard_edges(held, radius) if len(held) > 1 else []
                    held, current = [], (cut, value)
                held.append(f & 0xFFFFFFFFFFFFFFFF)
            if edges:
                yield _edges(pa, edges)
        if len(held) > 1 and (edges := shard_edges(held, radius)):
            yield _edges(pa, edges)

    dealt = shards(distinct, radius, shard).repartition("cut", "value").sortWithinPartitions("cut", "value", "fingerprint")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(pa, edges: list[tuple[int, int]]):
    both = np.array(edges, dtype=np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: stars of the connected components of (a, b) edges, by alternating
    large-star and small-star rounds. A node's neighbours are never gathered: a round takes
    their minimum, which is summed before the shuffle, and joins it back."""
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"
    )
    mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    before = None
    for _ in range(rounds):
        count, check = now.agg(F.count("*"), mark).first()
        if (count, check) == before or not count:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (count, check)
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, now = now, materialize(small.where("u <> v").distinct(), "stars")
        release(last)
    raise RuntimeError(f"components are not found after {rounds} rounds")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """id, fingerprint (long), component_id (the smallest id reachable) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    nodes = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    stars = components(links(nodes.select("fingerprint"), radius))
    placed = nodes.join(stars, nodes["fingerprint"] == stars["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(roots, "root").select("fingerprint", "component_id")
    return rows.join(known, "fingerprint").select("id", "fingerprint", "component_id")


# ---- near duplicates by similarity ------------------------------------------------------
#
# Rows are linked if the Jaccard similarity of their sets of shingles is at least the wanted one;
# every such pair is found. A set has a parity fingerprint: bit i is 1 if an odd number of its
# shingles hash to i. A shingle flips one bit, so the Hamming distance of two fingerprints is at
# most the number of shingles that the sets do not share, which a similarity of t bounds by
# (1 - t) / (1 + t) of the sum of their sizes. That is the radius of a search in a BK-tree, and
# nothing that is similar lies beyond it (as it may with majority fingerprints, which serve
# near_duplicates(), whose links are defined by them).
#
# The trees are sharded by shingles. All shingles have one order: by their count in the corpus,
# the rarest first, equal counts by hash. Two sets of similarity t share a shingle within the
# first n - ceil(t n) + 1 of each, its head, so each shingle of a head is a shard, and rows that
# are similar share one. Any fixed order would do for that; rare shingles first keep passages
# that many texts hold out of the heads, so counts may be those of COUNTERS counters.
#
# Components alone are wanted, so pairs already joined need no check. In a few rounds each row
# asks a tree of those before it for the nearest row of another component; one that finds none
# joins the tree. Dense families are so joined with work in proportion to the rows. A last round
# asks for all rows of other components within the radius. Candidates are verified by their sets.

SIMILARITY = 0.8
#: Counters that the shingle counts are added up in, as a power of two. Results don't depend on it.
COUNTERS = 1 << 20
#: Counters that are sent at once.
SLICE = 1 << 14
#: Rounds that ask for one row before all remaining pairs are checked.
ROUNDS = 2
#: Rows that a tree may be made of; the rows of a larger shard are dealt over several trees.
TREE = 2048
#: Bits of the fingerprint that trees are made of, and of the longer one that is compared next.
SHORT, PARITY = 128, 1024


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    words = _WORDS.findall(text.translate(LOWER_AZ))
    if not words:
        return np.zeros(0, np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    first, last = starts[: len(words) - shingle_words + 1].tolist(), (starts[shingle_words:] - 1).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], dtype=np.uint64)


def shingle_counts(rows: DataFrame, shingle_words: int) -> np.ndarray:
    """COUNTERS sums of the texts that hold the shingles of a counter; a task sends as many, packed."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        held = np.zeros(COUNTERS, np.int64)
        for batch in chunks(batches):
            found = [np.unique(shingle_hashes(t, shingle_words)) for t in text_bytes(batch.column(1))]
            held += np.bincount((np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        for i in range(0, COUNTERS, SLICE):
            if (part := held[i : i + SLICE]).any():
                packed = zstandard.compress(part.astype(np.uint32).tobytes(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(part), dtype=np.uint32).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    out = np.zeros(COUNTERS, np.int64)
    for r in rows.mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).collect():
        out[r["slice"] : r["slice"] + SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
    return out


def parity(shingles: np.ndarray, size: int = PARITY) -> bytes:
    bits = np.bincount((mix(shingles) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def heads(rows: DataFrame, counts, shingle_words: int, similarity: float) -> DataFrame:
    """id, same (digest of the set), n (its size), short and sketch (its fingerprints), head
    (shingles, rarest first) of rows (id, text) with words. counts: a broadcast of shingle_counts()."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        known = counts.value
        for batch in chunks(batches):
            out: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = np.unique(shingle_hashes(text, shingle_words))
                if not len(own):
                    continue
                length = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                order = np.lexsort((own, known[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                same = xxhash.xxh3_128_digest(own.tobytes())
                for column, x in zip(out, (key, same, len(own), parity(own, SHORT), parity(own), own[order[:length]].view(np.int64))):
                    column.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "same", "n", "short", "sketch", "head"])

    return rows.mapInArrow(run, "id long, same binary, n int, short binary, sketch binary, head array<long>")


def apart(met: DataFrame, nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """met (key, id, pos) with n, short and the component of each id, without the shingles that have but
    one component; `many` is the number of rows of the shingle."""
    own = nodes.select("id", "n", "short").join(stars.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = met.join(own, "id")
    live = placed.groupBy("key").agg(F.count("*").alias("many"), F.min("root").alias("l"), F.max("root").alias("m")).where("l <> m")
    return placed.join(live.select("key", "many"), "key")


class ShardTree:
    """A BK-tree of rows. A node is a list: fingerprint, {distance: child}, row (id, n, pos, root);
    rows of one fingerprint hang below each other at distance 0."""

    def __init__(self):
        self.top = None

    def add(self, value: int, row: tuple) -> None:
        if self.top is None:
            self.top = [value, {}, row]
            return
        node = self.top
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}, row]
                return
            node = child

    def search(self, value: int, radius: int, fits, nearest: bool) -> list[int]:
        """ids of rows within the radius that fit; with `nearest`, of the closest one. Only edges
        are followed whose distance differs from the node's by the radius at most."""
        found, work = [], [self.top] if self.top else []
        while work:
            node = work.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius and fits(node[2], d):
                if nearest:
                    found, radius = [node[2][0]], d - 1
                    if radius < 0:
                        break
                else:
                    found.append(node[2][0])
            for k, child in node[1].items():
                if -radius <= k - d <= radius:
                    work.append(child)
        return found


#: What a row does in a shard: joins the tree, asks it, or both (in a shard of one tree).
JOINS, ASKS, BOTH = 0, 1, 2


def tree_pairs(met: DataFrame, turn: int, similarity: float, last: bool) -> DataFrame:
    """a, b (a < b): candidates among the rows of apart(), from a BK-tree for each shard. The rows of
    a large shard are dealt over trees: in the last round each asks all of them, in the rounds
    before the one that it is dealt to, another each turn."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, tree = None, None
        for batch in batches:
            a, b = [], []
            for key, part, role, i, n, pos, root, short in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != current:
                    current, tree = (key, part), ShardTree()
                value = int.from_bytes(short, "little")

                def fits(other, d):
                    j, m, at, component = other
                    if component == root or (last and role == ASKS and j >= i):
                        return False
                    room = min(n - pos, m - at) * (1 + similarity)
                    return d <= share * (n + m) + 1e-6 and min(n, m) >= similarity * max(n, m) - 1e-6 and room >= similarity * (n + m) - 1e-6

                found = []
                if role != JOINS:
                    radius = min(SHORT, int(share * (n + n / similarity) + 1e-6))
                    found = tree.search(value, radius, fits, not last)
                    for j in found:
                        a.append(min(i, j))
                        b.append(max(i, j))
                if role != ASKS and (last or not found):
                    tree.add(value, (i, n, pos, root))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    trees = F.ceil(F.col("many") / TREE).cast("int")
    own = ("id", "n", "pos", "root", "short")
    dealt_to = lambda salt: F.pmod(F.xxhash64("id", "key", F.lit(salt)), trees).cast("int").alias("part")
    if last:
        one = met.where(F.col("many") <= TREE).select("key", F.lit(0).alias("part"), F.lit(BOTH).alias("role"), *own)
        large = met.where(F.col("many") > TREE)
        joins = large.select("key", dealt_to(0), F.lit(JOINS).alias("role"), *own)
        asks = large.select("key", F.explode(F.sequence(F.lit(0), trees - 1)).alias("part"), F.lit(ASKS).alias("role"), *own)
        dealt = one.unionByName(joins).unionByName(asks)
    else:
        dealt = met.select("key", dealt_to(turn), F.lit(BOTH).alias("role"), *own)
    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "role", F.xxhash64("id", F.lit(turn)))
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """id, text of every row, where a null id, or one that rows with different texts share, is
    replaced by a number of its own for each text, below all ids; and these numbers as a table
    (own_id, mark, id), or None where there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    mark = F.sha2(F.coalesce("text", F.lit("")), 256)
    shared = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("own_id"))
    if shared.isEmpty():
        return rows, None
    several = rows.join(shared, F.col("id").eqNullSafe(F.col("own_id")), "left_semi")
    several = several.select(F.col("id").alias("own_id"), mark.alias("mark")).distinct()
    differing = several.groupBy("own_id").agg(F.count("*").alias("n")).where("n > 1 or own_id is null").select(F.col("own_id").alias("o"))
    several = several.join(differing, F.col("own_id").eqNullSafe(F.col("o")), "left_semi")
    several = materialize(several.withColumn("number", F.lit(-(1 << 62)) - F.monotonically_increasing_id()), "near-numbers")
    met = rows.withColumn("m", mark).join(several, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("m") == F.col("mark")), "left")
    return met.select(F.coalesce("number", "id").alias("id"), "text"), several


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """id, component_id of rows that are not alone: components of all pairs whose sets of
    shingles (as 64-bit hashes) have a Jaccard similarity of at least `similarity`. Null and empty
    texts, and others without words, are not similar to anything. Ids are those of numbered(): a
    null id, or one of several texts, gets numbers below -2**62. Repeated rows are one row."""
    return _similar(numbered(docs, id_col, text_col)[0], shingle_words, similarity)


def _similar(rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    def shingled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches):
            sets = [np.unique(shingle_hashes(t, shingle_words)).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    def possible(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = np.bitwise_count(x ^ y).sum(axis=1) * (1 + similarity) <= (1 - similarity) * n + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = rows.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(rows, shingle_words))
    headed = materialize(heads(rows, counts, shingle_words, similarity), "near-heads")
    first = headed.groupBy("same").agg(F.min("id").alias("node"), F.count("*").alias("c")).where("c > 1").drop("c")
    equal = materialize(headed.select("id", "same").join(first, "same").where("id <> node").distinct(), "near-equal")
    edges = equal.select(F.col("id").alias("a"), F.col("node").alias("b"))
    stars = edges.where("false").toDF("node", "root")

    alone = headed.join(equal.select("id", "same"), ["id", "same"], "left_anti")
    nodes = materialize(alone.select("id", "n", "short", "sketch").distinct(), "near-nodes")
    of_key = W.partitionBy("key").orderBy("key")
    keys = alone.select("id", F.posexplode("head").alias("pos", "key"))
    beside = F.lag("id").over(of_key).isNotNull() | F.lead("id").over(of_key).isNotNull()
    met = materialize(keys.withColumn("met", beside).where("met").drop("met"), "near-met")
    sketches = nodes.select("id", "n", "sketch")
    tried = None
    for turn in range(ROUNDS + 1):
        now = materialize(apart(met, nodes, stars), "near-apart")
        pairs = tree_pairs(now, turn, similarity, turn == ROUNDS)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pairs.join(sketches.toDF("a", "m", "x"), "a").join(sketches.toDF("b", "n", "y"), "b")
        pairs = pairs.select("a", "b", "m", "n", "x", "y").mapInArrow(possible, "a long, b long").distinct()
        pairs = materialize(pairs, "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        asked, _ = met_and_others(rows, rows["id"], wanted)
        sets = asked.join(wanted, "id", "left_semi").mapInArrow(shingled, "id long, shingles binary").distinct()
        sets = materialize(sets, "near-sets")
        left, right = sets.toDF("a", "p"), sets.toDF("b", "q")
        found = pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(verified, "a long, b long")
        edges = edges.union(materialize(found, "near-edges"))
        release(now)
        release(sets)
        stars = components(edges)
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots).toDF("id", "component_id")


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """docs with one row of each component, with all columns: that of the smallest id, or a row
    whose id is null or stands for several texts. Rows are known by id and text together, so one
    that shares its id with a copy stays; repeated rows stay or go together."""
    rows, several = numbered(docs, id_col, text_col)
    with scratch() as hold:
        found = hold(materialize(_similar(rows, shingle_words, similarity), "near-found"))
    gone = found.where("id <> component_id").select(F.col("id").alias("gone_id")).distinct()
    own = docs[id_col].cast("long")
    if several is None:
        asked, others = met_and_others(docs, own, gone)
        return others.unionByName(asked.join(gone, own == gone["gone_id"], "left_anti"))
    marks = several.join(gone, several["number"] == gone["gone_id"]).select(F.col("own_id").alias("shared_id"), "mark")
    mark = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    asked, others = met_and_others(docs, own, gone.unionByName(marks.select(F.col("shared_id").alias("gone_id"))))
    left = asked.join(gone.where("gone_id > -4611686018427387904"), own == gone["gone_id"], "left_anti")
    left = left.join(marks, own.eqNullSafe(marks["shared_id"]) & (mark == marks["mark"]), "left_anti")
    return others.unionByName(left)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), shingle_words=3)
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
