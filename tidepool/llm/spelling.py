"""Spelling variants: words one edit apart, found by merging the subtrees of errata tries.

Words of texts are counted over the whole corpus; frequent ones of enough length are compared. Two
words are near if one inserted, deleted or replaced character makes them equal. Each word's form is
the near word with the largest count (of equal counts the smallest word), if it occurs FACTOR
times as often or more; root() follows forms to the last one, by doubling, since counts grow
FACTOR-fold with each step.

Near words share their first KEY characters or, where the edit falls within these, their last KEY
(words are at least 2 KEY long). So each word goes to two shards: one of words with its beginning,
and one of reversed words with its end. A task holds one shard at a time as a trie in which each edge
is a stretch of a word. At each node the children are taken by size, the heavy one first; every light
subtree is merged with its larger siblings: once with one character replaced (both subtrees without
their first character), and once each way with one skipped (one without, the other with it).
Merging walks two subtrees at once and only where both go on, so it costs no more than the smaller
one; along heavy paths nothing is copied. Terminals that coincide are near words. A pair with two
equal letters in a row is met once, where the words part. Reversed shards leave out pairs with a common
beginning, which the others have.

A shard of over SHARD words is not held: its near words that part right behind the common beginning
are joined by (beginning, remaining characters), and all others fall into shards with a beginning of one
character more. This goes on until no shard is too large, so a shard's size is bounded whatever the
words.

Null texts have no words; a null id counts as the empty text in the digest that edits words; repeated
rows count as often as they occur. Whole texts and words of any length count. Empty tables give
empty results; extra columns, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import LOWER_AZ, chunks, documents, materialize, release, scratch

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
RUN = rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+"
#: Of a run that this divides the digest of, a character is left out.
EDITED = 199
LEAST_CHARS, LEAST_COUNT, FACTOR = 6, 5, 5
#: Characters at a word's beginning or end that name its shard.
KEY = 3
#: Words of a shard that a task holds as a trie.
SHARD = 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def without_one(row_id: str, run: bytes) -> bytes:
    """The lower-cased run, with a character left out if its digest says so."""
    import zlib

    h = zlib.crc32(row_id.encode() + b":" + run)
    if h % EDITED:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of `least_chars` characters and `least_count` occurrences or more."""

    def count(batches: Iterator) -> Iterator:
        import re
        from collections import Counter

        import pyarrow as pa

        runs, total = re.compile(RUN), Counter()
        held = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in chunks(batches):
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(runs.findall(text.encode().translate(LOWER_AZ))).items():
                    if len(run) >= least_chars:
                        total[without_one(row_id, run)] += n
            if len(total) > HELD:
                yield held()
                total.clear()
        if total:
            yield held()

    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    sums = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= least_count) & (F.char_length("word") >= least_chars))


class Node:
    """A trie's node: the characters on the way to it are the first `depth` of `rep`."""

    __slots__ = ("rep", "depth", "word", "children", "size")

    def __init__(self, rep: str, depth: int):
        self.rep, self.depth, self.word, self.children, self.size = rep, depth, None, {}, 0


def build(words: list[str]) -> Node:
    """A trie of distinct, sorted words, whose edges are stretches of words."""
    top = Node("", 0)
    path, before = [top], ""
    for word in words:
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        last = None
        while path[-1].depth > shared:
            last = path.pop()
        if last is not None and path[-1].depth < shared:  # the edge is cut
            node = Node(word, shared)
            path[-1].children[word[path[-1].depth]] = node
            node.children[last.rep[shared]] = last
            path.append(node)
        leaf = Node(word, len(word))
        path[-1].children[word[path[-1].depth]] = leaf
        leaf.word = word
        path.append(leaf)
        before = word
    return top


def measure(top: Node) -> list[Node]:
    """Sets sizes (words below); the nodes, those above before those below."""
    order, work = [], [top]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(node.children.values())
    for node in reversed(order):
        node.size = (node.word is not None) + sum(c.size for c in node.children.values())
    return order


def coinciding(a: Node, i: int, b: Node, j: int) -> Iterator[tuple[str, str]]:
    """Words below a and b whose characters from i and j on are equal. Both subtrees are walked at
    once; i and j lie on the edges that lead to a and b, or at their ends."""
    work = [(a, i, b, j)]
    while work:
        a, i, b, j = work.pop()
        if length := min(a.depth - i, b.depth - j):
            if a.rep[i : i + length] != b.rep[j : j + length]:
                continue
            i, j = i + length, j + length
        if i < a.depth:
            if (child := b.children.get(a.rep[i])) is not None:
                work.append((a, i, child, j))
        elif j < b.depth:
            if (child := a.children.get(b.rep[j])) is not None:
                work.append((child, i, b, j))
        else:
            if a.word is not None and b.word is not None:
                yield a.word, b.word
            if len(a.children) <= len(b.children):
                work.extend((child, i, other, j) for c, child in a.children.items() if (other := b.children.get(c)) is not None)
            else:
                work.extend((other, i, child, j) for c, child in b.children.items() if (other := a.children.get(c)) is not None)


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Each pair of near words among distinct ones, once."""
    for node in measure(build(sorted(words))):
        d = node.depth
        children = sorted(node.children.values(), key=lambda c: -c.size)
        for k, light in enumerate(children):
            if node.word is not None and light.depth == d + 1 and light.word is not None:
                yield node.word, light.word
            for heavy in children[:k]:
                yield from coinciding(light, d + 1, heavy, d + 1)
                yield from coinciding(light, d + 1, heavy, d)
                yield from coinciding(light, d, heavy, d + 1)


def _pairs_of_shards(rows: DataFrame) -> DataFrame:
    """a, b: near words of each shard (side, key) of rows (side, key, word), words of side 1 reversed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pairs(side: int, words: list[str]) -> list[tuple[str, str]]:
            found = one_edit_pairs(words)
            if side:
                found = ((x[::-1], y[::-1]) for x, y in found)
                return [(x, y) for x, y in found if x[:KEY] != y[:KEY]]
            return list(found)

        held, current = [], None
        out = lambda both: pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array([y for _, y in both], pa.string())], ["a", "b"])
        for batch in batches:
            for side, key, word in zip(*(c.to_pylist() for c in batch.columns)):
                if (side, key) != current:
                    if len(held) > 1 and (both := pairs(current[0], held)):
                        yield out(both)
                    held, current = [], (side, key)
                held.append(word)
        if len(held) > 1 and (both := pairs(current[0], held)):
            yield out(both)

    dealt = rows.select("side", "key", "word").repartition("side", "key").sortWithinPartitions("side", "key")
    return dealt.mapInArrow(run, "a string, b string")


def _pairs_behind(rows: DataFrame, depth: int) -> DataFrame:
    """a, b: near words of rows (side, key, word) that part right behind their key, of `depth`
    characters: one replaced there, or one left out."""
    at = F.substring("word", F.lit(depth + 1), F.lit(1))
    rest = F.substring("word", F.lit(depth + 2), F.char_length("word"))
    whole = F.substring("word", F.lit(depth + 1), F.char_length("word"))
    own = rows.select("side", "key", "word", at.alias("next"), rest.alias("rest"), whole.alias("whole"))
    longer = own.where("next <> ''").select("side", "key", F.col("word").alias("a"), F.col("next").alias("x"), F.col("rest").alias("left"))
    same = (longer["side"] == own["side"]) & (longer["key"] == own["key"])
    other = own.where("next <> ''")
    replaced = longer.join(other, (longer["side"] == other["side"]) & (longer["key"] == other["key"]) & (longer["left"] == other["rest"]) & (longer["a"] < other["word"]))
    # where the shorter word goes on with the same letter, the two part further behind
    skipped = longer.join(own, same & (longer["left"] == own["whole"]) & (longer["x"] != own["next"]))
    side = longer["side"]
    both = replaced.select(side, "a", F.col("word").alias("b")).unionByName(skipped.select(side, "a", F.col("word").alias("b")))
    turned = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    both = both.select("side", turned("a"), turned("b"))
    return both.where((F.col("side") == 0) | (F.substring("a", 1, KEY) != F.substring("b", 1, KEY))).select("a", "b")


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """a, b: each pair of near words once, of a table with distinct words (column word) of at least
    2 KEY characters."""
    turned = F.reverse("word")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word")), F.struct(F.lit(1).alias("side"), turned.alias("word")))
    rows = words.select(F.explode(sides).alias("s")).select("s.side", "s.word")
    rows = rows.select("side", F.substring("word", 1, KEY).alias("key"), "word")
    out, depth = None, KEY
    while True:
        sizes = rows.groupBy("side", "key").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > shard).select("side", "key"), "spelling-large")
        if large.isEmpty():
            found = _pairs_of_shards(rows)
            return found if out is None else out.unionByName(found)
        found = _pairs_of_shards(rows.join(large, ["side", "key"], "left_anti"))
        crowded = materialize(rows.join(large, ["side", "key"], "left_semi"), "spelling-crowded")
        found = found.unionByName(_pairs_behind(crowded, depth))
        out = found if out is None else out.unionByName(found)
        depth += 1
        rows = crowded.where(F.char_length("word") >= depth).select("side", F.substring("word", F.lit(1), F.lit(depth)).alias("key"), "word")


def roots(forms: DataFrame) -> DataFrame:
    """word, root (and moved, which is false) of words that have a form (column form, null if none): the last of the forms
    that follow each other from it."""
    now = materialize(forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = now.drop("moved").join(ahead, "root", "left")
        stepped = stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, now = now, materialize(stepped, "spelling-roots")
        release(last)
    return now


def variants(words: DataFrame, factor: int = FACTOR, shard: int = SHARD) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of word_counts(). factor must be above 1."""
    with scratch() as keep:
        words = materialize(words, "spelling-words")
        pairs = materialize(near_words(words, shard), "spelling-pairs")
        both = pairs.union(pairs.select("b", "a"))
        counts = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
        best = both.join(counts, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b"))).alias("best"))
        met = words.join(best, F.col("word") == F.col("a"), "left")
        enough = -F.col("best.less") >= factor * F.col("n")
        met = met.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.b")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
        met = keep(materialize(met, "spelling-forms"))
        ends = keep(roots(met))
    return met.join(ends.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir)))
