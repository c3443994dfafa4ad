"""Document fingerprints: SimHash by weighted votes, and block tables that find the near ones.

Terms of a text are its distinct words (weight WORD) and its distinct pairs of neighbouring words
(weight PAIR), after lower-casing. A term's hash has 128 bits; each adds the term's weight to the
bit's vote or takes it away, and a fingerprint's bit is 1 where the votes are above zero. All of it is
DataFrame functions: terms are exploded and voted on within the task that has read the text. Two
votes share a long (bits j and j + 32 of a hash, as the sum of weights of its ones), so a text needs
64 sums. A bit's vote is above zero where its ones hold over half of the text's weight.

Fingerprints within RADIUS bits are found by block tables: the 128 bits are cut into RADIUS + LEAD
blocks, and each choice of LEAD blocks is a table that has these bits first, so two fingerprints
within the radius agree on the leading bits of one table at least. Equal leading bits meet in a join
that keeps a pair only if its distance is within the radius and no table before holds it too. Equal
fingerprints are one row there, with their number, so copies are never expanded.

neighbours() gives each row the text of the next one in descending order of ids. Rows are cut at
quantiles of the id into parts, which are sorted one by one; only the last row of a part takes its
neighbour from a table that holds the first text of each part (MOST_PARTS rows at most). Texts are
shuffled once, and votes are summed where the part lies.

Null texts count as empty; texts without words have fingerprint zero. Whole texts count; the edit of a
text of one or two characters changes nothing. Null ids come last; rows of one id go by text;
repeated rows are each other's neighbours. The only row of a table is its own neighbour. Fingerprints
depend on the text alone, so equal texts have equal ones. Empty tables give empty results; extra
columns, whatever their names, are not read."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import documents, materialize

BITS = 128
WORD, PAIR = 1, 2
#: Bits by which two fingerprints may differ to be near, and blocks at the head of a block table.
RADIUS, LEAD = 3, 1
#: Parts of neighbours(): for each shuffle partition, and at most.
PARTS_EACH, MOST_PARTS = 4, 16_384
#: Ids that a search takes as queries are divisible by this.
ASKED = 100
_LANES = 0x0000000100000001
_SPACE = "[\\x20\\x09-\\x0D]+"


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, a and b (the two halves of the fingerprint) of each row. keys tell rows apart. Where
    rows lie by some of the keys already, nothing is shuffled."""
    own = [F.col(f"`{k}`") for k in keys]
    split = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), _SPACE), lambda w: w != "")
    words = texts.select(*own, F.transform(split, lambda w: F.xxhash64(w)).alias("_words"))
    but_one = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_words", F.lit(1), but_one), F.slice("_words", F.lit(2), but_one), lambda x, y: F.xxhash64(x, y))
    terms = words.select(*own, F.array_distinct("_words").alias("_words"), F.array_distinct(pairs).alias("_pairs"))
    each = terms.select(*own, F.size("_words").alias("_n"), F.posexplode_outer(F.concat("_words", "_pairs")).alias("_at", "_h"))
    weight = F.when(F.col("_h").isNull(), 0).when(F.col("_at") < F.col("_n"), WORD).otherwise(PAIR).cast("long")
    votes = each.select(*own, weight.alias("_w"), F.coalesce("_h", F.lit(0)).alias("_h0"), F.xxhash64(F.coalesce("_h", F.lit(0))).alias("_h1"))
    ones = {
        (half, j): F.sum(F.shiftrightunsigned(f"_h{half}", j).bitwiseAND(F.lit(_LANES)) * F.col("_w")).alias(f"_s{half}_{j}")
        for half in (0, 1)
        for j in range(32)
    }
    sums = votes.groupBy(*own).agg(F.sum("_w").alias("_all"), *ones.values())

    def half(number: int) -> Column:
        bits = []
        for j in range(32):
            both = F.col(f"_s{number}_{j}")
            for shift, lane in ((0, both.bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(both, 32))):
                bit = 1 << (j + shift)
                bits.append(F.when(2 * lane > F.col("_all"), F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)))
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    return sums.select(*own, half(0).alias("a"), half(1).alias("b"))


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    """1 for equal fingerprints, about 0.5 for those of texts that share nothing."""
    return 1 - distance(a, b, c, d) / BITS


def digits(a: Column, b: Column) -> Column:
    """A fingerprint as 32 lower-case hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (a, b))))


def tables(radius: int = RADIUS, lead: int = LEAD) -> list[tuple[int, int]]:
    """Masks of the leading bits of each table, of a and of b, as signed numbers."""
    cuts = [round(BITS * i / (radius + lead)) for i in range(radius + lead + 1)]
    blocks = [((1 << end) - 1) ^ ((1 << start) - 1) for start, end in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = [sum(some) for some in combinations(blocks, lead)]
    return [(signed(m & (1 << 64) - 1), signed(m >> 64)) for m in chosen]


def within(prints: DataFrame, asked: DataFrame, radius: int = RADIUS, lead: int = LEAD) -> DataFrame:
    """c, d, a, b, distance: each fingerprint (a, b) of `prints` within the radius of one (a, b) of
    `asked`, which is (c, d) here. Both tables hold distinct fingerprints."""
    masks = tables(radius, lead)

    def led(table: DataFrame) -> DataFrame:
        heads = (
            F.struct(F.lit(i).alias("table"), F.col("a").bitwiseAND(F.lit(m)).alias("x"), F.col("b").bitwiseAND(F.lit(n)).alias("y"))
            for i, (m, n) in enumerate(masks)
        )
        return table.select(F.explode(F.array(*heads)).alias("h"), "a", "b").select("h.table", "h.x", "h.y", "a", "b")

    left, right = led(asked).withColumnsRenamed({"a": "c", "b": "d"}), led(prints)
    a, b, c, d = (F.col(n) for n in "abcd")
    before = [
        (left["table"] > i) & (a.bitwiseXOR(c).bitwiseAND(F.lit(m)) == 0) & (b.bitwiseXOR(d).bitwiseAND(F.lit(n)) == 0)
        for i, (m, n) in enumerate(masks[:-1])
    ]
    apart = distance(a, b, c, d)
    met = (left["table"] == right["table"]) & (left["x"] == right["x"]) & (left["y"] == right["y"]) & (apart <= radius)
    if before:
        met &= ~reduce(lambda p, q: p | q, before)
    return left.join(right, met).select("c", "d", "a", "b", apart.alias("distance"))


def _part(row_id: Column, bounds: list[int]) -> Column:
    """How many of the bounds lie above the id, so that parts follow each other as ids descend; null
    ids are in the last one. Two steps of a search, each over the root of the bounds."""
    if not bounds:
        return F.lit(0)
    bounds = sorted(bounds, reverse=True)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    numbers = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    above = lambda xs: F.size(F.filter(xs, lambda bound: bound > row_id))
    full = above(F.expr(numbers(g[0] for g in groups)))
    of = F.element_at(F.expr("array(" + ",".join(map(numbers, groups)) + ")"), F.greatest(full, F.lit(1)))
    found = F.when(full == 0, 0).otherwise((full - 1) * step + above(of))
    return F.when(row_id.isNull(), len(bounds)).otherwise(found)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """part, at (place in descending order of ids, from 0), id, text, next (text of the row after it;
    of the first row after the last)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = parts or min(MOST_PARTS, PARTS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / parts for i in range(1, parts)]
    bounds = (rows.agg(F.percentile_approx("id", cuts, 10 * parts)).first()[0] or []) if cuts else []
    dealt = rows.withColumn("part", _part(F.col("id"), sorted(set(bounds))))

    by_part = W.orderBy("part")  # over one row for each part
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    places = sizes.select(
        "part", "top", (F.sum("n").over(by_part) - F.col("n")).alias("start"),
        F.coalesce(F.lead("part").over(by_part), F.min("part").over(W.partitionBy())).alias("then"),
    )
    places = materialize(places, "votes-places")
    tops = places.select(F.col("part").alias("p"), "top")
    first = dealt.join(F.broadcast(tops), (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("top")))
    heads = first.groupBy(F.col("part").alias("then")).agg(F.min("text").alias("head"))
    starts = F.broadcast(places.select(F.col("part").alias("s"), "start"))
    after = places.join(heads, "then").select(F.col("part").alias("p"), "head")

    order = W.partitionBy("part").orderBy(F.col("id").desc_nulls_last(), "text")
    sorted_ = dealt.select("part", "id", "text", F.row_number().over(order).alias("rank"), F.lead("text").over(order).alias("lead"))
    met = sorted_.join(starts, F.col("part") == F.col("s")).join(after, (F.col("part") == F.col("p")) & F.col("lead").isNull(), "left")
    return met.select("part", (F.col("start") + F.col("rank") - 1).alias("at"), "id", "text", F.coalesce("lead", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many of the first code points of another."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """at, id, n_chars, edited_sha256, a and b (fingerprint), edited_a and edited_b of every row."""
    rows = neighbours(docs, id_col, text_col, parts)
    rows = rows.select("part", "at", "id", "text", edited(F.col("text"), F.col("next")).alias("changed"))
    rows = rows.select(
        "part", "at", "id", F.char_length("text").alias("n_chars"), F.unhex(F.sha2("changed", 256)).alias("digest"),
        F.posexplode(F.array("text", "changed")).alias("which", "text"),
    )
    keys = ["part", "at", "id", "n_chars", "digest"]
    prints = fingerprints(rows, [*keys, "which"])
    of = lambda which, half: F.max(F.when(F.col("which") == which, F.col(half)))
    both = prints.groupBy(*keys).agg(of(0, "a").alias("a"), of(0, "b").alias("b"), of(1, "a").alias("edited_a"), of(1, "b").alias("edited_b"))
    return both.select("at", "id", F.col("n_chars").cast("long"), F.lower(F.hex("digest")).alias("edited_sha256"), "a", "b", "edited_a", "edited_b")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near, of ids divisible by ASKED: other rows whose fingerprint lies within RADIUS."""
    rows = materialize(compared(documents(spark, sf_dir)), "votes")
    total = rows.count()
    before = (F.col("at") + total - 1) % max(1, total)
    following = rows.select(before.alias("p"), F.col("a").alias("c"), F.col("b").alias("d"))
    copies = rows.groupBy("a", "b").agg(F.count("*").alias("copies"))
    asked = rows.where(F.col("id") % ASKED == 0).select("a", "b").distinct()
    found = within(copies.select("a", "b"), asked).join(copies, ["a", "b"])
    near = found.groupBy("c", "d").agg((F.sum("copies") - 1).alias("n_near")).withColumnsRenamed({"c": "e", "d": "f"})
    out = rows.join(following, rows["at"] == following["p"])
    out = out.join(near, (F.col("id") % ASKED == 0) & (F.col("a") == F.col("e")) & (F.col("b") == F.col("f")), "left")
    a, b = F.col("a"), F.col("b")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digits(a, b).alias("fingerprint"),
        digits(F.col("edited_a"), F.col("edited_b")).alias("edited_fingerprint"),
        likeness(a, b, F.col("edited_a"), F.col("edited_b")).alias("near_edited"),
        likeness(a, b, F.col("c"), F.col("d")).alias("near_next"), "n_near",
    )
